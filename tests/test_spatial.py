import json
import random

import numpy as np

from terroir.functions.geo import chord, haversine_np, unit_vectors
from terroir.operators import spatial
from tests.conftest import rows

POINTS = "lot_id long, lat double, lon double"


def brute(points, metres):
    p = sorted({(k, a, b) for k, a, b in points if k is not None and a is not None and b is not None and abs(a) <= 90})
    out = set()
    for i, (k, a, b) in enumerate(p):
        for m, c, d in p[i + 1 :]:
            if k != m and (a, b) != (c, d) and haversine_np(a, b, c, d) <= metres:
                out.add((min(k, m), max(k, m)))
    return sorted(out, key=str)


def cloud(n, seed, where=(43.5, -1.5), spread=0.002):
    r = random.Random(seed)
    return [(k, where[0] + r.random() * spread, where[1] + r.random() * spread) for k in range(n)]


def test_neighbours_equal_brute_force(spark):
    points = cloud(300, 1) + [(k, 43.501, -1.499) for k in range(1000, 1040)] + [(5, None, 1.0), (6, 1.0, None), (None, 43.501, -1.499), (7, float("nan"), 1.0)]
    got = rows(spatial.neighbours(spark.createDataFrame(points + points[:50], POINTS), "lot_id", 15.0))
    assert got == brute(points[:-4], 15.0) and got


def test_poles_and_date_line(spark):
    points = [(1, 89.99999, 10.0), (2, 89.99999, -170.0), (3, 0.0, 179.99999), (4, 0.0, -179.99999), (5, 0.0, 0.0)]
    assert rows(spatial.neighbours(spark.createDataFrame(points, POINTS), "lot_id", 15.0)) == [(1, 2), (3, 4)]


def test_many_parts_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 20)
    points = cloud(400, 2)
    assert rows(spatial.neighbours(spark.createDataFrame(points, POINTS), "lot_id", 25.0)) == brute(points, 25.0)


def test_close_pairs_equal_all_pairs():
    r = np.random.default_rng(3)
    p = unit_vectors(43 + r.random(500) * 0.01, r.random(500) * 0.01)
    i, j = spatial.close_pairs(p, chord(60.0))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(d <= chord(60.0), 1)))}
    assert {(min(a, b), max(a, b)) for a, b in zip(i, j)} == want and len(i) == len(want)


def test_empty_and_single(spark):
    assert spatial.neighbours(spark.createDataFrame([], POINTS), "lot_id", 15.0).count() == 0
    assert spatial.neighbours(spark.createDataFrame([(1, 1.0, 1.0)], POINTS), "lot_id", 15.0).count() == 0


def square(x, y, s=1.0, hole=None):
    ring = [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    return json.dumps({"type": "Polygon", "coordinates": [ring, *([hole] if hole else [])]})


POLYGONS = "code_iris string, nom_iris string, nom_commune string, geometry string"


def shapes():
    hole = [[4.25, 0.25], [4.75, 0.25], [4.75, 0.75], [4.25, 0.75], [4.25, 0.25]]
    multi = json.dumps({"type": "MultiPolygon", "coordinates": [json.loads(square(8, 0))["coordinates"], json.loads(square(10, 0))["coordinates"]]})
    return [("A", "a", "t", square(0, 0)), ("B", "b", "t", square(1, 0)), ("H", "h", "t", square(4, 0, hole=hole)), ("M", "m", "t", multi), ("Z", None, None, None), ("Y", None, None, "{}"), ("X", None, None, "junk")]


PLACES = [((0.5, 0.5), "A"), ((0.5, 1.5), "B"), ((0.5, 1.0), "A"), ((0.0, 0.0), "A"), ((1.0, 2.0), "B"), ((0.5, 4.5), None), ((0.1, 4.1), "H"), ((0.25, 4.5), "H"), ((0.5, 8.5), "M"), ((0.5, 9.5), None), ((0.5, 10.5), "M"), ((5.0, 5.0), None), ((None, 1.0), None), ((1.0, None), None)]


def test_regions(spark, monkeypatch):
    pts = spark.createDataFrame([(k, *p) for k, (p, _) in enumerate(PLACES)], POINTS)
    pol = spark.createDataFrame(shapes(), POLYGONS)
    for limit in (spatial.POLYGON_BYTES, 0):  # travelling with the task, then joined by tiles
        monkeypatch.setattr(spatial, "POLYGON_BYTES", limit)
        got = {r["lot_id"]: r["region"] for r in spatial.attach_region(pts, pol).collect()}
        assert got == {k: want for k, (_, want) in enumerate(PLACES)}
    assert {r["region"] for r in spatial.attach_region(pts, pol.limit(0)).collect()} == {None}
    assert spatial.attach_region(pts.limit(0), pol).count() == 0


def test_found_with_clashing_columns(spark):
    g = spark.createDataFrame([(1, 0.5, 0.5, "x", 1), (2, 0.50001, 0.5, "x", 2)], POINTS + ", region string, salt int")
    i = spark.createDataFrame([(1, 0.5, 0.5, "B", "x"), (2, 0.5, 0.5, "A", "x"), (3, 9.0, 9.0, None, "x"), (4, 9.0, 9.0, "A", "x"), (5, None, 9.0, "A", "x"), (6, 999.0, 9.0, "A", "x"), (7, 999.0, 9.0, None, "x")], POINTS + ", code_iris string, region string")
    got = rows(spatial.found(g, i, spark.createDataFrame(shapes(), POLYGONS)))
    assert got == [("region", 1, 0, "A"), ("region", 4, 0, ""), ("region", 6, 0, ""), ("voisin", 1, 2, "")]


def disc(x, y, r, n):
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.column_stack([x + r * np.cos(a), y + r * np.sin(a)]).tolist()
    return [ring + ring[:1]]


def brute_first(rings, lat, lon):
    """Even-odd rule edge by edge."""
    out = np.full(len(lat), -1)
    for k in reversed(range(len(rings))):
        odd = np.zeros(len(lat), dtype=bool)
        for ring in rings[k]:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if y1 != y2:
                    odd ^= ((y1 <= lat) != (y2 <= lat)) & (lon > x1 + (lat - y1) * (x2 - x1) / (y2 - y1))
        out[odd] = k
    return out


def test_the_sweep_equals_brute_force():
    r = np.random.default_rng(7)
    rings = [disc(x, y, r.uniform(0.3, 0.9), int(r.integers(3, 40))) + disc(x, y, 0.1, 7) for x in range(6) for y in range(6)]
    lat, lon = r.uniform(-1, 6, 3000), r.uniform(-1, 6, 3000)
    assert (spatial.Sweep(rings).first(lat, lon) == brute_first(rings, lat, lon)).all()


def test_cost_grows_with_edges_and_points_not_their_product():
    import time

    def cost(side):
        r = np.random.default_rng(1)
        rings = [disc(x, y, 0.49, 64) for x in range(side) for y in range(side)]
        lat, lon = r.uniform(0, side, 20_000), r.uniform(0, side, 20_000)
        began = time.perf_counter()
        hit = spatial.Sweep(rings).first(lat, lon)
        return time.perf_counter() - began, sum(p.edges.shape[0] for p in spatial.Sweep(rings).polygons), hit

    small, large = cost(9), cost(100)  # 81 and 10,000 polygons
    assert large[1] == 65 * 10_000 and (large[2] >= 0).mean() > 0.6
    assert large[0] < 125 * small[0] + 5  # 123 times the edges; the same points


def test_a_hot_tile_and_a_hot_coordinate(spark, monkeypatch):
    monkeypatch.setattr(spatial, "POLYGON_BYTES", 0)
    monkeypatch.setattr(spatial._attach_by_tile, "__defaults__", (3,))
    r = random.Random(5)
    pts = [(k, r.random(), r.random() * 2) for k in range(200)] + [(k, 0.5, 0.5) for k in range(500, 900)]
    got = {x["lot_id"]: x["region"] for x in spatial.attach_region(spark.createDataFrame(pts, POINTS), spark.createDataFrame(shapes(), POLYGONS)).collect()}
    assert got == {k: "A" if lon <= 1 else "B" for k, lat, lon in pts}


def test_the_sample_shapes_as_many_parts_as_needed(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 40)
    seen, real = [], spatial.Splits.__init__

    def init(self, *a):
        real(self, *a)
        seen.append(self.parts)

    monkeypatch.setattr(spatial.Splits, "__init__", init)
    points = cloud(2000, 11, spread=0.02)
    assert rows(spatial.neighbours(spark.createDataFrame(points, POINTS), "lot_id", 15.0)) == brute(points, 15.0)
    assert seen == [50]


def test_extents_and_centre(spark):
    pol = spark.createDataFrame(shapes(), POLYGONS)
    got = {r["code_iris"]: tuple(r)[1:] for r in spatial.extents(pol).collect()}
    assert got == {"A": (0.0, 0.0, 1.0, 1.0, 0.5, 0.5), "B": (1.0, 0.0, 2.0, 1.0, 1.5, 0.5), "H": (4.0, 0.0, 5.0, 1.0, 4.5, 0.5), "M": (8.0, 0.0, 11.0, 1.0, 9.5, 0.5)}
    assert tuple(spatial.centre(pol).first()) == (0.5, 5.5) and tuple(spatial.centre(pol, prefix="q").first()) == (None, None)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 50.0, 0.5), (3, None, 1.0)], POINTS)
    assert rows(spatial.placement(pts, pol)) == [("hors_perimetre_iris", 1), ("non_geocodee", 1), ("rattachee", 1)]
