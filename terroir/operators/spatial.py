"""Points near other points, and the region that holds a point.

Neighbours: coordinates become points of the unit sphere, so distance is a straight chord and neither
poles nor the date line are special. A k-d tree over a bounded sample splits space into parts of similar
numbers; a point within the radius of a split plane is copied to the other side (halo). Inside a
part a local k-d tree is joined with itself by chord radius. A pair is reported only by the part that owns its
first point, so it comes out once. The sample only balances the parts; the result does not depend on it.

Regions: points are sorted by latitude once. Of each polygon only the points in its box are looked at, in the order of a line swept over its edges: an edge
becomes active when the line reaches its lower end and leaves beyond its upper one. The active edges to the left of a point
tell by parity whether the polygon holds it, holes included. A point on an edge belongs to the polygon; of several, the first one counts. Edges are
stored once, so time and space grow with edges and points, not with their product.

Scale: identical coordinates are one site, so a fallback point that holds a third of all rows is one point
of the search; its rows are joined back, hot sites split by count. Only site pairs within the radius are made. What shapes the splits is a few coordinates for each
part, a thousandth of the sites, so parts keep their size however many sites there are. Few polygons (a checked size) travel with
the task; more are joined by map tiles with distinct coordinates, tiles of many coordinates split by count.

Defined results: null and NaN coordinates and latitudes beyond 90 degrees are ignored by ``neighbours`` and give a null region; identical coordinates are
no pair; repeated rows count once; empty tables and no polygons give no pairs and null regions; degenerate rings hold nothing but their own edges.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.geo import chord, haversine_np, unit_vectors
from terroir.operators.joins import spread_join
from terroir.session import cut_lineage

#: Parameters: coordinates that shape the splits, for each part; sites meant for one part; points of a leaf of the local tree.
SAMPLE, PART, LEAF = 20, 20_000, 24


def _valid(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) < 1e6)


class Splits:
    """A k-d tree as arrays: axis (-1 for a part), cut, children or number of the part."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.axis, self.cut, self.low, self.high = [], [], [], []
        self.parts = 0
        self._grow(sample, max(1, parts))
        self.axis, self.low, self.high = (np.array(x, dtype=np.int64) for x in (self.axis, self.low, self.high))
        self.cut = np.array(self.cut, dtype=float)

    def _grow(self, points: np.ndarray, parts: int) -> int:
        at = len(self.axis)
        self.axis.append(-1), self.cut.append(0.0), self.low.append(0), self.high.append(0)
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) > 1 else 0
        if parts > 1 and len(points) > 1 and np.ptp(points[:, axis]) > 0:
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] < cut
            if left.any() and not left.all():
                self.axis[at], self.cut[at] = axis, cut
                self.low[at] = self._grow(points[left], parts // 2)
                self.high[at] = self._grow(points[~left], parts - parts // 2)
                return at
        self.low[at] = self.parts
        self.parts += 1
        return at

    def place(self, points: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, own): the part that owns each point, and the parts it is copied to."""
        row, node, own = np.arange(len(points)), np.zeros(len(points), dtype=np.int64), np.ones(len(points), dtype=bool)
        done = []
        while len(row):
            leaf = self.axis[node] < 0
            done.append((row[leaf], self.low[node[leaf]], own[leaf]))
            row, node, own = row[~leaf], node[~leaf], own[~leaf]
            off = points[row, self.axis[node]] - self.cut[node]
            to_low, to_high = off < halo, off >= -halo
            low_owns = off < 0
            row, node, own = (
                np.concatenate([row[to_low], row[to_high]]),
                np.concatenate([self.low[node[to_low]], self.high[node[to_high]]]),
                np.concatenate([own[to_low] & low_owns[to_low], own[to_high] & ~low_owns[to_high]]),
            )
        return tuple(np.concatenate(x) for x in zip(*done))


def close_pairs(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i != j, each once, of points at most radius apart: a k-d tree joined with itself."""
    out_a, out_b, r2 = [], [], radius * radius
    order = np.arange(len(points))
    boxes: list[tuple] = []

    def grow(at: np.ndarray) -> int:
        p = points[at]
        lo, hi = p.min(axis=0), p.max(axis=0)
        me = len(boxes)
        boxes.append(None)
        axis = int(np.argmax(hi - lo))
        if len(at) <= LEAF or hi[axis] == lo[axis]:
            boxes[me] = (lo, hi, at, None)
        else:
            half = len(at) // 2
            part = at[np.argpartition(p[:, axis], half)]
            boxes[me] = (lo, hi, None, (grow(part[:half]), grow(part[half:])))
        return me

    if len(points) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    grow(order)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        lo_a, hi_a, at_a, kids_a = boxes[a]
        if a == b:
            if kids_a:
                todo += [(kids_a[0], kids_a[0]), (kids_a[1], kids_a[1]), kids_a]
                continue
            d = points[at_a][:, None, :] - points[at_a][None, :, :]
            i, j = np.nonzero(np.triu((d * d).sum(axis=2) <= r2, 1))
            out_a.append(at_a[i]), out_b.append(at_a[j])
            continue
        lo_b, hi_b, at_b, kids_b = boxes[b]
        gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        if (gap * gap).sum() > r2:
            continue
        if kids_a and (not kids_b or (hi_a - lo_a).max() >= (hi_b - lo_b).max()):
            todo += [(kids_a[0], b), (kids_a[1], b)]
        elif kids_b:
            todo += [(a, kids_b[0]), (a, kids_b[1])]
        else:
            d = points[at_a][:, None, :] - points[at_b][None, :, :]
            i, j = np.nonzero((d * d).sum(axis=2) <= r2)
            out_a.append(at_a[i]), out_b.append(at_b[j])
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def site_pairs(sites: DataFrame, metres: float) -> DataFrame:
    """lat_a, lon_a, lat_b, lon_b of distinct sites (lat, lon) at most ``metres`` apart, a before b by (lat, lon)."""
    sites = cut_lineage(sites.select("lat", "lon"))  # read three times: counted, sampled and placed
    parts = -(-sites.count() // PART)
    shape = sites.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(PART)) < SAMPLE).toPandas() if parts > 1 else pd.DataFrame({"lat": [], "lon": []})
    shape = shape.sort_values(["lat", "lon"])
    splits = sites.sparkSession.sparkContext.broadcast(Splits(unit_vectors(shape["lat"].to_numpy(float), shape["lon"].to_numpy(float)), parts))
    # a hair more than the radius; the great-circle distance decides
    radius = chord(metres) * (1 + 1e-9) + 1e-15

    def place(batches):
        for pdf in batches:
            row, part, own = splits.value.place(unit_vectors(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)), radius)
            yield pd.DataFrame({"part": part, "own": own, "lat": pdf["lat"].to_numpy()[row], "lon": pdf["lon"].to_numpy()[row]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, own = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["own"].to_numpy()
        i, j = close_pairs(unit_vectors(lat, lon), radius)
        swap = (lat[j] < lat[i]) | ((lat[j] == lat[i]) & (lon[j] < lon[i]))
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        keep = own[a] & (haversine_np(lat[a], lon[a], lat[b], lon[b]) <= metres)
        a, b = a[keep], b[keep]
        return pd.DataFrame({"lat_a": lat[a], "lon_a": lon[a], "lat_b": lat[b], "lon_b": lon[b]})

    placed = sites.mapInPandas(place, "part long, own boolean, lat double, lon double")
    return placed.groupBy("part").applyInPandas(search, "lat_a double, lon_a double, lat_b double, lon_b double")


def neighbours(points: DataFrame, id_col: str, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """id_a < id_b of rows with different coordinates at most ``metres`` apart."""
    rows = cut_lineage(points.where(F.col(id_col).isNotNull() & _valid(F.col(lat), F.col(lon))).select(F.col(id_col).alias("id"), (F.col(lat) + 0.0).alias("lat"), (F.col(lon) + 0.0).alias("lon")).distinct())
    pairs = site_pairs(rows.select("lat", "lon").distinct(), metres)
    side = lambda x: rows.select(F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"), F.col("id").alias(x))
    first = spread_join(side("a"), pairs, ["lat_a", "lon_a"], ["a"]).select("lat_b", "lon_b", "a")
    both = spread_join(side("b"), first, ["lat_b", "lon_b"], ["b"])
    return both.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()


def rings_of(geometry: str | None) -> list[list[list[float]]]:
    """All rings of a GeoJSON Polygon or MultiPolygon; none of anything else."""
    try:
        g = json.loads(geometry or "null") or {}
    except ValueError:
        return []
    if g.get("type") == "Polygon":
        return g["coordinates"] or []
    if g.get("type") == "MultiPolygon":
        return [ring for polygon in g["coordinates"] for ring in polygon]
    return []


class Polygon:
    """The edges of one polygon by their lower ends, ready for a sweep."""

    def __init__(self, rings: list):
        edges = [np.empty((0, 4))]
        for ring in rings:
            p = np.asarray([q[:2] for q in ring], dtype=float).reshape(-1, 2)
            if len(p) > 1:
                edges.append(np.column_stack([p, np.roll(p, -1, axis=0)]))
        e = np.concatenate(edges)
        swap = (e[:, 1] > e[:, 3]) | ((e[:, 1] == e[:, 3]) & (e[:, 0] > e[:, 2]))
        e[swap] = e[swap][:, [2, 3, 0, 1]]  # every edge points up: neighbours see the same numbers
        self.edges = e[np.argsort(e[:, 1], kind="stable")]
        x = e[:, [0, 2]]
        #: west, south, east, north
        self.box = (x.min(), e[:, 1].min(), x.max(), e[:, 3].max()) if len(e) else (np.inf, np.inf, -np.inf, -np.inf)

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each point is inside or on an edge; points in ascending order of y."""
        out = np.zeros(len(x), dtype=bool)
        active, reached, at = np.empty(0, dtype=np.int64), 0, 0
        low, high = self.edges[:, 1], self.edges[:, 3]
        while at < len(x):
            size = max(1, min(512, (1 << 20) // (len(active) + 1), len(x) - at))
            to = int(np.searchsorted(low, y[at + size - 1], side="right"))
            active = np.concatenate([active, np.arange(reached, to)])
            active, reached = active[high[active] >= y[at]], max(reached, to)
            e, px, py = self.edges[active], x[at : at + size, None], y[at : at + size, None]
            cross = (e[:, 2] - e[:, 0]) * (py - e[:, 1]) - (px - e[:, 0]) * (e[:, 3] - e[:, 1])
            spans = (e[:, 1] <= py) & (py <= e[:, 3])
            left = spans & (py < e[:, 3]) & (cross < 0)
            on = spans & (cross == 0) & (px >= np.minimum(e[:, 0], e[:, 2])) & (px <= np.maximum(e[:, 0], e[:, 2]))
            out[at : at + size] = (left.sum(axis=1) % 2 == 1) | on.any(axis=1)
            at += size
        return out


class Sweep:
    """Polygons in order, ready for points in bulk."""

    def __init__(self, rings: list[list]):
        """rings: for each polygon, in order, its rings."""
        self.polygons = [Polygon(own) for own in rings]
        self.boxes = np.array([p.box for p in self.polygons]).reshape(-1, 4)

    def first(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Index of the first polygon that holds each point, -1 if none."""
        out = np.full(len(lat), -1, dtype=np.int64)
        at = np.flatnonzero(~(np.isnan(lat) | np.isnan(lon)))
        at = at[np.argsort(lat[at], kind="stable")]
        y, x = lat[at], lon[at]
        start, stop = np.searchsorted(y, self.boxes[:, 1], side="left"), np.searchsorted(y, self.boxes[:, 3], side="right")
        for k in np.flatnonzero(stop > start).tolist():
            west, _, east, _ = self.boxes[k]
            part = slice(start[k], stop[k])
            near = np.flatnonzero((x[part] >= west) & (x[part] <= east) & (out[at[part]] < 0)) + start[k]
            if len(near):
                out[at[near[self.polygons[k].holds(x[near], y[near])]]] = k
        return out


@lru_cache(maxsize=4)
def _sweep(geometries: tuple[str, ...]) -> Sweep:
    return Sweep([rings_of(g) for g in geometries])


#: Parameters: text of polygons that may travel with a task, degrees of a tile beyond that.
POLYGON_BYTES, TILE = 32 << 20, 0.25


def attach_region(points: DataFrame, polygons: DataFrame, code: str = "code_iris", out: str = "region", lat: str = "lat", lon: str = "lon", order: str | None = None) -> DataFrame:
    """The points with ``out``, the code of the first polygon (by ``order``, else by code) that holds each."""
    clean = polygons.where(F.col(code).isNotNull() & F.col("geometry").isNotNull()).select(F.col(order or code).alias("o"), F.col(code).alias("c"), F.col("geometry").alias("g"))
    size = clean.agg(F.sum(F.octet_length("g")).alias("b")).first()["b"] or 0
    if size > POLYGON_BYTES:
        return _attach_by_tile(points, clean, out, lat, lon)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    known = clean.orderBy("o", "c").toPandas()
    geometries, codes = tuple(known["g"]), np.array([*known["c"], None], dtype=object)

    def sweep(batches):
        for pdf in batches:
            hit = _sweep(geometries).first(pdf[lat].to_numpy(float), pdf[lon].to_numpy(float))
            yield pdf.assign(**{out: codes[hit]})

    return points.mapInPandas(sweep, f"{fields}, `{out}` string")


def _attach_by_tile(points: DataFrame, clean: DataFrame, out: str, lat: str, lon: str, hot: int = 200_000) -> DataFrame:
    """Polygons go to every tile their box meets, distinct coordinates to their own tile; tiles with more than ``hot`` coordinates are split by a hash of
    those. What a tile finds is joined back to the points."""

    def tiles(batches):
        for pdf in batches:
            rows = []
            for o, c, g in zip(pdf["o"], pdf["c"], pdf["g"]):
                p = np.array([q[:2] for ring in rings_of(g) for q in ring], dtype=float)
                if len(p):
                    (x0, y0), (x1, y1) = np.floor(p.min(axis=0) / TILE).astype(int), np.floor(p.max(axis=0) / TILE).astype(int)
                    rows += [(int(x), int(y), o, c, g) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
            yield pd.DataFrame(rows, columns=["tx", "ty", "o", "c", "g"])

    kind = clean.schema["o"].dataType.simpleString()
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    places = cut_lineage(points.select((F.col(lat) + 0.0).cast("double").alias("lat"), (F.col(lon) + 0.0).cast("double").alias("lon")).where(there).distinct().select("lat", "lon", tile("lon").alias("tx"), tile("lat").alias("ty")))
    salts = places.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("salts"))
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    spread = clean.mapInPandas(tiles, f"tx long, ty long, o {kind}, c string, g string").join(salts.toDF("tx", "ty", "copies"), ["tx", "ty"]).select("tx", "ty", every, "o", "c", "g")
    own = places.join(salts, ["tx", "ty"]).select("tx", "ty", F.pmod(F.xxhash64("lat", "lon"), F.col("salts")).cast("int").alias("salt"), "lat", "lon")

    def sweep(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values(["o", "c"])
        codes = np.array([*near["c"], None], dtype=object)
        hit = Sweep([rings_of(g) for g in near["g"]]).first(mine["lat"].to_numpy(float), mine["lon"].to_numpy(float))
        found = pd.DataFrame({"lat": mine["lat"], "lon": mine["lon"], "c": codes[hit]})
        return found[found["c"].notna()]

    keys = ["tx", "ty", "salt"]
    held = own.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(sweep, "lat double, lon double, c string")
    r = held.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("c").alias(out))
    return points.join(r, (points[lat] == r["_lat"]) & (points[lon] == r["_lon"]), "left").select(*[points[c] for c in points.columns], r[out])


def placement(points: DataFrame, polygons: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """etat, n: how many points have no coordinates, lie outside every polygon, or in one."""
    r = attach_region(points, polygons, out="_region", lat=lat, lon=lon)
    state = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "non_geocodee").when(F.col("_region").isNull(), "hors_perimetre_iris").otherwise("rattachee")
    return r.groupBy(state.alias("etat")).agg(F.count(F.lit(1)).alias("n"))


def flat_coordinates(geometry: Column) -> Column:
    """All [lon, lat] of a GeoJSON Polygon or MultiPolygon in one array, in their order; null of anything else."""
    ring = "array<array<array<double>>>"
    one, many = (F.from_json(geometry, f"struct<coordinates:{t}>")["coordinates"] for t in (ring, f"array<{ring}>"))
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Polygon", F.flatten(one)).when(kind == "MultiPolygon", F.flatten(F.flatten(many)))


def extents(polygons: DataFrame, code: str = "code_iris") -> DataFrame:
    """code, ouest, sud, est, nord, and the centre (lon, lat) of the box of each polygon."""
    p = flat_coordinates(F.col("geometry"))
    side = lambda f, i: f(F.transform(p, lambda q: q[i]))
    box = polygons.select(code, side(F.array_min, 0).alias("ouest"), side(F.array_min, 1).alias("sud"), side(F.array_max, 0).alias("est"), side(F.array_max, 1).alias("nord"))
    each = box.groupBy(code).agg(F.min("ouest").alias("ouest"), F.min("sud").alias("sud"), F.max("est").alias("est"), F.max("nord").alias("nord")).where(F.col("ouest").isNotNull())
    return each.withColumns({"lon": (F.col("ouest") + F.col("est")) / 2, "lat": (F.col("sud") + F.col("nord")) / 2})


def centre(polygons: DataFrame, code: str = "code_iris", prefix: str = "") -> DataFrame:
    """lat, lon of the centre of the box around all polygons whose code begins with ``prefix``; null without any."""
    box = extents(polygons, code).where(F.col(code).startswith(prefix)).agg(F.min("ouest").alias("o"), F.max("est").alias("e"), F.min("sud").alias("s"), F.max("nord").alias("n"))
    return box.select(((F.col("s") + F.col("n")) / 2).alias("lat"), ((F.col("o") + F.col("e")) / 2).alias("lon"))


def found(geocoded: DataFrame, iris: DataFrame, polygons: DataFrame, metres: float = 15.0) -> DataFrame:
    """genre, lot_a, lot_b, code_iris: neighbouring lots, and lots whose recorded region is not the one that holds them."""
    near = neighbours(geocoded, "lot_id", metres).select(F.lit("voisin").alias("genre"), F.col("lot_id_a").alias("lot_a"), F.col("lot_id_b").alias("lot_b"), F.lit("").alias("code_iris"))
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")  # even off the globe: then no polygon holds it
    placed = iris.where(F.col("lot_id").isNotNull() & there).select("lot_id", "lat", "lon", "code_iris")
    held = attach_region(placed, polygons).select("lot_id", F.coalesce("code_iris", F.lit("")).alias("recorded"), F.coalesce("region", F.lit("")).alias("code"))
    wrong = held.where(F.col("recorded") != F.col("code")).select(F.lit("region").alias("genre"), F.col("lot_id").alias("lot_a"), F.lit(0).cast("long").alias("lot_b"), F.col("code").alias("code_iris")).distinct()
    return near.unionByName(wrong)
