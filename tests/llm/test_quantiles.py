import numpy as np
import pytest
from pyspark.sql import functions as F

from terroir.llm import quantiles
from terroir.llm.quantiles import Sketching
from tests.conftest import rows


def test_bracket_holds_the_percentile():
    r = np.random.default_rng(5)
    s = Sketching()
    for values in (r.lognormal(8, 0.5, 100_000), r.lognormal(8, 0.02, 20_000), np.full(1000, 3000.0), r.uniform(10, 1e6, 50), np.array([1234.5])):
        sketch = s.build(s.encode(values), np.ones(len(values)))
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            mid, low, high = s.bracket(sketch, q)
            true = np.quantile(values, q)
            assert low <= true <= high and abs(mid - true) / true < 0.2
    big = r.lognormal(8, 0.5, 200_000)
    sketch = s.build(s.encode(big), np.ones(len(big)))
    assert all(abs(s.bracket(sketch, q)[0] / np.quantile(big, q) - 1) < 0.01 for q in (0.1, 0.5, 0.9))


def test_merging_is_adding_and_deletions_undo():
    r = np.random.default_rng(6)
    s = Sketching(bits=14, width=128, depth=3)
    a, b = r.lognormal(8, 0.5, 3000), r.lognormal(9, 0.5, 3000)
    both = s.build(s.encode(np.concatenate([a, b])), np.ones(6000))
    apart = s.build(s.encode(a), np.ones(3000)) + s.build(s.encode(b), np.ones(3000))
    assert (both == apart).all()
    s.add(both, s.encode(b), -np.ones(3000))
    assert (both == s.build(s.encode(a), np.ones(3000))).all()
    assert (s.counters([s.pack(both)]) == both).all()
    few = [s.pack_codes(np.array([1, 5]), np.array([2.0, 1.0])), s.pack_codes(np.array([5]), np.array([-1.0]))]
    assert [x.tolist() for x in s.total(few)] == [[1, 5], [2.0, 0.0]] and s.counters([*few, s.pack(both)])[1] == both[1] + 2


def test_out_of_range_values_open_the_bracket():
    s = Sketching(low=1.0, high=1e4)
    sketch = s.build(s.encode(np.array([-5.0, 0.0, 0.5, 2.0, 1e9])), np.ones(5))
    assert s.bracket(sketch, 0.0)[1] == -np.inf and s.bracket(sketch, 1.0)[2] == np.inf


def frame(spark, data):
    return spark.createDataFrame(data, "g string, id long, v double")


def test_groups_nulls_and_repeats(spark):
    data = [("a", k, float(k + 1)) for k in range(100)] + [("a", k, float(k + 1)) for k in range(50)] + [(None, 1, 5.0), ("b", 1, None), ("b", 2, float("nan")), ("b", 3, float("inf"))]
    parts = quantiles.build_sketches(frame(spark, data), ["g"], "v", distinct_on="id")
    out = {r["g"]: r for r in quantiles.percentiles(quantiles.merge_sketches(parts, ["g"]), ["g"], {"p": 0.5}).collect()}
    assert set(out) == {"a", None} and out["a"]["n"] == 100 and out["a"]["p_low"] <= 50.5 <= out["a"]["p_high"] and out[None]["n"] == 1
    assert quantiles.merge_sketches(quantiles.build_sketches(frame(spark, []), ["g"], "v"), ["g"]).count() == 0


def test_days_merge_and_weights_delete(spark):
    day = lambda lo, hi, w: frame(spark, [("a", k, float(k + 1)) for k in range(lo, hi)]).withColumn("w", F.lit(w))
    parts = [quantiles.build_sketches(day(*x), ["g"], "v", weight="w") for x in ((0, 300, 1), (300, 600, 1), (300, 600, -1))]
    merged = quantiles.merge_sketches(parts[0].union(parts[1]).union(parts[2]), ["g"])
    r = quantiles.percentiles(merged, ["g"], {"p": 0.5}).first()
    assert r["n"] == 300 and r["p_low"] <= 150.5 <= r["p_high"]


POINTS = "point_id long, edition int, importe_le date, commune string, annee string, type_local string, code_iris string, prix_m2 double"
MARCHE = "edition int, commune string, annee string, type_local string, n long, moyenne double, mediane double, p10 double, p90 double"
IRIS = "edition int, code_iris string, nom_iris string, type_local string, n long, moyenne double, mediane double, p10 double, p90 double"


@pytest.mark.parametrize("off", [1.0, 1.049, 1.051, 0.951, 0.949])
def test_found_at_the_tolerance(spark, off):
    v = [1000.0 + 7 * k for k in range(200)]
    pts = [(k, 1, None, "X", "2020", "Maison", "I" if k % 2 else None, x) for k, x in enumerate(v)]
    pts += pts[:40] + [(900, 1, None, "X", None, "Maison", None, 9e6), (901, 1, None, "X", "2020", "Maison", None, None), (902, 1, None, "X", "2020", "Maison", None, float("nan"))]
    q10, q50, q90 = np.quantile(v, [0.1, 0.5, 0.9])
    i10, i50, i90 = np.quantile(v[1::2], [0.1, 0.5, 0.9])
    m = spark.createDataFrame([(1, "X", "2020", "Maison", 1, 0.0, float(q50 * off), float(q10), float(q90)), (1, "absent", "2020", "Maison", 1, 0.0, 1.0, 1.0, 1.0)], MARCHE)
    i = spark.createDataFrame([(1, "I", "n", "Maison", 1, 0.0, float(i50), float(i10), float(i90 * off))], IRIS)
    got = rows(quantiles.found(spark.createDataFrame(pts, POINTS), m, i))
    assert got == ([("agg_iris", 1, "I", "", "Maison"), ("agg_marche", 1, "X", "2020", "Maison")] if abs(off - 1) > 0.05 else [])


def test_found_on_empty(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert quantiles.found(e(POINTS), e(MARCHE), e(IRIS)).count() == 0


def test_one_hash_for_one_and_many():
    x = np.array([0, 1, 77, 2**40], dtype=np.uint64)
    assert [int(v) for v in quantiles._mix(x, 12345)] == [quantiles._mix_one(int(v), 12345) for v in x]


def test_cells_about_which_nothing_is_known(spark):
    r = np.random.default_rng(8)
    groups = {"A": r.lognormal(8, 0.6, 500), "B": r.normal(0, 1e4, 300), "C": np.array([5.0]), "D": np.repeat([-3.0, 0.0, 7.5], [5, 1, 4]), "E": np.array([1e300, -1e300, 1e-300, 0.0])}
    pts = spark.createDataFrame([(k, 1, None, g, "2020", "Maison", None, float(x)) for g, v in groups.items() for k, x in enumerate(v)], POINTS)
    cells = pts.selectExpr("'agg_marche' AS mart", "edition", "commune AS lieu", "annee", "type_local").distinct()
    got = {r["lieu"]: (r["x_p10"], r["x_mediane"], r["x_p90"]) for r in quantiles._by_classes(pts, cells).collect()}
    assert {g: pytest.approx(np.quantile(v, [0.1, 0.5, 0.9])) for g, v in groups.items()} == got
    # brackets that miss lead there
    wrong = cells.selectExpr("*", "CAST(1 AS BIGINT) AS n", *[f"{x}D AS {p}_{e}" for p in quantiles.PROBABILITIES for e, x in (("low", 1), ("high", 2))]).drop("n").join(pts.groupBy(F.col("commune").alias("lieu")).agg(F.count(F.lit(1)).alias("n")), "lieu")
    again = {r["lieu"]: (r["x_p10"], r["x_mediane"], r["x_p90"]) for r in quantiles.exact_percentiles(pts, wrong).collect()}
    assert {g: pytest.approx(np.quantile(v, [0.1, 0.5, 0.9])) for g, v in groups.items()} == again


def test_the_sketch_decides_what_it_can(spark):
    v = [1000.0 + 7 * k for k in range(200)]
    pts = spark.createDataFrame([(k, 1, None, c, "2020", "Maison", None, x) for c in "ABCD" for k, x in enumerate(v)], POINTS)
    q = np.quantile(v, [0.1, 0.5, 0.9])
    m = spark.createDataFrame([(1, c, "2020", "Maison", 1, 0.0, float(q[1] * off), float(q[0]), float(q[2])) for c, off in (("A", 1.0), ("B", 1.3), ("C", 1.0501), ("D", 0.7))] + [(1, "A", "2020", "Maison", 1, 0.0, None, None, None)], MARCHE)
    judged = quantiles.judge_cells(pts, m, spark.createDataFrame([], IRIS))
    assert rows(judged.select("lieu", "verdict")) == [("A", "right"), ("A", "right"), ("B", "wrong"), ("C", "open"), ("D", "wrong")]


def test_nulls_tell_cells_apart(spark):
    pts = spark.createDataFrame([(k, e, None, c, "2020", t, None, 1000.0 * (1 + "AB".index(c)) + k) for c in "AB" for e in (1, None) for t in ("Maison", None) for k in range(30)], POINTS)
    got = {tuple(r[c] for c in quantiles.CELL): r["n"] for r in quantiles.cell_percentiles(pts).collect()}
    assert len(got) == 8 and set(got.values()) == {30}
    # as in SQL, a published cell with a null is none of the points' cells
    m = spark.createDataFrame([(None, "A", "2020", "Maison", 1, 0.0, 1.0, 1.0, 1.0), (1, "A", "2020", None, 1, 0.0, 1.0, 1.0, 1.0), (1, "B", "2020", "Maison", 1, 0.0, 1.0, 1.0, 1.0)], MARCHE)
    assert rows(quantiles.found(pts, m, spark.createDataFrame([], IRIS))) == [("agg_marche", 1, "B", "2020", "Maison")]
