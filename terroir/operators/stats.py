"""Group statistics, distributions and histograms.

Counts, sums and means combine map-side. For exact medians Spark keeps a count per distinct value of a group in one task: ``aggregate_by`` is meant for many
groups, ``aggregate_few`` for few and large ones, of which it tells apart only the values around the median. Percentiles of a whole column are
read off a distributed sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terroir.session import cut_lineage


#: Parameter: groups whose classes may travel with the tasks.
FEW_GROUPS = 10_000


def aggregate_by(rows: DataFrame, keys: Sequence[str], value: str = "prix_m2") -> DataFrame:
    """keys, n, moyenne, mediane. Null values do not count; a group without values has no row; a null key is a group."""
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("moyenne"), F.median(value).alias("mediane"))


def _class_of(v: Column, bits: int) -> Column:
    """Classes in the order of the values, even on a logarithmic scale on both sides of zero; infinities apart."""
    scaled = F.floor(F.signum(v) * F.log1p(F.abs(v)) * ((1 << bits) / 1024.0)).cast("double")
    return F.when(F.abs(v) == float("inf"), F.signum(v) * F.lit(1e18)).otherwise(scaled)


def aggregate_few(rows: DataFrame, keys: Sequence[str], value: str = "prix_m2", bits: int = 18) -> DataFrame:
    """The same as ``aggregate_by`` where a group may hold any share of the rows: values are counted by class first, map-side, and only those of the classes that
    hold the middle ranks are told apart. NaN values count as greatest, as in ``F.median``."""
    kept = cut_lineage(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    classed = kept.withColumn("_g", F.when(F.isnan("_v"), F.lit(2e18)).otherwise(_class_of(F.col("_v"), bits)))
    sums = classed.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_g")
    placed = sums.withColumns({"_n": F.sum("_c").over(group), "_upto": F.sum("_c").over(order)})
    middle = lambda n, upto, c: [(r < upto) & (r >= upto - c) for r in (F.floor((n - 1) / 2), F.ceil((n - 1) / 2))]
    lo, hi = middle(F.col("_n"), F.col("_upto"), F.col("_c"))
    whole = placed.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("moyenne"), F.min(F.when(lo, F.col("_g"))).alias("_lo"), F.max(F.when(hi, F.col("_g"))).alias("_hi"), F.max(F.when(lo, F.col("_upto") - F.col("_c"))).alias("_before"))
    whole = cut_lineage(whole)
    few = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("n").alias("_n"), "_lo", "_hi", "_before")
    few = F.broadcast(few) if few.count() <= FEW_GROUPS else few
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = classed.join(few, same).where(F.col("_g").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_n", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")))
    a, b = middle(F.col("_n"), F.col("_upto"), F.col("_c"))
    median = near.groupBy(*keys).agg(((F.max(F.when(a, F.col("_v"))) + F.max(F.when(b, F.col("_v")))) / 2).alias("mediane"))
    out = whole.select(*keys, "n", "moyenne").alias("l").join(median.alias("r"), reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]))
    return out.select(*[F.col(f"l.{k}").alias(k) for k in keys], "n", "moyenne", "mediane")


def ordered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By the keys, nulls last."""
    return rows.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n; nulls are counted as a value."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n by descending n, ties by the keys."""
    return count_by(rows, *keys).orderBy(F.col("n").desc(), *[F.col(k).asc_nulls_last() for k in keys])


def sorted_table(rows: DataFrame, key: str, descending: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """By one column in either direction, nulls last in both; ties by other columns."""
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return rows.orderBy(first, *[F.col(c).asc_nulls_last() for c in then])


def span(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, debut, fin."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("debut"), F.max(value).alias("fin"))


def values_at(rows: DataFrame, value: str, places: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, float]]:
    """n, and the values at the given places (from 0) of all non-null values in order.

    The values are range-partitioned by a distributed sort; only the sizes of the partitions and the few values asked for
    reach the driver.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).orderBy("v").withColumn("part", F.spark_partition_id())
    kept = cut_lineage(v)
    sizes = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, start, wanted = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        wanted += [(part, p - start, p) for p in sorted(set(places(n))) if start <= p < start + sizes[part]]
        start += sizes[part]
    if not wanted:
        return n, {}
    # sizes of equal values within the partitions concerned, so that ranking needs no row per value
    counted = kept.where(F.col("part").isin(sorted({w[0] for w in wanted}))).groupBy("part", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("bis", F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    asked = rows.sparkSession.createDataFrame(wanted, "part int, i long, place long")
    hit = upto.join(asked, "part").where((F.col("i") < F.col("bis")) & (F.col("i") >= F.col("bis") - F.col("c")))
    return n, {r["place"]: r["v"] for r in hit.select("place", "v").collect()}


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, moyenne, minimum, maximum, p50, p75, p90, p95, p99, linearly interpolated; nulls where there is no value. Exact at any size."""
    probabilities = (50, 75, 90, 95, 99)
    at = lambda n, q: q / 100 * (n - 1)
    n, v = values_at(rows, value, lambda n: [p for q in probabilities for p in (floor(at(n, q)), ceil(at(n, q)))] if n else [])
    point = lambda q: None if not n else v[floor(at(n, q))] + (v[ceil(at(n, q))] - v[floor(at(n, q))]) * (at(n, q) - floor(at(n, q)))
    one = rows.agg(F.count(value).alias("n"), F.avg(value).alias("moyenne"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return one.select("*", *[F.lit(point(q)).cast("double").alias(f"p{q}") for q in probabilities])


def histogram(rows: DataFrame, value: str, edges: Sequence[tuple[str, float | None]]) -> DataFrame:
    """rang, tranche, n: each value in the first bucket whose upper bound it does not exceed (None: no bound);
    empty buckets stay with 0."""
    c = F.col(value)
    rank = F.when(F.lit(False), 0)
    for k, (_, top) in enumerate(edges):
        rank = rank.when(c.isNotNull() if top is None else c <= top, k)
    counted = rows.select(rank.alias("rang")).groupBy("rang").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(edges)], "rang int, tranche string")
    return every.join(counted, "rang", "left").select("rang", "tranche", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy_by(rows: DataFrame, value: str, correct: str, edges: Sequence[float]) -> DataFrame:
    """bas, haut, n, exactitude by half-open buckets [bas, haut); an empty bucket has n = 0 and 0.0."""
    bounds = list(zip(edges, edges[1:]))
    every = rows.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bounds)], "k int, bas double, haut double")
    bucket = F.when(F.lit(False), 0)
    for k, (lo, hi) in enumerate(bounds):
        bucket = bucket.when((F.col(value) >= lo) & (F.col(value) < hi), k)
    counted = rows.select(bucket.alias("k"), F.col(correct).cast("int").alias("ok")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("exactitude"))
    return every.join(counted, "k", "left").select("bas", "haut", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("exactitude", F.lit(0.0)).alias("exactitude"))


def value_range(rows: DataFrame, value: str) -> DataFrame:
    """One row: zmin, zmax, null without values."""
    return rows.agg(F.min(value).alias("zmin"), F.max(value).alias("zmax"))


def class_edges(rows: DataFrame, value: str, classes: int = 7) -> DataFrame:
    """One row: bornes, the distinct values at places floor(i n / classes) of the sorted ones, i = 1 .. classes - 1."""
    _, v = values_at(rows, value, lambda n: [i * n // classes for i in range(1, classes)] if n else [])
    edges = F.array(*[F.lit(x) for x in sorted(set(v.values()))]).cast("array<double>")
    return rows.sparkSession.range(1).select(edges.alias("bornes"))


def share(part: Column, whole: Column) -> Column:
    """Percent; 0 of nothing is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)
