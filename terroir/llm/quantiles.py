"""Percentiles of very large numeric columns by mergeable dyadic Count-sketches.

Values are encoded on a logarithmic scale of ``2**bits`` codes between ``low`` and ``high``. Every binary
resolution of the codes (level j has 2**j intervals) is kept: exactly while it has no more intervals
than a sketch has counters, above that as a signed Count-sketch of ``depth`` rows and ``width`` counters. Sketches
of separate partitions, files or days are merged by adding counters, and a row is deleted by adding it
with weight -1. A rank is inverted by descending the levels: at each one the count of the left half decides
whether to go left or right.

Error: a value is known to one code (a factor of (high/low)**(2**-bits), 0.03 % by default). A rank is off by at
most the noise of the sketched levels met on the way down, about sqrt(F2/width) each; F2 is estimated from the
sketch itself, so every answer carries its own bracket, at ``SIGMAS`` standard deviations.

Scale: partial sketches are built where the rows lie, one per (task, group), so a group with a third of all rows is spread like
any other. Few values travel as codes, many as counters of a fixed size. Partials are added in two rounds, so no task
adds more than a bounded number of them. Where rows must be told apart by an id, they are shuffled by (group, id), which spreads every group evenly.
Nothing is collected.

Defined results: null and NaN values and infinities are ignored; values outside [low, high] are counted in the first or
last code and answered as a bracket open on that side; null group keys form their own group; an empty group has no row; deletions beyond
what was added are the caller's error.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terroir.session import cut_lineage, partitions

#: Standard deviations of a rank that a bracket spans to either side.
SIGMAS = 5.0


@dataclass(frozen=True)
class Sketching:
    """The shape of a sketch; sketches are merged only with their own shape."""

    low: float = 1.0
    high: float = 1e8
    bits: int = 16
    width: int = 1024
    depth: int = 5
    seed: int = 7

    @property
    def step(self) -> float:
        return math.log(self.high / self.low) / ((1 << self.bits) - 2)

    @property
    def exact_levels(self) -> int:
        """Levels 0 .. this are exact."""
        return min(self.bits, int(math.log2(self.width * self.depth)))

    @property
    def size(self) -> int:
        return (1 << (self.exact_levels + 1)) + (self.bits - self.exact_levels) * self.depth * self.width

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Codes; 0 is below low, the last one is above high."""
        top = (1 << self.bits) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.floor(np.log(np.where(values > 0, values, self.low / 2) / self.low) / self.step) + 1
        return np.clip(np.where(values < self.low, 0, c), 0, top).astype(np.int64)

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest value a code stands for."""
        code = np.asarray(code)
        top = (1 << self.bits) - 1
        lo = np.where(code <= 0, -np.inf, self.low * np.exp((code - 1) * self.step))
        return lo, np.where(code >= top, np.inf, self.low * np.exp(code * self.step))

    def slots(self, node: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(counter, sign) of the nodes of a level, for each row of its sketch."""
        if level <= self.exact_levels:
            return [((1 << level) + node, np.ones(len(node), dtype=np.int64))]
        base = (1 << (self.exact_levels + 1)) + (level - self.exact_levels - 1) * self.depth * self.width
        out = []
        for row in range(self.depth):
            h = _mix(node.astype(np.uint64), self.seed * 1_000_003 + level * 101 + row)
            out.append((base + row * self.width + (h % np.uint64(self.width)).astype(np.int64), 1 - 2 * ((h >> np.uint64(63)).astype(np.int64))))
        return out

    def add(self, counters: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
        """Adds weighted codes to a sketch."""
        at, signed = [], []
        for level in range(self.bits + 1):
            for a, sign in self.slots(codes >> (self.bits - level), level):
                at.append(a)
                signed.append(weights * sign)
        counters += np.bincount(np.concatenate(at), weights=np.concatenate(signed), minlength=len(counters)).astype(np.int64)

    def build(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        codes, back = np.unique(codes, return_inverse=True)
        out = np.zeros(self.size, dtype=np.int64)
        if len(codes):
            self.add(out, codes, np.bincount(back, weights=weights))
        return out

    def count(self, counters: np.ndarray, node: int, level: int) -> float:
        if level <= self.exact_levels:
            return float(counters[(1 << level) + node])
        base = (1 << (self.exact_levels + 1)) + (level - self.exact_levels - 1) * self.depth * self.width
        seen = []
        for row in range(self.depth):
            h = _mix_one(node, self.seed * 1_000_003 + level * 101 + row)
            c = int(counters[base + row * self.width + h % self.width])
            seen.append(-c if h >> 63 else c)
        return float(median(seen))

    def noise(self, counters: np.ndarray) -> float:
        """Standard deviation of a rank: the noise of one count per sketched level, added as variances."""
        variance, start = 0.0, 1 << (self.exact_levels + 1)
        for level in range(self.exact_levels + 1, self.bits + 1):
            own = counters[start : start + self.depth * self.width].reshape(self.depth, self.width).astype(float)
            variance += float(np.median((own * own).sum(axis=1))) / self.width
            start += self.depth * self.width
        return math.sqrt(variance)

    def code_at(self, counters: np.ndarray, rank: float) -> int:
        """The code that holds the value of a rank (from 0). On exact levels a rank beyond the ends is that of the end;
        below them it keeps to its side, since counts are uncertain there."""
        upto = np.cumsum(counters[1 << self.exact_levels : 2 << self.exact_levels])
        node = int(np.searchsorted(upto, min(max(rank, 0.0), float(counters[1]) - 1), side="right"))
        left_of = float(upto[node - 1]) if node else 0.0
        for level in range(self.exact_levels + 1, self.bits + 1):
            node *= 2
            left = self.count(counters, node, level)
            if rank >= left_of + left:
                left_of += left
                node += 1
        return node

    def bracket(self, counters: np.ndarray, q: float) -> tuple[float, float, float]:
        """Estimate, least and greatest possible value of the linearly interpolated percentile q."""
        n = int(counters[1])
        if n <= 0:
            return math.nan, math.nan, math.nan
        at, spread = q * (n - 1), SIGMAS * self.noise(counters)
        low, high = (self.code_at(counters, r) for r in (math.floor(at) - spread, math.ceil(at) + spread))
        a, b = self.edges(np.array([low, high]))
        mid_lo, mid_hi = self.edges(np.array([self.code_at(counters, at)]))
        mid = float(np.clip(math.sqrt(max(mid_lo[0], self.low) * min(mid_hi[0], self.high)), self.low, self.high))
        return mid, float(a[0]), float(b[1])

    def pack_codes(self, codes: np.ndarray, weights: np.ndarray) -> bytes:
        """The partial of some distinct codes: the codes themselves while that is shorter, else counters."""
        if len(codes) * 12 > self.size:
            return self.pack(self.build(codes, weights))
        return zlib.compress(struct.pack("<cI", b"c", len(codes)) + codes.astype("<i4").tobytes() + weights.astype("<i8").tobytes(), 1)

    def pack(self, counters: np.ndarray) -> bytes:
        """Few counters as pairs, many as an array; compressed."""
        used = np.flatnonzero(counters)
        if 2 * len(used) < len(counters):
            return zlib.compress(struct.pack("<cI", b"s", len(used)) + used.astype("<i4").tobytes() + counters[used].astype("<i8").tobytes(), 1)
        return zlib.compress(struct.pack("<cI", b"d", len(counters)) + counters.astype("<i8").tobytes(), 1)

    def total(self, packed) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """The sum of packed sketches: distinct codes and weights while all of them are few, else counters."""
        codes, weights, counters = [np.empty(0, dtype=np.int64)], [np.empty(0)], None
        for data in packed:
            raw = zlib.decompress(data)
            kind, n = struct.unpack_from("<cI", raw)
            if kind == b"c":
                codes.append(np.frombuffer(raw, "<i4", n, 5).astype(np.int64))
                weights.append(np.frombuffer(raw, "<i8", n, 5 + 4 * n).astype(float))
                continue
            counters = np.zeros(self.size, dtype=np.int64) if counters is None else counters
            if kind == b"d":
                counters += np.frombuffer(raw, "<i8", n, 5)
            else:
                counters[np.frombuffer(raw, "<i4", n, 5)] += np.frombuffer(raw, "<i8", n, 5 + 4 * n)
        c, back = np.unique(np.concatenate(codes), return_inverse=True)
        w = np.bincount(back, weights=np.concatenate(weights), minlength=len(c))
        if counters is None:
            return c, w
        self.add(counters, c, w)
        return counters

    def repack(self, packed) -> tuple[int, bytes]:
        """n and the packed sum of packed sketches."""
        t = self.total(packed)
        return (int(t[1].sum()), self.pack_codes(*t)) if isinstance(t, tuple) else (int(t[1]), self.pack(t))

    def counters(self, packed) -> np.ndarray:
        """The sum of packed sketches as counters."""
        t = self.total(packed)
        return self.build(*t) if isinstance(t, tuple) else t


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), keyed by the seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def _mix_one(x: int, seed: int) -> int:
    """The same of one number."""
    whole = (1 << 64) - 1
    x = (x + seed * 0x9E3779B97F4A7C15) & whole
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & whole
    return x ^ (x >> 31)


#: Parameter: partial sketches of a group that one task adds, about.
FAN_IN = 64


def _columns(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def build_sketches(rows: DataFrame, group: list[str], value: str, shape: Sketching = Sketching(), weight: str | None = None, distinct_on: str | None = None) -> DataFrame:
    """Partial sketches: the group's columns, ``part`` and ``sketch`` (binary), to be merged.

    distinct_on: a row id; rows of a group that repeat it count once (the lowest value and weight).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    lean = rows.select(*group, F.col(value).cast("double").alias("_v"), w.alias("_w"), *([F.col(distinct_on).alias("_id")] if distinct_on else []))
    lean = lean.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    if distinct_on:
        lean = lean.groupBy(*group, "_id").agg(F.min("_v").alias("_v"), F.min("_w").alias("_w"))

    def partial(batches):
        """Distinct codes of each group met in the task with their weights; a partial per group at the end."""
        from pyspark import TaskContext

        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        pending: list[tuple[pd.DataFrame, np.ndarray, np.ndarray]] = []

        def settle():
            if not pending:
                return
            keys = pd.concat([k for k, _, _ in pending], ignore_index=True)
            codes, weights = (np.concatenate([p[i] for p in pending]) for i in (1, 2))
            pending.clear()
            for k, at in keys.groupby(group, dropna=False, sort=False).indices.items():
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
                c, w = codes[at], weights[at]
                if k in held:
                    c, w = np.concatenate([held[k][0], c]), np.concatenate([held[k][1], w])
                c, back = np.unique(c, return_inverse=True)
                held[k] = c, np.bincount(back, weights=w)

        for pdf in batches:
            pending.append((pdf[group], shape.encode(pdf["_v"].to_numpy()), pdf["_w"].to_numpy()))
            if sum(len(p[1]) for p in pending) >= 100_000:
                settle()
        settle()
        part = TaskContext.get().partitionId()
        yield from _in_batches(([*k, part, shape.pack_codes(c, w)] for k, (c, w) in held.items()), [*group, "part", "sketch"])

    return lean.select(*group, "_v", "_w").mapInPandas(partial, f"{_columns(rows.select(*group))}part int, sketch binary")


def merge_sketches(sketches: DataFrame, group: list[str], shape: Sketching = Sketching()) -> DataFrame:
    """One sketch per group (group, n, sketch), the sum of all; input from any number of tasks, files or days.

    A first round adds partials of tasks with the same number modulo the square root of what the session's width makes likely, a
    second one those sums; with few tasks one round does.
    """

    def adder(keys: list[str]):
        """Adds up the groups of a partition as they come; of each only a few packed partials are held."""

        def add_up(batches):
            held: dict[tuple, list[bytes]] = {}
            for pdf in batches:
                for *k, data in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                    own = held.setdefault(tuple(None if pd.isna(x) else x for x in k), [])
                    own.append(data)
                    if len(own) >= 16:
                        own[:] = [shape.repack(own)[1]]
            yield from _in_batches(([*k, *shape.repack(own)] for k, own in held.items()), [*keys, "n", "sketch"])

        return add_up

    width = partitions(sketches.sparkSession)
    some = sketches.select(*group, "part", "sketch")
    if width > FAN_IN:
        some = some.withColumn("part", F.pmod("part", F.lit(FAN_IN)).cast("int")).repartition(width, *group, "part")
        some = some.mapInPandas(adder([*group, "part"]), f"{_columns(sketches.select(*group))}part int, n long, sketch binary")
    return some.select(*group, "sketch").repartition(width, *group).mapInPandas(adder(group), f"{_columns(sketches.select(*group))}n long, sketch binary")


def _in_batches(rows, columns: list[str], size: int = 256):
    """Rows as frames of a few hundred: a frame per row would cost more than what is in it."""
    batch = []
    for r in rows:
        batch.append(r)
        if len(batch) >= size:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def percentiles(sketches: DataFrame, group: list[str], probabilities: dict[str, float], shape: Sketching = Sketching()) -> DataFrame:
    """For each name of ``probabilities``: ``<name>``, ``<name>_low``, ``<name>_high`` of every group's sketch."""
    names = [f"{p}{s}" for p in probabilities for s in ("", "_low", "_high")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.select(*group, "n").schema) + "".join(f", {x} double" for x in names)

    def invert(batches):
        for pdf in batches:
            answers = []
            for data in pdf["sketch"]:
                total = shape.counters([data])
                answers.append([x for q in probabilities.values() for x in shape.bracket(total, q)])
            yield pd.concat([pdf[[*group, "n"]].reset_index(drop=True), pd.DataFrame(answers, columns=names, dtype=float)], axis=1)

    return sketches.select(*group, "n", "sketch").mapInPandas(invert, schema)


CELL = ["mart", "edition", "lieu", "annee", "type_local"]
PROBABILITIES = {"p10": 0.1, "mediane": 0.5, "p90": 0.9}


def cell_points(points: DataFrame) -> DataFrame:
    """Each point once per mart it belongs to: its cell, point_id and price. Points without the year
    (or neighbourhood) belong to no cell of that mart."""
    mart = lambda name, place, year, has: F.when(has, F.struct(F.lit(name).alias("mart"), F.col(place).alias("lieu"), year.alias("annee")))
    market = mart("agg_marche", "commune", F.col("annee"), F.col("annee").isNotNull() & F.col("commune").isNotNull())
    iris = mart("agg_iris", "code_iris", F.lit(""), F.col("code_iris").isNotNull())
    return (
        points.where(F.col("prix_m2").isNotNull() & ~F.isnan("prix_m2"))
        .select("edition", "type_local", "point_id", "prix_m2", F.explode(F.array_compact(F.array(market, iris))).alias("c"))
        .select("c.mart", "edition", "c.lieu", "c.annee", "type_local", "point_id", "prix_m2")
    )


def published_cells(agg_marche: DataFrame, agg_iris: DataFrame) -> DataFrame:
    a = agg_marche.select(F.lit("agg_marche").alias("mart"), "edition", F.col("commune").alias("lieu"), "annee", "type_local", *[F.col(p).alias(f"pub_{p}") for p in PROBABILITIES])
    b = agg_iris.select(F.lit("agg_iris").alias("mart"), "edition", F.col("code_iris").alias("lieu"), F.lit("").alias("annee"), "type_local", *[F.col(p).alias(f"pub_{p}") for p in PROBABILITIES])
    return a.unionByName(b).dropDuplicates()


HASH = ["h1", "h2"]


def _cell_hash() -> list[Column]:
    """128 bits that stand for a cell: among a billion of cells, two share them with a chance of about 10**-21."""
    parts = ["mart", F.coalesce("edition", F.lit(-(2**31))), "lieu", "annee", F.coalesce("type_local", F.lit("\u0000"))]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("cell"), *parts).alias("h2")]


def _by_hash(points: DataFrame, shape: Sketching) -> DataFrame:
    """h1, h2, n and the sketch percentiles of every cell. Points travel under the hash of their cell, not its columns; infinite prices count as the greatest
    or least number."""
    most = F.lit(1e308)
    lean = cell_points(points).select(*_cell_hash(), "point_id", F.greatest(F.least("prix_m2", most), -most).alias("prix_m2"))
    parts = build_sketches(lean, HASH, "prix_m2", shape, distinct_on="point_id")
    return percentiles(merge_sketches(parts, HASH, shape), HASH, PROBABILITIES, shape)


def cell_percentiles(points: DataFrame, shape: Sketching = Sketching()) -> DataFrame:
    """Sketch percentiles, with brackets, of every cell of both marts."""
    cells = cell_points(points).select(*CELL).distinct()
    return cells.select(*CELL, *_cell_hash()).join(_by_hash(points, shape), HASH).drop(*HASH)


def _between(low: Column, high: Column, p: str) -> Column:
    """(percentile, value) of a value at or below the upper bound of its bracket; below the lower one the value is null: it is only counted."""
    v = F.col("v")
    return F.when(v <= high, F.struct(F.lit(p).alias("p"), F.when(v < low, F.lit(None).cast("double")).otherwise(v).alias("v")))


def _interpolated(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """CELL and x_<p>, linearly interpolated; ``counted``: CELL, p, v, c, where the rows with null v stand before all others. x_<p> is null unless both ranks
    it lies between are held by rows with a value."""
    names = list(PROBABILITIES)
    w = Window.partitionBy(*CELL, "p").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(w)).join(sizes, CELL)
    q = F.create_map(*[x for p, prob in PROBABILITIES.items() for x in (F.lit(p), F.lit(prob))])[F.col("p")]
    at = q * (F.col("n") - 1)
    lies = lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c"))
    two = ranked.groupBy(*CELL, "p", "n").agg(F.max(F.when(lies(F.floor(at)), F.col("v"))).alias("a"), F.max(F.when(lies(F.ceil(at)), F.col("v"))).alias("b"))
    part = at - F.floor(at)
    return two.select(*CELL, "p", F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part).alias("x")).groupBy(*CELL).agg(*[F.max(F.when(F.col("p") == p, F.col("x"))).alias(f"x_{p}") for p in names])


def _distinct_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """CELL, point_id, v of the points of some cells, each once; the columns of ``cells`` beside CELL are kept. Few cells travel to the scan."""
    kept = [c for c in cells.columns if c not in CELL]
    return cell_points(points).join(cells, CELL).groupBy(*CELL, "point_id", *kept).agg(F.min("prix_m2").alias("v"))


def exact_percentiles(points: DataFrame, brackets: DataFrame) -> DataFrame:
    """CELL and the exact percentiles x_<p> of the cells of ``brackets`` (with n, <p>_low and <p>_high), linearly interpolated.

    Of all points of a cell only the number below a bracket and the few values inside it are needed, so no task sees a whole cell. Should a
    bracket not hold the ranks sought, the cell's points are counted by class of value first (``_by_classes``).
    """
    names = list(PROBABILITIES)
    bounds = brackets.select(*CELL, "n", *[f"{p}_{s}" for p in names for s in ("low", "high")])
    placed = _distinct_points(points, bounds.drop("n")).select(*CELL, F.explode(F.array_compact(F.array(*[_between(F.col(f"{p}_low"), F.col(f"{p}_high"), p) for p in names]))).alias("x"))
    one = cut_lineage(_interpolated(placed.groupBy(*CELL, "x.p", "x.v").agg(F.count(F.lit(1)).alias("c")), bounds.select(*CELL, "n")))
    good = F.lit(True)
    for p in names:
        good = good & F.col(f"x_{p}").isNotNull()
    lost = cut_lineage(bounds.select(*CELL).join(one.where(good), CELL, "left_anti"))
    return one.where(good) if lost.isEmpty() else one.where(good).unionByName(_by_classes(points, lost))


def _by_classes(points: DataFrame, cells: DataFrame, bits: int = 20) -> DataFrame:
    """CELL and x_<p> of cells about whose values nothing is known: values are counted by class, and only those of
    the classes that hold a rank sought are told apart. A task sees the counts of a cell's classes or the values of a few of them, not the cell."""
    names = list(PROBABILITIES)
    mine = cut_lineage(_distinct_points(points, cells))
    # classes keep the order of the values: they are even on a logarithmic scale on both sides of zero, infinities apart
    order = F.when(F.col("v") == 0, 0.0).otherwise(F.signum("v") * F.log1p(F.abs("v")))
    rank_class = F.when(F.abs(F.col("v")) == float("inf"), F.signum("v") * F.lit(float(1 << 62))).otherwise(F.floor(order * ((1 << bits) / 1024))).cast("double")
    classed = mine.withColumn("g", rank_class)
    size = mine.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*CELL).orderBy("g")
    classes = classed.groupBy(*CELL, "g").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w)).join(size, CELL)
    wanted = None
    for p, prob in PROBABILITIES.items():
        at = F.lit(prob) * (F.col("n") - 1)
        ends = [(r < F.col("upto")) & (r >= F.col("upto") - F.col("c")) for r in (F.floor(at), F.ceil(at))]
        own = classes.groupBy(*CELL).agg(F.min(F.when(ends[0], F.col("g"))).alias("lo"), F.max(F.when(ends[1], F.col("g"))).alias("hi")).withColumn("p", F.lit(p))
        wanted = own if wanted is None else wanted.unionByName(own)
    met = classed.join(wanted, CELL).where(F.col("g") <= F.col("hi"))
    counted = met.groupBy(*CELL, "p", F.when(F.col("g") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return _interpolated(counted, size).select(*CELL, *[f"x_{p}" for p in names])


def found(points: DataFrame, agg_marche: DataFrame, agg_iris: DataFrame, tolerance: float = 0.05, shape: Sketching = Sketching()) -> DataFrame:
    """Published cells of which a percentile is off by more than the tolerance of the true one.

    The sketches decide: a cell is wrong if one of its figures is off from every value the bracket allows, and right if all are within the tolerance of
    every one. Only where the limit of the tolerance falls inside a bracket are the cell's exact percentiles computed, inside the brackets.
    """
    judged = cut_lineage(judge_cells(points, agg_marche, agg_iris, tolerance, shape))
    told = judged.where("verdict = 'wrong'").select(*CELL)
    open_cells = judged.where("verdict = 'open'")
    if open_cells.isEmpty():
        return told.distinct()
    exact = exact_percentiles(points, open_cells.dropDuplicates(CELL))
    off = lambda p: F.coalesce(F.abs(F.col(f"pub_{p}") - F.col(f"x_{p}")) > tolerance * F.abs(F.col(f"x_{p}")), F.lit(False))
    wrong = off("p10") | off("mediane") | off("p90")
    return told.unionByName(open_cells.join(exact, CELL).where(wrong).select(*CELL)).distinct()


def judge_cells(points: DataFrame, agg_marche: DataFrame, agg_iris: DataFrame, tolerance: float = 0.05, shape: Sketching = Sketching()) -> DataFrame:
    """Published cells that have points, with their figures, the sketches' brackets and ``verdict``: wrong, right or open. A figure that is not published is
    right whatever the points."""

    def verdict(p: str) -> Column:
        low, high, pub = F.col(f"{p}_low"), F.col(f"{p}_high"), F.col(f"pub_{p}")
        # values of either sign: the limits of the tolerance lie on either side of the value, the wider the larger it is
        outer = (pub > high + tolerance * F.abs(high)) | (pub < low - tolerance * F.abs(low))
        inner = (low > -math.inf) & (high < math.inf) & (pub <= low + tolerance * F.abs(low)) & (pub >= high - tolerance * F.abs(high))
        return F.when(pub.isNull() | inner, 0).when(outer, 2).otherwise(1)

    # a published cell without mart, place or year is none of the points'
    cells = published_cells(agg_marche, agg_iris).dropna(subset=CELL)
    cells = cells.select("*", *_cell_hash()).join(_by_hash(points, shape), HASH).drop(*HASH)
    worst = F.greatest(*[verdict(p) for p in PROBABILITIES])
    return cells.withColumn("verdict", F.when(worst == 2, "wrong").when(worst == 1, "open").otherwise("right"))


def bracketed(points: DataFrame, shape: Sketching = Sketching()) -> DataFrame:
    """CELL, n, the exact percentiles of every cell and whether the sketch's brackets hold them."""
    sketched = cut_lineage(cell_percentiles(points, shape))
    both = sketched.join(exact_percentiles(points, sketched), CELL)
    inside = [(F.col(f"x_{p}").between(F.col(f"{p}_low"), F.col(f"{p}_high"))).alias(f"{p}_dedans") for p in PROBABILITIES]
    return both.select(*CELL, "n", *[F.round(f"x_{p}", 3).alias(p) for p in PROBABILITIES], *inside)
