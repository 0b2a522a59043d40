"""Best representative of each duplicate group: skyline selection with fills from dominance layers.

Every record of a group is a point in four dimensions: which fields it can supply (a set), how much
it is trusted, how recent it is, and its id, which only breaks ties of recency. A record dominates
another if it supplies at least the same fields, is trusted at least as much and comes later in
(recency, id). Layer 1 holds the undominated records, layer 2 those dominated only by layer 1, and so
on. The policy orders records by (trust, recency, id), descending; each field comes from the first
record by policy in the lowest layer that supplies it.

Why this is exact: the first record by policy among those that supply a field cannot be dominated by
any record, since its dominator would supply the field too and precede it. It therefore sits in
layer 1, whatever the other fields do. Fills from layer 2 on therefore never happen as long as completeness is the set of fields; with
their number as completeness they would, but a field could then come from a record that is less trusted than another that supplies it.

Scale: a group of any size is first reduced, map-side, to its best record per (supplied fields,
trust grade); a record that loses there is dominated by a record that supplies the same fields and
can never fill anything. So at most 2^fields x trust grades records of a group meet in one task, even
if one group holds a third of all rows. Trust is a scale of few grades, any number among them; the result stays right with
many, but the reduction then bites less.

Defined results: rows with a null key or a null id are ignored; null trust is the lowest grade and null
recency the earliest time; a row delivered twice (same id) counts once; a group with no usable value
for a field gets a null source (``0`` in ``p1_found``); empty input gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The periods of construction a certificate may name.
PERIODS = ("avant 1948", "1948-1974", "1975-1977", "1978-1982", "1983-1988", "1989-2000", "2001-2005", "2006-2012", "2013-2021", "après 2021")

_EARLIEST, _LOWEST = -(2**63), float("-inf")


def trimmed(c: Column) -> Column:
    """The text without any surrounding white space, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def usable_number(c: Column) -> Column:
    return F.coalesce(F.upper(trimmed(c)).rlike(r"^9[0-9]{2}[A-Z][0-9]{8}[A-Z]$"), F.lit(False))


def usable_label(c: Column) -> Column:
    return F.coalesce(F.upper(trimmed(c)).rlike(r"^[A-G]$"), F.lit(False))


def usable_period(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*PERIODS), F.lit(False))


def _micros(rows: DataFrame, c: Column) -> Column:
    """A time as a number. Times without a zone are not sent through the session's zone, whose clock changes would reorder them."""
    if not isinstance(rows.select(c.alias("c")).schema["c"].dataType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    within = F.hour(c) * 3600 + F.minute(c) * 60
    return (F.unix_date(c.cast("date")).cast("long") * 86_400 + within) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def skyline_survivors(rows: DataFrame, key: str, row_id: str, fields: dict[str, tuple[Column, Column]], trust: Column, recency: Column, least_rows: int = 1) -> DataFrame:
    """One row per group: ``key``, ``n_candidates``, ``base_id`` (the undominated record first by policy)
    and for each field ``<field>``, ``<field>_from`` (id of the supplying record) and ``<field>_layer``.

    fields: name -> (value, usable). recency: any orderable timestamp. least_rows: 1 or 2, the distinct
    records a group must have.
    """
    bit = {f: 1 << i for i, f in enumerate(fields)}
    mask = reduce(lambda a, b: a + b, (F.when(ok, F.lit(bit[f])).otherwise(F.lit(0)) for f, (_, ok) in fields.items()))
    lean = rows.where(F.col(key).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(key).alias("k"),
        F.col(row_id).cast("long").alias("id"),
        mask.alias("mask"),
        F.coalesce(trust.cast("double"), F.lit(_LOWEST)).alias("trust"),
        F.coalesce(_micros(rows, recency), F.lit(_EARLIEST)).alias("recency"),
        F.struct(*[F.when(ok, v).alias(f) for f, (v, ok) in fields.items()]).alias("v"),
    )
    graded = lean.groupBy("k", "mask", "trust").agg(F.max(F.struct("recency", "id", "v")).alias("best"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    group = graded.groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("trust", F.col("best.recency").alias("recency"), F.col("best.id").alias("id"), "mask", F.col("best.v").alias("v"))), asc=False).alias("by_policy"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    if least_rows > 1:
        group = group.where(F.col("lo") < F.col("hi"))

    def dominates(a: Column, b: Column) -> Column:
        later = (a["recency"] > b["recency"]) | ((a["recency"] == b["recency"]) & (a["id"] > b["id"]))
        return (a["mask"].bitwiseAND(b["mask"]) == b["mask"]) & (a["trust"] >= b["trust"]) & later

    def layer_of(done: Column, x: Column) -> Column:
        above = F.filter(done, lambda a: dominates(a["r"], x))
        return F.coalesce(F.array_max(F.transform(above, lambda a: a["layer"])), F.lit(0)) + 1

    # a dominator precedes what it dominates in the order by policy, so one pass gives every layer
    record = group.schema["by_policy"].dataType.elementType.simpleString()
    layered = group.withColumn(
        "layered",
        F.aggregate("by_policy", F.array().cast(f"array<struct<layer:int,r:{record}>>"), lambda done, x: F.concat(done, F.array(F.struct(layer_of(done, x).cast("int").alias("layer"), x.alias("r"))))),
    )

    def source(f: str) -> Column:
        able = F.filter("layered", lambda a: a["r"]["mask"].bitwiseAND(F.lit(bit[f])) != 0)
        lowest = F.array_min(F.transform(able, lambda a: a["layer"]))
        return F.try_element_at(F.filter(able, lambda a: a["layer"] == lowest), F.lit(1))

    picked = layered.select("k", F.size("by_policy").alias("n_candidates"), F.col("by_policy")[0]["id"].alias("base_id"), *[source(f).alias(f"s_{i}") for i, f in enumerate(fields)])
    out = [F.col("k").alias(key), "n_candidates", "base_id"]
    for i, f in enumerate(fields):
        s = F.col(f"s_{i}")
        out += [s["r"]["v"][f].alias(f), s["r"]["id"].alias(f"{f}_from"), s["layer"].alias(f"{f}_layer")]
    return picked.select(*out)


def certificate_survivors(matched: DataFrame, least_rows: int = 1) -> DataFrame:
    """The surviving certificate number, label and period of each lot of the linked table."""
    n, e, p = F.col("numero_dpe"), F.col("etiquette_dpe"), F.col("periode_construction")
    fields = {
        "numero_dpe": (F.upper(trimmed(n)), usable_number(n)),
        "etiquette_dpe": (F.upper(trimmed(e)), usable_label(e)),
        "periode_construction": (F.lower(trimmed(p)), usable_period(p)),
    }
    return skyline_survivors(matched, "lot_id", "match_id", fields, F.col("confiance"), F.col("apparie_le"), least_rows)


def found(matched: DataFrame) -> DataFrame:
    """lot_id, match_numero, match_etiquette, match_periode of every lot with two or more rows."""
    source = lambda f: F.coalesce(F.col(f"{f}_from"), F.lit(0)).cast("long")
    return certificate_survivors(matched, least_rows=2).select(
        F.col("lot_id").cast("long").alias("lot_id"), source("numero_dpe").alias("match_numero"), source("etiquette_dpe").alias("match_etiquette"), source("periode_construction").alias("match_periode")
    )
