"""Folding the lots of a sale into one price point per square metre.

A sale is (date, town code, disposition, price), nulls being values like others. All quantities of a sale are
aggregates that combine map-side, so a sale of any number of lots is no hot task: with extra keys, lots are first reduced to one row per (sale,
extra keys) and only those meet.

Reasons a sale has no point, first match: ``sans_habitation`` (no dwelling lot), ``mixte`` (other built lots, or both kinds of
dwelling; a null type with an area counts as other), ``nature`` (not among ``natures``), ``inexploitable`` (no area or no price), ``hors_bande``.
A point carries the columns of its lot with the smallest id, so the result does not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terroir.constants import CERTAIN, DWELLINGS, NATURES, OUTBUILDING, PRICE_BAND, REFORM, status_set
from terroir.functions.text import sale_year

SALE = ("date_mutation", "code_insee", "no_disposition", "prix")
REASONS = ("sans_habitation", "mixte", "nature", "inexploitable", "hors_bande")


def sales(lots: DataFrame, lot_id: str = "lot_id", extra: Sequence[str] = (), carry: Sequence[str] = ("commune", "type_local"), natures: Sequence[str] = NATURES, band: tuple[float, float] = PRICE_BAND) -> DataFrame:
    """One row per (sale, extra keys of its dwelling lots) and one per sale without a point: the sale's key,
    extra and carried columns, ``prix_m2``, ``annee``, ``n_lots``, ``motif`` (null for a point) and ``principal`` (true once per sale)."""
    kind = F.col("type_local")
    home = F.coalesce(kind.isin(*DWELLINGS), F.lit(False))
    other = ~home & ~F.coalesce(kind == OUTBUILDING, F.lit(False)) & (F.coalesce("surface", F.lit(0.0)) > 0)
    keys = [*SALE, *[e for e in extra if e not in SALE]]
    own = [F.when(home, F.col(e)).alias(e) for e in extra if e not in SALE]
    lean = lots.select(*SALE, *own, home.alias("_home"), other.alias("_other"), F.when(home, kind).alias("_kind"), F.when(home, F.col("surface")).alias("_s"), F.when(home, F.struct(F.col(lot_id).alias("_id"), F.col("nature_mutation").alias("_nature"), *[F.col(c) for c in carry])).alias("_first"))
    parts = [F.count_if("_home").alias("_n"), F.sum("_s").alias("_area"), F.min("_kind").alias("_k0"), F.max("_kind").alias("_k1"), F.max("_other").alias("_other"), F.min("_first").alias("_first")]
    if keys == list(SALE):  # a sale is one row: its aggregates are all there is
        whole = lean.groupBy(*SALE).agg(*parts).select("*", F.col("_n").alias("n_lots"), F.col("_area").alias("_total"), F.col("_k0").alias("_kmin"), F.col("_k1").alias("_kmax"), F.col("_other").alias("_built"), F.col("_first")["_nature"].alias("_nature"), F.lit(1).alias("_rank"), (F.col("_n") > 0).alias("_home"))
    else:
        w = Window.partitionBy(*SALE)
        whole = lean.groupBy(*keys, "_home").agg(*parts).select(
            "*", F.sum("_n").over(w).alias("n_lots"), F.sum("_area").over(w).alias("_total"), F.min("_k0").over(w).alias("_kmin"), F.max("_k1").over(w).alias("_kmax"), F.max("_other").over(w).alias("_built"),
            F.min("_first").over(w)["_nature"].alias("_nature"), F.row_number().over(w.orderBy(F.col("_home").desc(), F.col("_first").asc_nulls_last())).alias("_rank"),
        )
    price = F.try_divide(F.col("prix"), F.col("_total"))
    reason = (
        F.when(F.col("n_lots") == 0, "sans_habitation").when(F.col("_built") | (F.col("_kmin") != F.col("_kmax")), "mixte")
        .when(~F.coalesce(F.col("_nature").isin(*natures), F.lit(False)), "nature").when(price.isNull(), "inexploitable").when(~price.between(*band), "hors_bande")
    )
    out = whole.withColumn("motif", reason).where((F.col("_rank") == 1) | (F.col("_home") & F.col("motif").isNull()))
    carried = [F.col("_first")[c].alias(c) for c in carry if c not in keys]
    return out.select(*keys, *carried, F.when(F.col("motif").isNull(), price).alias("prix_m2"), sale_year(F.col("date_mutation").cast("string")).alias("annee"), "n_lots", "motif", (F.col("_rank") == 1).alias("principal"))


def points(lots: DataFrame, **how) -> DataFrame:
    """The price points alone."""
    return sales(lots, **how).where(F.col("motif").isNull()).drop("motif", "principal")


def exclusions(lots: DataFrame, **how) -> DataFrame:
    """One row: n_mutations, n_points (of distinct sales) and a counter per reason, which add up."""
    s = sales(lots, **how).where(F.col("principal"))
    return s.agg(F.count(F.lit(1)).alias("n_mutations"), F.count_if(F.col("motif").isNull()).alias("n_points"), *[F.count_if(F.col("motif") == r).alias(r) for r in REASONS])


def impact_points(lots: DataFrame, lot_id: str = "match_id", carry: Sequence[str] = ("commune", "type_local"), **how) -> DataFrame:
    """One point per (sale, label, status)."""
    return points(lots, lot_id=lot_id, extra=("etiquette_dpe", "match_status"), carry=carry, **how)


def certain(statuses: Sequence[str] = CERTAIN) -> Column:
    return F.coalesce(F.col("match_status").isin(*status_set(statuses)), F.lit(False))


def after(cutoff: str = REFORM) -> Column:
    """Dated at the cutoff or later; a null date is not."""
    return F.coalesce(F.col("date_mutation"), F.lit("")) >= cutoff


def impact_rows(all_points: DataFrame, cutoff: str = REFORM, statuses: Sequence[str] = CERTAIN) -> DataFrame:
    # written without guards against null, which ``where`` drops anyway, so that over a table both tests reach the scan
    return all_points.where(F.col("match_status").isin(*status_set(statuses)) & (F.col("date_mutation") >= cutoff))


def impact_counts(all_points: DataFrame, cutoff: str = REFORM, statuses: Sequence[str] = CERTAIN, keep: Column | None = None) -> DataFrame:
    """One row: n_points (before ``keep``), etiquette_certaine, retenues, resolu_consensus, pre_reforme (after it).
    Points without a date count as before the reform."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    sure, inside = kept & certain(statuses), kept & certain(statuses) & after(cutoff)
    return all_points.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(sure).alias("etiquette_certaine"), F.count_if(inside).alias("retenues"),
        F.count_if(inside & (F.col("match_status") == "resolu_consensus")).alias("resolu_consensus"), F.count_if(sure & ~inside).alias("pre_reforme"),
    )
