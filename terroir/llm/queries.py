"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terroir.llm import addresses, entities, leakage, mojibake, quantiles, survivors, tokenizer
from terroir.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(table(spark, sf_dir, "dvf_dpe_matched"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values of every lot, also of lots with one row."""
    return survivors.certificate_survivors(table(spark, sf_dir, "dvf_dpe_matched")).select("lot_id", "base_id", "numero_dpe", "etiquette_dpe", "periode_construction")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.found(*(table(spark, sf_dir, t) for t in ("points_marche", "agg_marche", "agg_iris")))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch percentiles and brackets of every cell."""
    return quantiles.cell_percentiles(table(spark, sf_dir, "points_marche"))


def p2_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles of every cell and whether the brackets of its sketch hold them."""
    return quantiles.bracketed(table(spark, sf_dir, "points_marche"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.found(table(spark, sf_dir, "dvf_dpe_matched"), table(spark, sf_dir, "dpe_clean"))


def p3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the rule that made them and its confidence."""
    return entities.cascade(table(spark, sf_dir, "dvf_dpe_matched"), table(spark, sf_dir, "dpe_clean"))


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the cascade with the precision measured of each."""
    return entities.rules(table(spark, sf_dir, "dvf_dpe_matched"), table(spark, sf_dir, "dpe_clean"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.found(table(spark, sf_dir, "dvf_clean"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location of every writing of every lot: one row each, whatever the number of lots at a location."""
    return addresses.classes(table(spark, sf_dir, "dvf_clean"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with the chain each went through and the restored text."""
    return mojibake.detect(table(spark, sf_dir, "documents")).select("doc_id", "chain", "restored")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_percentiles, p2_brackets, p3_found, p3_cascade, p3_rules, p5_found, p5_classes, p7_ids, p8_found, p9_found, p9_restored)}


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NUMBER = f"regexp_full_match(upper({_TRIM.format('numero_dpe')}), '9[0-9]{{2}}[A-Z][0-9]{{8}}[A-Z]')"
_LABEL = f"regexp_full_match(upper({_TRIM.format('etiquette_dpe')}), '[A-G]')"
_PERIOD = f"lower({_TRIM.format('periode_construction')}) IN ({', '.join(repr(p) for p in survivors.PERIODS)})"


_CELLS = """
              SELECT 'agg_marche' AS mart, edition, commune AS lieu, annee, type_local, point_id, min(prix_m2) AS prix_m2 FROM points_marche
              WHERE annee IS NOT NULL AND commune IS NOT NULL AND prix_m2 IS NOT NULL AND NOT isnan(prix_m2) GROUP BY ALL
              UNION ALL
              SELECT 'agg_iris', edition, code_iris, '', type_local, point_id, min(prix_m2) FROM points_marche
              WHERE code_iris IS NOT NULL AND prix_m2 IS NOT NULL AND NOT isnan(prix_m2) GROUP BY ALL"""


def _first(value: str, usable: str) -> str:
    return f"arg_max({value}, (coalesce(confiance, -2147483648), coalesce(epoch_us(apparie_le), -9223372036854775808), match_id)) FILTER ({usable})"


def oracle_sql() -> dict[str, str]:
    cell = "quantile_cont(prix_m2, {}) "
    return {
        "p1_found": f"""
            SELECT lot_id, coalesce({_first('match_id', _NUMBER)}, 0) AS match_numero, coalesce({_first('match_id', _LABEL)}, 0) AS match_etiquette,
                   coalesce({_first('match_id', _PERIOD)}, 0) AS match_periode
            FROM dvf_dpe_matched WHERE lot_id IS NOT NULL GROUP BY lot_id HAVING count(DISTINCT match_id) > 1""",
        "p1_survivors": f"""
            SELECT lot_id, {_first('match_id', 'true')} AS base_id, {_first(f"upper({_TRIM.format('numero_dpe')})", _NUMBER)} AS numero_dpe,
                   {_first(f"upper({_TRIM.format('etiquette_dpe')})", _LABEL)} AS etiquette_dpe, {_first(f"lower({_TRIM.format('periode_construction')})", _PERIOD)} AS periode_construction
            FROM dvf_dpe_matched WHERE lot_id IS NOT NULL GROUP BY lot_id""",
        "p2_brackets": f"""
            WITH p AS ({_CELLS})
            SELECT mart, edition, lieu, annee, type_local, count(*) AS n, round({cell.format(0.1)}, 3) AS p10, round({cell.format(0.5)}, 3) AS mediane, round({cell.format(0.9)}, 3) AS p90,
                   true AS p10_dedans, true AS mediane_dedans, true AS p90_dedans
            FROM p GROUP BY mart, edition, lieu, annee, type_local""",
        "p2_found": f"""
            WITH p AS ({_CELLS}),
            e AS (SELECT mart, edition, lieu, annee, type_local, {cell.format(0.1)} AS e10, {cell.format(0.5)} AS e50, {cell.format(0.9)} AS e90 FROM p GROUP BY ALL),
            c AS (SELECT 'agg_marche' AS mart, edition, commune AS lieu, annee, type_local, p10, mediane, p90 FROM agg_marche
                  UNION ALL SELECT 'agg_iris', edition, code_iris, '', type_local, p10, mediane, p90 FROM agg_iris)
            SELECT DISTINCT mart, edition, lieu, annee, type_local FROM c JOIN e USING (mart, edition, lieu, annee, type_local)
            WHERE abs(p10 - e10) > 0.05 * abs(e10) OR abs(mediane - e50) > 0.05 * abs(e50) OR abs(p90 - e90) > 0.05 * abs(e90)""",
    }
