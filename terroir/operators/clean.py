"""Cleaning of raw sale lots and certificates: parse, classify, normalise, count.

Each batch is one projection; its counters are one small aggregate over the same frame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.constants import REFORM
from terroir.functions.text import compose_address, geocoding_query, normalize_address, parse_french_decimal


def town_code(department: Column, town: Column) -> Column:
    """Department and town number, the latter padded to three digits."""
    return F.concat(department, F.lpad(town, 3, "0"))


def in_perimeter(department: Column, town: Column, codes: Iterable[str]) -> Column:
    return town_code(department, town).isin(*codes)


def row_class(price: Column, area: Column) -> Column:
    """excluded_zero_price before excluded_zero_surface before kept; null counts as zero."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return F.when(zero(price), "excluded_zero_price").when(zero(area), "excluded_zero_surface").otherwise("kept")


def project_raw(raw: DataFrame) -> DataFrame:
    """The columns of a raw vintage under their working names, the date parsed."""
    names = {
        "Identifiant de document": "identifiant_document", "No disposition": "no_disposition", "Nature mutation": "nature_mutation", "Valeur fonciere": "valeur_fonciere", "No voie": "no_voie", "B/T/Q": "btq", "Type de voie": "type_voie",
        "Voie": "voie", "Code postal": "code_postal", "Commune": "commune", "Type local": "type_local", "Nombre pieces principales": "nombre_pieces_principales", "Surface reelle bati": "surface_reelle_bati",
    }
    return raw.select(F.to_date("Date mutation", "dd/MM/yyyy").alias("date_mutation"), town_code(F.col("Code departement"), F.col("Code commune")).alias("code_insee"), *[F.col(a).alias(b) for a, b in names.items()])


def clean_lots(raw: DataFrame) -> DataFrame:
    """Raw lots (working names) with price, area, addresses and ``classe``; excluded rows stay, marked."""
    price, area = parse_french_decimal(F.col("valeur_fonciere")), parse_french_decimal(F.col("surface_reelle_bati"))
    whole = compose_address(F.col("no_voie"), F.col("btq"), F.col("type_voie"), F.col("voie"))
    return (
        raw.withColumns({"prix": price, "surface": area, "adresse_brute": whole})
        .withColumns({"adresse_normalisee": normalize_address(F.col("adresse_brute")), "classe": row_class(F.col("prix"), F.col("surface"))})
        .drop("valeur_fonciere", "surface_reelle_bati", "no_voie", "btq", "type_voie", "voie")
    )


def class_counts(rows: DataFrame, column: str = "classe") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def date_class(c: Column, cutoff: str = REFORM) -> Column:
    """missing_date, invalid_date, post_reform or pre_reform of a date text."""
    shaped = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.when(F.coalesce(c, F.lit("")) == "", "missing_date").when(shaped.isNull(), "invalid_date").when(c >= cutoff, "post_reform").otherwise("pre_reform")


def clean_certificates(raw: DataFrame, cutoff: str = REFORM, raw_address: str = "adresse_brut", postcode: str = "code_postal_brut", town: str = "nom_commune_brut") -> DataFrame:
    """Certificates with their normalised address, geocoding query and ``classe`` of date; all rows stay, marked. The query is made of the fields as
    declared, never of those an earlier geocoding gave: it is what is to be geocoded."""
    return raw.withColumns(
        {
            "adresse_normalisee": normalize_address(F.col(raw_address)),
            "adresse_geocodage": geocoding_query(F.col(raw_address), F.col(postcode), F.col(town), trim_postcode=False),
            "classe": date_class(F.col("date_etablissement_dpe"), cutoff),
        }
    )


def latest_delivery(rows: DataFrame, key: str = "lot_id", received: str = "recu_le") -> DataFrame:
    """One row per key, the one received last; rows received at once are told apart by all their columns. A reduction that
    combines map-side, so a key delivered any number of times is no hot task."""
    others = [c for c in rows.columns if c not in (key, received)]
    best = F.max(F.struct(received, *others)).alias("r")
    return rows.groupBy(key).agg(best).select(key, *[F.col("r")[c].alias(c) for c in (received, *others)]).select(*rows.columns)
