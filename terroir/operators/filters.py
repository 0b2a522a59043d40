"""Filters whose criteria are optional, and the predicates they are made of.

A predicate is null where a value is null, which ``where`` drops; without a guard it can be pushed to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.text import label_group, registry_town


def in_range(c: Column, lo=None, hi=None) -> Column:
    """lo <= c <= hi; an absent bound excludes nothing; null passes only if both are absent."""
    tests = ([c >= lo] if lo is not None else []) + ([c <= hi] if hi is not None else [])
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def equals(c: Column, value) -> Column:
    return F.lit(True) if value is None else c == value


def town_of_iris(c: Column) -> Column:
    """The town's code: the first five characters; null of blank."""
    return F.when(c != "", F.substring(c, 1, 5))


def filter_market(rows: DataFrame, commune=None, type_local=None, year_from=None, year_to=None) -> DataFrame:
    return rows.where(equals(F.col("commune"), commune) & equals(F.col("type_local"), type_local) & in_range(F.col("annee"), year_from, year_to))


def filter_iris(rows: DataFrame, town=None, type_local=None) -> DataFrame:
    return rows.where(equals(town_of_iris(F.col("code_iris")), town) & equals(F.col("type_local"), type_local))


def selection(commune=None, type_local=None, date_from=None, date_to=None, group=None) -> Column:
    """Predicate of a user's selection over linked lots or points."""
    return equals(F.col("commune"), commune) & equals(F.col("type_local"), type_local) & equals(label_group(F.col("etiquette_dpe")), group) & in_range(F.col("date_mutation"), date_from, date_to)


def perimeter(towns: DataFrame, department=None) -> DataFrame:
    """The towns of the perimeter (nom, code_insee, departement), of one department if given."""
    return towns.where(equals(F.col("departement"), department))


def town_choices(towns: DataFrame) -> DataFrame:
    """nom, code_insee, dvf_nom: each town by its display name, its code and its name in the sales registry."""
    return towns.select("nom", "code_insee", registry_town(F.col("nom")).alias("dvf_nom"))
