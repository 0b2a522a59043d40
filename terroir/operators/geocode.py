"""Joining rows with a cache of looked-up addresses.

"Looked up, nothing found" (a cache row with null coordinates) is not "never looked up" (no cache row). Only
distinct missing addresses are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.functions.text import geocode_key


def geocode(rows: DataFrame, cache: DataFrame, address: str = "adresse_geocodage") -> DataFrame:
    """The rows with lat, lon and statut_geocodage: no_address, found, not_found or missing. cache: cle, lat, lon."""
    known = cache.groupBy("cle").agg(F.max(F.struct("lat", "lon")).alias("_g"), F.lit(True).alias("_hit"))
    keyed = rows.drop("lat", "lon").withColumn("cle", geocode_key(F.col(address)))
    blank = F.coalesce(F.col("cle"), F.lit("")) == ""
    status = F.when(blank, "no_address").when(F.col("_hit").isNull(), "missing").when(F.col("_g.lat").isNull() | F.col("_g.lon").isNull(), "not_found").otherwise("found")
    return keyed.join(known, "cle", "left").withColumns({"lat": F.col("_g.lat"), "lon": F.col("_g.lon"), "statut_geocodage": status}).drop("cle", "_g", "_hit")


def to_look_up(rows: DataFrame, cache: DataFrame, address: str = "adresse_geocodage") -> DataFrame:
    """cle: distinct addresses the cache does not know."""
    keys = rows.select(geocode_key(F.col(address)).alias("cle")).where(F.coalesce(F.col("cle"), F.lit("")) != "").distinct()
    return keys.join(cache.select("cle").distinct(), "cle", "left_anti")
