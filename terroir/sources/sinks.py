"""Writers: declared columns, typed tables, deterministic files, JSON cubes, slim GeoJSON, caches and stage skips."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terroir.sources import places

#: The columns published of the linked lots; decimals of a cube's figures.
PUBLISHED = ("commune", "code_insee", "no_disposition", "nature_mutation", "date_mutation", "type_local", "surface", "prix", "match_status", "etiquette_dpe")
DECIMALS = {"moyenne": 1, "mediane": 1, "somme": 1, "pct": 2}


def conform(df: DataFrame, columns: Mapping[str, str], as_text: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared columns in their types and order; absent ones are null."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        return (c.cast("string") if name in as_text else c).cast(kind).alias(name)

    return df.select(*[one(n, k) for n, k in columns.items()])


def write_table(df: DataFrame, path: str, columns: Mapping[str, str] | None = None, as_text: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """A Parquet table, replaced as a whole."""
    out = conform(df, columns, as_text) if columns else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def in_total_order(df: DataFrame, columns: Sequence[str] = PUBLISHED) -> DataFrame:
    """The columns, rows ordered by all of them: two runs give the same rows in the same places. A range sort, in parallel."""
    return df.select(*columns).orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def publish(tables: Mapping[str, DataFrame], linked: DataFrame, folder: str, copies: Mapping[str, str] | None = None) -> list[dict]:
    """Writes aggregates as they are, the linked lots projected and ordered, and copies of files; name, rows and bytes of each."""
    out = []
    for name, df in [*tables.items(), ("dvf_dpe_matched", in_total_order(linked))]:
        place = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").parquet(place)
        out.append({"name": name, "rows": df.sparkSession.read.parquet(place).count(), "bytes": places.size(place)})
    for name, source in (copies or {}).items():
        places.copy(source, f"{folder}/{name}")
        out.append({"name": name, "rows": None, "bytes": places.size(f"{folder}/{name}")})
    return out


def cube_lines(df: DataFrame, decimals: Mapping[str, int] = DECIMALS, other: int = 4) -> DataFrame:
    """One column ``value``: each row as JSON with sorted keys, figures rounded by name, nulls kept."""
    rounded = [(F.round(f.name, decimals.get(f.name, other)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*rounded), {"ignoreNullFields": "false"}).alias("value"))


def write_cube(df: DataFrame, path: str) -> None:
    cube_lines(df).write.mode("overwrite").text(path)


def slim_geometry(geometry: Column, digits: int = 5) -> Column:
    """A GeoJSON geometry with its coordinates rounded."""
    ring = "array<array<array<double>>>"
    r = lambda a: F.transform(a, lambda line: F.transform(line, lambda p: F.transform(p, lambda x: F.round(x, digits))))
    one = F.from_json(geometry, f"struct<type:string,coordinates:{ring}>")
    many = F.from_json(geometry, f"struct<type:string,coordinates:array<{ring}>>")
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Polygon", F.to_json(F.struct(kind.alias("type"), r(one["coordinates"]).alias("coordinates")))).when(
        kind == "MultiPolygon", F.to_json(F.struct(kind.alias("type"), F.transform(many["coordinates"], r).alias("coordinates")))
    )


def slim_features(polygons: DataFrame, properties: Sequence[str] = ("code_iris", "nom_iris", "code_insee", "nom_commune")) -> DataFrame:
    """The properties a map reads (absent ones null) and the rounded geometry."""
    kept = [F.col(c) if c in polygons.columns else F.lit(None).cast("string").alias(c) for c in properties]
    return polygons.select(*kept, slim_geometry(F.col("geometry")).alias("geometry"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_atomically(df: DataFrame, path: str, key: str) -> None:
    """A cache rewritten as a whole, by key: first beside its place, then moved there. The version before stays as ``<path>.old`` until the next time, where
    ``load_cache`` finds it should it look between the two moves, so a reader sees the old or the new one."""
    new, old = f"{path}.new", f"{path}.old"
    df.orderBy(key).write.mode("overwrite").parquet(new)
    if places.exists(path):
        places.remove(old)
        places.move(path, old)
    places.move(new, path)


def load_cache(spark, path: str, schema: str) -> DataFrame:
    """A cache table; an absent or empty place is an empty cache. While it is being replaced the version before is read."""
    place = next((p for p in (path, f"{path}.old") if places.exists(p, spark)), None)
    if place is None or places.size(place, spark) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(place)


def stage(spark, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at the path; built and written only if it is not there yet with rows in it (or ``force``)."""
    written = places.exists(f"{path}/_SUCCESS", spark) or (places.exists(path, spark) and path.endswith(".parquet") and places.size(path, spark) > 0)
    if force or not written or spark.read.parquet(path).isEmpty():
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def vintage_missing(folder: str, year: int) -> bool:
    """Whether a vintage's partition has yet to be fetched."""
    return not places.exists(f"{folder}/year={year}")
