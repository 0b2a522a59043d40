"""Readers: Parquet by projection, raw vintages, JSON lines, GeoJSON; schema guards and source resolution."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terroir.functions.text import resource_year
from terroir.sources import places

#: Columns of a raw vintage that later steps read, and those that tell one from an error page.
REQUIRED = (
    "Identifiant de document", "No disposition", "Date mutation", "Nature mutation", "Valeur fonciere", "No voie", "B/T/Q", "Type de voie", "Voie", "Code postal", "Commune",
    "Code departement", "Code commune", "Type local", "Nombre pieces principales", "Surface reelle bati",
)
SENTINELS = ("Date mutation", "Nature mutation", "Valeur fonciere", "Code departement", "Code commune")
ALIASES = {"Code service CH": "Identifiant de document"}


def read_columns(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Only the columns named; the projection reaches the scan. Paths may be folders, globs or several."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself; raises and names what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}; present: {sorted(df.columns)}")
    return df


def alias_columns(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Renamed columns; raises if a column and its new name are both there."""
    for old, new in aliases.items():
        if old in df.columns and new in df.columns:
            raise ValueError(f"both {old!r} and {new!r} are present")
    return df.withColumnsRenamed(dict(aliases))


def check_header(line: str) -> None:
    """Raises unless the line is a pipe-delimited header with the sentinel columns."""
    names = {x.strip() for x in line.split("|")}
    if "|" not in line or (missing := [s for s in SENTINELS if s not in names]):
        raise ValueError(f"not a vintage header: {line[:100]!r}" + (f", missing {missing}" if "|" in line else ""))


def read_vintage(spark: SparkSession, path: str, codes: Sequence[str] | None = None) -> DataFrame:
    """A pipe-delimited text with a header, every column as text, under the official names; towns limited to ``codes`` if given."""
    first = spark.read.text(path).limit(1).collect()
    check_header(first[0]["value"] if first else "")
    df = require_columns(alias_columns(spark.read.csv(path, sep="|", header=True)), REQUIRED)
    if codes is None:
        return df
    from terroir.operators.clean import in_perimeter

    return df.where(in_perimeter(F.col("Code departement"), F.col("Code commune"), codes))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line by a declared schema; blank lines are skipped, keys not declared are not read."""
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).names
    return spark.read.schema(schema).json(path).where(" OR ".join(f"`{c}` IS NOT NULL" for c in names))


def unzip_single(path: str, folder: str) -> str:
    """The only member of an archive, extracted; raises if there are none or several."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if len(names) != 1:
            raise ValueError(f"{path} holds {len(names)} files, not one")
        return z.extract(names[0], folder)


def list_vintages(catalog: DataFrame, wanted: str = "txt.zip") -> DataFrame:
    """year, url, title of the catalog's files of the wanted format that name a year and a place, by year."""
    year = resource_year(F.col("title"))
    return catalog.where((F.col("format") == wanted) & year.isNotNull() & (F.coalesce("url", F.lit("")) != "")).select(year.alias("year"), "url", "title").orderBy("year", "title")


#: The last edition of the historical mirror that holds a vintage, and the extension of its files.
EDITIONS = {2016: ("202110", "txt"), 2017: ("202204", "txt"), 2018: ("202304", "txt"), 2019: ("202404", "txt"), 2020: ("202504", "txt.zip")}


def historical_years(editions: Mapping[int, tuple[str, str]] = EDITIONS) -> tuple[int, ...]:
    """The vintages the mirror holds, in order."""
    return tuple(sorted(editions))


def vintage_url(year: int, editions: Mapping[int, tuple[str, str]], base: str) -> str:
    """Place of a vintage in a mirror whose editions each hold some years; an unknown year raises."""
    if year not in editions:
        raise ValueError(f"no edition holds {year}; known: {sorted(editions)}")
    edition, extension = editions[year]
    return f"{base}/{edition}/valeursfoncieres-{year}.{extension}"


_FEATURE = "struct<properties:map<string,string>,geometry:string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """pos, code_iris, nom_iris, code_insee, nom_commune, geometry (JSON text) of a FeatureCollection, in its order."""
    whole = spark.read.text(path, wholetext=True)
    features = F.from_json("value", f"struct<features:array<{_FEATURE}>>")["features"]
    each = whole.select(F.posexplode(features).alias("pos", "f"))
    p = F.col("f.properties")
    return each.select("pos", *[p[c].alias(c) for c in ("code_iris", "nom_iris", "code_insee", "nom_commune")], F.col("f.geometry").alias("geometry"))


def resolve_sources(live: Mapping[str, str], snapshot: Mapping[str, str]) -> dict[str, str]:
    """The live files if every one exists, else all of the snapshot: never a mixture."""
    return dict(live) if all(places.exists(p) for p in live.values()) else dict(snapshot)
