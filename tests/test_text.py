import unicodedata

import pytest
from pyspark.sql import functions as F

from terroir.functions import text

CASES = [
    ("12 r. de la Paix", "12 RUE DE LA PAIX"), ("5 AV. DU GAL LECLERC", "5 AVENUE DU GENERAL LECLERC"), ("BD STE ANNE", "BOULEVARD SAINTE ANNE"), ("AVENUE SAINT", "AVENUE SAINT"), ("  3\t rue\n d’Été ", "3 RUE D'ETE"),
    ("ST-JEAN-DE-LUZ", "SAINT-JEAN-DE-LUZ"), ("Œuvre", "ŒUVRE"), ("ça et là", "CA ET LA"), ("naïf", "NAIF"), ("", ""), ("   ", ""), (None, ""), ("ﬁlature", "FILATURE"), ("nº 5", "NO 5"), ("RESTE", "RESTE"), ("x" * 50_000, "X" * 50_000),
]


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_normalize_address(spark):
    assert one(spark, text.normalize_address(F.col("v")), *[a for a, _ in CASES]) == [b for _, b in CASES]


def test_normalize_is_idempotent(spark):
    once = [b for _, b in CASES]
    assert one(spark, text.normalize_address(F.col("v")), *once) == once


def test_folding_equals_the_unicode_rule(spark):
    letters = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    got = one(spark, text.fold_accents(F.col("v")), *letters)
    assert [(a, g) for a, g, w in zip(letters, got, want) if g != w and w.isascii() and w.isalpha()] == []


@pytest.mark.parametrize(
    "raw, value",
    [("273400,00", 273400.0), ("51", 51.0), (" 1,5 ", 1.5), ("", None), ("  ", None), ("abc", None), (None, None), ("0,00", 0.0), ("1.0d", None), ("1,2,3", None), ("-3,5", -3.5)],
)
def test_french_decimal(spark, raw, value):
    assert one(spark, text.parse_french_decimal(F.col("v")), raw) == [value]


def test_small_functions(spark):
    assert one(spark, text.label_group(F.col("v")), " a", "D ", "e", "G", "Z", "", None) == ["A-C", "D", "E", "F-G", None, None, None]
    assert one(spark, text.registry_town(F.col("v")), "Saint-Pierre-d'Irube", "Guéthary", None) == ["SAINT-PIERRE-D IRUBE", "GUETHARY", None]
    assert one(spark, text.sale_year(F.col("v")), "2021-03-04", "", None, "20") == ["2021", None, None, "20"]
    assert one(spark, text.resource_year(F.col("v")), "Valeurs 2025", "Notice", None, "1999 and 2016 2017") == [2025, None, None, 2016]
    assert one(spark, text.signed_percent(F.col("v")), 3.14, -2.0, 0.0, schema="v double") == ["+3.1 %", "−2.0 %", "+0.0 %"]
    assert one(spark, text.geocode_key(F.col("v")), "  3  Rue\tX ", None) == ["3 rue x", None]
    assert one(spark, text.window_label(F.col("v"), F.lit(None).cast("int"), F.lit(2016)), 1, 5, 9, schema="v int") == ["1 an", "5 ans", "depuis 2016"]


def test_compose_and_query(spark):
    df = spark.createDataFrame([("12", " B ", "RUE", "DE L'EAU"), (None, "", " ", None)], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(text.compose_address(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == ["12 B RUE DE L'EAU", ""]
    q = spark.createDataFrame([("1  rue", " 64100 ", "X"), (" ", "64100", "X"), (None, "64100", "X"), ("1 rue", "", None)], "a string, b string, c string")
    assert [r[0] for r in q.select(text.geocoding_query(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["1 rue 64100 X", None, None, "1 rue"]
