import random
from datetime import datetime

from pyspark.sql import functions as F

from terroir.llm import survivors
from tests.conftest import rows

SCHEMA = "match_id long, lot_id long, numero_dpe string, etiquette_dpe string, periode_construction string, confiance int, apparie_le timestamp"
N, E, P = "900A00000001B", "D", "1948-1974"


def brute(data):
    import re

    ok = {
        2: lambda v: bool(v) and re.fullmatch(r"9\d\d[A-Z]\d{8}[A-Z]", v.strip().upper()), 3: lambda v: bool(v) and re.fullmatch("[A-G]", v.strip().upper()), 4: lambda v: bool(v) and v.strip().lower() in survivors.PERIODS,
    }
    out = []
    for lot in {r[1] for r in data if r[1] is not None}:
        own = {r[0]: r for r in data if r[1] == lot and r[0] is not None}.values()
        if len(own) > 1:
            best = lambda k: max(((r[5] if r[5] is not None else -1, r[6] or datetime(1, 1, 1), r[0]) for r in own if ok[k](r[k])), default=(0, 0, 0))[2]  # noqa: B023, E731
            out.append((lot, best(2), best(3), best(4)))
    return sorted(out, key=str)


def test_found_equals_brute_force(spark):
    r = random.Random(4)
    num, lab, per = [None, "", "NEANT", N, " " + N.lower() + "\t"], [None, "?", "D", " e ", "H"], [None, "0", P, "AVANT 1948 ", "après 2021"]
    data = [(k, r.choice([None, *range(60)]), r.choice(num), r.choice(lab), r.choice(per), r.choice([None, 1, 3, 5]), r.choice([None, datetime(2024, 1, 1), datetime(2025, 1, r.randint(1, 3))])) for k in range(1, 400)]
    data += [(None, 3, N, E, P, 5, None)] + data[:30]
    assert rows(survivors.found(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_layers(spark):
    t = datetime(2025, 1, 1)
    data = [(1, 7, N, None, None, 5, t), (2, 7, N, E, None, 3, t), (3, 7, N, E, None, 2, t), (4, 7, None, None, P, 1, t)]
    df = spark.createDataFrame(data, SCHEMA)
    r = survivors.certificate_survivors(df).first()
    assert (r["base_id"], r["numero_dpe_from"], r["etiquette_dpe_from"], r["periode_construction_from"]) == (1, 1, 2, 4)
    assert (r["numero_dpe_layer"], r["etiquette_dpe_layer"], r["periode_construction_layer"]) == (1, 1, 1)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert survivors.found(none).count() == 0
    one = spark.createDataFrame([(1, 1, N, E, P, 3, None), (1, 1, N, E, P, 3, None)], SCHEMA)
    assert survivors.found(one).count() == 0 and survivors.certificate_survivors(one).count() == 1
    junk = spark.createDataFrame([(1, 1, "x" * 100_000, None, "", None, None), (2, 1, None, None, None, None, None)], SCHEMA)
    clash = junk.withColumns({"k": F.lit(1), "mask": F.lit(2), "trust": F.lit(3), "best": F.lit(4)})
    assert rows(survivors.found(clash)) == [(1, 0, 0, 0)]


def test_one_hot_group(spark):
    hot = spark.range(20_000).selectExpr("id + 1 AS match_id", "5L AS lot_id", f"IF(id % 2 = 0, '{N}', NULL) AS numero_dpe", "'D' AS etiquette_dpe", "CAST(NULL AS STRING) AS periode_construction", "CAST(id % 5 AS INT) AS confiance", "timestamp_seconds(id) AS apparie_le")
    assert rows(survivors.found(hot)) == [(5, 19_995, 20_000, 0)]


def test_times_without_zone_keep_their_order(spark):
    data = [(k, 1, N, E, P, 3, datetime(2024, 10, 27, 2, 30, 0, 10 - k)) for k in range(1, 5)] + [(9, 2, N, E, P, 3, datetime(1969, 12, 31, 23, 59, 59, 999_999)), (8, 2, N, E, P, 3, datetime(1970, 1, 1))]
    ntz = spark.createDataFrame(data, SCHEMA.replace("apparie_le timestamp", "apparie_le timestamp_ntz"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Paris"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows(survivors.found(ntz)) == [(1, 1, 1, 1), (2, 8, 8, 8)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_trust_is_any_number(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.4), (1, 2, "b", 0.9), (1, 3, "c", 0.89), (1, 4, "d", None), (2, 5, "e", -3.5), (2, 6, "f", None)], "k int, id long, v string, t double")
    out = survivors.skyline_survivors(df, "k", "id", {"v": (F.col("v"), F.lit(True))}, F.col("t"), F.lit(None).cast("timestamp"))
    assert rows(out.select("k", "v", "v_from")) == [(1, "b", 2), (2, "e", 5)]
