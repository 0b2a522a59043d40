import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terroir.constants import DISTANCE_EDGES, status_set
from terroir.operators import clean, scoring, stats
from terroir.plans import marts
from tests.conftest import rows


def frame(spark, values, schema="v double"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_aggregate_by(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0), ("b", None)], "k string, prix_m2 double")
    assert rows(stats.ordered(stats.aggregate_by(df, ["k"]), ["k"])) == sorted([("a", 2, 2.5, 2.5), (None, 1, 2.0, 2.0)], key=str)
    assert [r["k"] for r in stats.ordered(stats.aggregate_by(df, ["k"]), ["k"]).collect()] == ["a", None]


@pytest.mark.parametrize("values", [[], [7.0], [float(k) for k in range(1, 101)], [3.0] * 50 + [1.0, None]])
def test_distribution(spark, values):
    r = stats.distribution(frame(spark, values), "v").first()
    kept = [v for v in values if v is not None]
    assert r["n"] == len(kept) and (r["minimum"], r["maximum"]) == ((min(kept), max(kept)) if kept else (None, None))
    for q in (50, 75, 90, 95, 99):
        assert r[f"p{q}"] == (pytest.approx(float(np.quantile(kept, q / 100))) if kept else None)


def test_values_at_with_ties(spark):
    r = random.Random(9)
    v = [float(r.randrange(40)) for _ in range(3000)]
    n, got = stats.values_at(frame(spark, v).repartition(7), "v", lambda n: [0, n // 3, n // 2, n - 1])
    assert n == 3000 and got == {p: sorted(v)[p] for p in (0, 1000, 1500, 2999)}


def test_histogram_and_accuracy(spark):
    h = stats.histogram(frame(spark, [0.0, 0.1, 5.0, 5.1, 15.0, 1000.0, None]), "v", DISTANCE_EDGES)
    assert [r["n"] for r in h.orderBy("rang").collect()] == [1, 2, 2, 0, 0, 0, 1]
    a = stats.accuracy_by(spark.createDataFrame([(0.0, True), (0.25, False), (0.3, True), (9.0, True)], "v double, ok boolean"), "v", "ok", (0.0, 0.25, 0.5, 1.0))
    assert [(r["n"], r["exactitude"]) for r in a.orderBy("bas").collect()] == [(1, 1.0), (2, 0.5), (0, 0.0)]


def test_class_edges(spark):
    v = [float(k) for k in range(20)] + [3.0] * 5
    s = sorted(v)
    assert stats.class_edges(frame(spark, v), "v").first()["bornes"] == sorted({s[i * len(s) // 7] for i in range(1, 7)})
    assert stats.class_edges(frame(spark, []), "v").first()["bornes"] == []
    assert rows(stats.value_range(frame(spark, [None, 2.0, 1.0]), "v")) == [(1.0, 2.0)] and rows(stats.value_range(frame(spark, []), "v")) == [(None, None)]


def test_date_class(spark):
    values = ["2021-07-01", "2021-06-30", None, "", "2021/07/01", "2021-07", "2021-02-30", "2021-07-01T00:00"]
    got = [r[0] for r in frame(spark, values, "v string").select(clean.date_class(F.col("v"))).collect()]
    assert got == ["post_reform", "pre_reform", "missing_date", "missing_date", *["invalid_date"] * 4]


def test_row_class_and_perimeter(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 5.0), (1.0, None), (1.0, 2.0)], "p double, s double")
    assert [r[0] for r in df.select(clean.row_class(F.col("p"), F.col("s"))).collect()] == ["excluded_zero_price", "excluded_zero_price", "excluded_zero_surface", "kept"]
    t = spark.createDataFrame([("64", "9"), ("64", "122"), ("40", "1")], "d string, c string")
    assert t.where(clean.in_perimeter(F.col("d"), F.col("c"), ["64009", "40001"])).count() == 2


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "2020", "a"), (1, "2021", "b"), (1, "2021", "c"), (2, None, "d"), (None, "2020", "e")], "lot_id int, recu_le string, v string")
    assert rows(clean.latest_delivery(df)) == sorted([(1, "2021", "c"), (2, None, "d"), (None, "2020", "e")], key=str)


def test_matching_rate(spark):
    df = spark.createDataFrame([(s,) for s in ["trouve"] * 3 + ["ambigu"]], "match_status string")
    assert [(r["status"], r["n"], r["pct"]) for r in marts.matching_rate(df).orderBy("rang").collect()] == [("trouve", 3, 75.0), ("resolu_consensus", 0, 0.0), ("non_trouve", 0, 0.0), ("ambigu", 1, 25.0), ("etiquette_certaine", 3, 75.0)]
    assert {r["pct"] for r in marts.matching_rate(df.limit(0)).collect()} == {0.0}
    with pytest.raises(ValueError):
        marts.matching_rate(df, ["autre"])
    with pytest.raises(TypeError):
        status_set("trouve")


def test_evolution(spark):
    s = spark.createDataFrame([("2016", 1000.0), ("2020", 0.0), ("2024", 1500.0), ("2025", 2000.0)], "annee string, prix double")
    got = {r["fenetre_ans"]: (r["variation_eur"], r["raison"]) for r in marts.evolution(s, "2025").collect()}
    assert got == {1: (500.0, None), 5: (None, "prix de depart nul"), 9: (1000.0, None)}
    assert {r["raison"] for r in marts.evolution(s, "2030").collect()} == {"annee de fin absente"}
    assert marts.evolution(s.limit(0), "2025").count() == 2


def test_years_and_dates(spark):
    m = spark.createDataFrame([("2021",), ("2019",), (None,)], "annee string")
    x = spark.createDataFrame([("2021-01-02",), (None,)], "date_mutation string")
    r = marts.years_and_dates(m, x).first()
    assert (r["annees"], r["date_min"], r["groupes"]) == (["2019", "2021"], "2021-01-02", ["A-C", "D", "E", "F-G"])


POOL = "cas int, numero_dpe string, adresse_brut string, adresse_brute string, dist double"


def pool(spark):
    return spark.createDataFrame([(1, "B", "y ", "lot", 3.0), (1, "A", "x", "lot", 1.0), (1, "C", None, "lot", None), (2, "D", "z", "lot2", 0.0)], POOL)


def test_top_candidates_and_questions(spark):
    top = scoring.top_candidates(pool(spark), ["cas"], F.col("dist"), ["numero_dpe"], 2)
    assert rows(top.select("cas", "pos", "numero_dpe")) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "D")]
    assert rows(scoring.questions(top, ["cas"])) == [(1, "c0", "score"), (1, "c1", "score"), (1, "garde", "noul"), (2, "c0", "score"), (2, "garde", "noul")]
    assert scoring.states(top, ["cas"]).where("cas = 1").first()["etat"] == '{"mutation":"lot","candidats":[{"ref":"c0","adresse":"x"},{"ref":"c1","adresse":"y"}]}'


def test_fingerprint_ignores_order_and_sees_addresses(spark):
    p = pool(spark)
    f = lambda d: rows(scoring.pool_fingerprint(d, ["cas"]))
    assert f(p) == f(p.orderBy("numero_dpe")) and f(p) != f(p.withColumn("adresse_brut", F.lit("q")))


def test_decisions(spark):
    a = spark.createDataFrame([(1, 0, 2.0, 0.9), (1, 1, 1.0, 0.9), (2, 0, 1.8, 0.9), (2, 1, 1.8, 0.1), (3, 0, 1.0, 1.0), (4, 0, 1.9, 0.1), (5, 0, 1.9, 0.9), (6, 0, None, None)], "cas int, pos int, score double, confidence double")
    best = scoring.best_candidates(a, ["cas"])
    got = {r["cas"]: (r["pos"], round(r["marge"], 3), r["motif"]) for r in scoring.decide(best.withColumn("garde", F.when(F.col("cas") == 5, False))).collect()}
    assert got == {1: (0, 1.0, "resolu"), 2: (0, 0.0, "marge_insuffisante"), 3: (0, 1.0, "score_insuffisant"), 4: (0, 1.9, "confiance_insuffisante"), 5: (0, 1.9, "garde_noul"), 6: (0, 0.0, "score_insuffisant")}


def test_cache_and_judge(spark):
    cases = spark.createDataFrame([("k1", 1), ("k2", 2)], "cle string, cas int")
    cache = spark.createDataFrame([("k1", 1.5)], "cle string, score double")

    def ask(batches):
        for b in batches:
            yield pd.DataFrame({"cle": b["cle"], "score": [0.5] * len(b)})

    assert rows(scoring.judge(cases, cache, ask, "cle string, score double").select("cle", "score", "source")) == [("k1", 1.5, "cache"), ("k2", 0.5, "demande")]
    assert rows(scoring.judge(cases, cache, None, "").select("cle", "score", "source")) == [("k1", 1.5, "cache"), ("k2", None, "sans_cle")]


def test_samples(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "cle int, s string")
    assert rows(scoring.sample(df, "cle", 3).select("cle")) == [(0,), (1,), (2,)] and scoring.sample(df, "cle", 0).count() == 10
    assert rows(scoring.stratified_sample(df, "s", "cle", 1)) == [(0, "a"), (1, "b")]


def test_responses_of_two_shapes(spark):
    raw = ['{"c0": {"score": 1.5, "confidence": 0.5}}', '{"answers": {"c0": {"score": 1.5, "confidence": 0.5}}}', "junk", None]
    got = [r[0] for r in frame(spark, raw, "v string").select(scoring.normalize_response(F.col("v"))["c0"]["score"]).collect()]
    assert got == [1.5, 1.5, None, None]


def test_summary(spark):
    df = spark.createDataFrame([("isole", True, True, True), ("isole", False, False, False)], "regime string, correct_top1 boolean, resolu boolean, correct_a_seuil boolean")
    assert rows(scoring.summarize(df)) == [("isole", 2, 0.5, 1, 1.0, 0.0), ("multi", 0, 0.0, 0, 0.0, None)]


def test_few_groups_have_the_same_figures(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.lognormvariate(8, 1) * r.choice([1, 1, 1, -1, 0])) for _ in range(4000)] + [("one", 5.0), ("two", 1.0), ("two", 4.0), ("none", None), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("inf", float("inf")), ("inf", 3.0), ("inf", 2.0)]
    df = spark.createDataFrame(data, "k string, prix_m2 double").repartition(7)
    close = lambda rows_: sorted(str((k, n, round(m, 6), round(x, 9))) for k, n, m, x in rows_)
    assert close(stats.aggregate_few(df, ["k"]).collect()) == close(stats.aggregate_by(df, ["k"]).collect())
    assert stats.aggregate_few(df.limit(0), ["k"]).count() == 0


def test_sorting_with_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 2), ("d", 2)], "k string, v int")
    assert [r["k"] for r in stats.sorted_table(df, "v", False, ["k"]).collect()] == ["a", "c", "d", "b"]
    assert [r["k"] for r in stats.sorted_table(df, "v", True, ["k"]).collect()] == ["c", "d", "a", "b"]
    assert [tuple(r) for r in stats.most_frequent(spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string"), "k").collect()] == [("y", 2), ("x", 1), (None, 1)]


def test_no_case_is_lost(spark):
    cases = spark.createDataFrame([("k1", 1, 2), ("k2", 2, 1), ("k3", 3, 1), (None, 4, 0), ("k1", 5, 3)], "cle string, cas int, taille int")
    cache = spark.createDataFrame([("k1", 1.5)], "cle string, score double")

    def ask(batches):  # answers some, and is never asked about empty pools
        for b in batches:
            assert b["cle"].notna().all()
            yield pd.DataFrame({"cle": [c for c in b["cle"] if c != "k3"], "score": [0.5 for c in b["cle"] if c != "k3"]})

    got = rows(scoring.judge(cases, cache, ask, "cle string, score double", size="taille").select("cas", "score", "source"))
    assert got == [(1, 1.5, "cache"), (2, 0.5, "demande"), (3, None, "sans_reponse"), (4, None, "pool_vide"), (5, 1.5, "cache")]


def test_run_totals(spark):
    df = spark.createDataFrame([("cache", "x", "r", 100, 100), ("demande", "x", "r", 7, 250), ("demande", "y", "s", None, 250), ("pool_vide", "y", "pool_vide", None, None)], "source string, match_status string, motif string, input_tokens int, duree_ms int")
    assert tuple(scoring.run_totals(df).first()) == (4, 2, 1, 7, 0.5)
    assert rows(scoring.run_counts(df)) == [("motif", "pool_vide", 1), ("motif", "r", 2), ("motif", "s", 1), ("status", "x", 2), ("status", "y", 2)]
    assert tuple(scoring.run_totals(df.limit(0)).first()) == (0, 0, 0, 0, 0.0)


def test_responses_name_their_model(spark):
    raw = '{"model": "m1", "answers": {"c0": {"type": "score", "score": 0.0, "confidence": 0.5}, "garde": {"type": "noul", "noul": false}, "x": {"type": "other"}}, "usage": {"input_tokens": 12}}'
    df = frame(spark, [raw, "{}"], "v string")
    r = df.select(scoring.read_response(F.col("v")).alias("r")).collect()[0]["r"]
    assert r["modele"] == "m1" and r["input_tokens"] == 12 and set(r["reponses"]) == {"c0", "garde"} and r["reponses"]["c0"]["score"] == 0.0 and r["reponses"]["garde"]["noul"] is False
    assert df.select(scoring.read_response(F.col("v")).alias("r")).collect()[1]["r"]["input_tokens"] == 0
    with pytest.raises(Exception, match="answered by model"):
        df.select(scoring.read_response(F.col("v"), "m2")).collect()


def test_a_decision_keeps_the_state_of_entry(spark):
    best = spark.createDataFrame([(1, 0, 2.0, 1.0, 0.9, "A", "ambigu"), (2, 0, 1.0, 1.0, 0.9, "B", "non_trouve"), (3, None, None, None, None, None, "ambigu")], "cas int, pos int, score double, marge double, confiance double, numero_dpe string, entree string")
    got = rows(scoring.decide(best.withColumn("garde", F.lit(True)), entry="entree", carried=["numero_dpe"]).select("cas", "motif", "match_status", "numero_dpe"))
    assert got == [(1, "resolu", "resolu_jev", "A"), (2, "score_insuffisant", "non_trouve", None), (3, "pool_vide", "ambigu", None)]


def test_geocoding_query_of_a_certificate(spark):
    df = spark.createDataFrame([("27 Allée Docteur  Robert Lafon", "64100", "BAYONNE ", "x", "y"), ("  ", "64100", "BAYONNE", "x", "y"), (None, "64100", "BAYONNE", "x", "y"), ("1 rue", None, None, "x", "y")], "adresse_brut string, code_postal_brut string, nom_commune_brut string, code_postal_ban string, nom_commune_ban string")
    got = [r["adresse_geocodage"] for r in clean.clean_certificates(df.withColumn("date_etablissement_dpe", F.lit("2022-01-01"))).collect()]
    assert got == ["27 Allée Docteur Robert Lafon 64100 BAYONNE", None, None, "1 rue"]


def test_report_parts(spark):
    m = spark.createDataFrame([("V", y, "Maison", 10 + k, 1000.0 + 100 * k, 1.0) for k, y in enumerate(["2016", "2020", "2024", "2025"])] + [("V", "2025", "Appartement", 3, 5.0, 1.0), ("W", "2025", "Maison", 1, 1.0, 1.0)], "commune string, annee string, type_local string, n int, moyenne double, mediane double")
    linked = spark.createDataFrame([(1, "2022-01-01", "C", "1", 100_000.0, "Vente", "V", "Maison", 50.0, "trouve", "D"), (2, "2022-01-02", "C", "1", 120_000.0, "Vente", "V", "Maison", 50.0, "trouve", "F"), (3, "2022-01-03", "C", "1", 120_000.0, "Vente", "V", "Maison", 50.0, "ambigu", None)], "match_id long, date_mutation string, code_insee string, no_disposition string, prix double, nature_mutation string, commune string, type_local string, surface double, match_status string, etiquette_dpe string")
    parts = marts.report(m, linked, ["V"])
    assert rows(parts["communes.evolutions"].where("type_local = 'Maison'").select("fenetre_ans", "libelle", "variation_txt")) == [(1, "1 an", "+8.3 %"), (5, "5 ans", "+18.2 %"), (9, "depuis 2016", "+30.0 %")]
    assert parts["communes.evolutions"].where("type_local = 'Appartement' AND raison IS NOT NULL").count() == 2
    assert tuple(parts["appariement.taux"].first()) == (3, 2, pytest.approx(200 / 3)) and tuple(parts["meta"].first()) == ("2016", "2025")
    d = parts["dpe"].first()
    assert d["pm2"] == [0, 0, 0, 2000, 0, 2400, 0] and d["n"] == [0, 0, 0, 1, 0, 1, 0] and d["ecarts"] == ["F : +20 % (au-dessus, n=1)"]
    s = parts["communes.series"].where("type_local = 'Maison'").first()
    assert (s["annee_debut"], s["n_debut"], s["n_fin"], len(s["points"])) == ("2016", 10, 13, 4)
