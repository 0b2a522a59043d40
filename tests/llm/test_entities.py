from terroir.llm import entities
from tests.conftest import rows

LOTS = "match_id long, lot_id long, code_insee string, commune string, code_postal string, adresse_brute string, adresse_normalisee string, type_local string, surface double, numero_dpe string, confiance int, apparie_le timestamp"
CERTS = "numero_dpe string, etiquette_dpe string, type_batiment string, surface_habitable_logement double, adresse_brut string, adresse_normalisee string, code_insee_ban string, nom_commune_ban string"


def lot(k, addr, kind="Appartement", s=40.0, num=None):
    return (k, k, "96007", "PORT-AUBREL", "96100", addr, addr, kind, s, num, 3, None)


def cert(n, addr, building="appartement", s=41.0, label="D", town="96007"):
    return (f"900A{n:08d}Z", label, building, s, addr, addr, town, "Port-Aubrel")


def name(n):
    return f"900A{n:08d}Z"


#: Labelled dwellings that give the rules on area, and the one without it, their precision.
KNOWN_LOTS = [lot(101, "101 RUE ALPHA BRAVO", num=name(101)), lot(102, "102 RUE ALPHA BRAVO", num=name(102)), lot(103, "103 RUE ALPHA BRAVO", num=name(103)), lot(104, "104 RUE ALPHA BRAVO", s=None, num=name(104))]
KNOWN_CERTS = [cert(101, "101 RUE ALPHA BRAVO"), cert(102, "102 RUE ALPHA BRAVO", s=42.0), cert(103, "103 RUE ALPHA BRAVO", s=43.0), cert(104, "104 RUE ALPHA BRAVO")]


def run(spark, lots, certs):
    return rows(entities.found(spark.createDataFrame(lots, LOTS), spark.createDataFrame(certs, CERTS)))


def test_rules(spark):
    lots = [lot(1, "1 RUE ALPHA BRAVO"), lot(2, "2 RUE ALPHA BRAVO", "Maison", 90.0), lot(3, "3 RUE ALPHA BRAVO", "Dépendance"), lot(4, "4 RUE ALPHA BRAVO", s=None), lot(5, "5 RUE ALPHA BRAVO"), lot(6, "6 RUE ALPHA BRAVO", num=name(6)), lot(7, "7 RUE ALPHA BRAVO", s=60.0)]
    certs = [
        cert(1, "1 R. ALPHA BRAVO"), cert(10, "1 RUE ALPHA-BRAVO 96100", s=43.0), cert(11, "1 RUE ALPHA BRAVO", s=43.1), cert(12, "1 RUE ALPHA BRAVO", "maison", 40.0), cert(2, "2 RUE ALPHA BRAVO", None, 88.0, town=None), cert(3, "3 RUE ALPHA BRAVO"),
        cert(4, "4 RUE ALPHA BRAVO"), cert(5, "5 RUE ALPHA BRAVO", "maison"), cert(6, "6 RUE ALPHA BRAVO"), cert(7, "7 BIS RUE ALPHA BRAVO", s=60.0),
    ]
    lots, certs = lots + KNOWN_LOTS, certs + KNOWN_CERTS
    assert run(spark, lots, certs) == [(1, name(1)), (1, name(10)), (2, name(2)), (4, name(4))]
    assert run(spark, lots + lots, certs + certs) == run(spark, lots, certs)


def test_confidence_is_smoothed_precision(spark):
    lots = [lot(k, f"{k} RUE ALPHA BRAVO", num=name(k if k <= 9 else 999)) for k in range(1, 11)] + [lot(50, "50 RUE ALPHA BRAVO")]
    certs = [cert(k, f"{k} RUE ALPHA BRAVO") for k in (*range(1, 11), 50)]
    out = entities.cascade(spark.createDataFrame(lots, LOTS), spark.createDataFrame(certs, CERTS)).collect()
    assert [(r["lot_id"], r["numero_dpe"], r["rule_name"], round(r["confidence"], 6)) for r in out] == [(50, name(50), "location, kind, area within 1", round(10 / 12, 6))]


def test_edges(spark):
    assert run(spark, [], []) == [] and run(spark, [lot(1, "1 RUE A B")], []) == [] and run(spark, [], [cert(1, "1 RUE A B")]) == []
    odd = [(k, k, None, None, None, None, None, None, None, None, None, None) for k in (1, None)] + [lot(2, "x" * 20_000), lot(3, ""), lot(4, None)]
    assert run(spark, odd, [(None,) * 8, ("", None, None, None, "1 RUE A B", "1 RUE A B", None, None), cert(1, None), cert(2, "")]) == []


def test_an_unmeasured_rule_gives_no_match(spark):
    lots, certs = [lot(1, "1 RUE ALPHA BRAVO"), lot(4, "4 RUE ALPHA BRAVO", s=None)], [cert(1, "1 RUE ALPHA BRAVO"), cert(4, "4 RUE ALPHA BRAVO")]
    assert run(spark, lots, certs) == []
    assert run(spark, lots + KNOWN_LOTS[:1], certs + KNOWN_CERTS[:1]) == [(1, name(1))]
    assert run(spark, lots + KNOWN_LOTS[3:], certs + KNOWN_CERTS[3:]) == [(4, name(4))]


def test_precision_counts_pairs(spark):
    """A rule that makes ten pairs of which one is right is right in a tenth."""
    lots = [lot(k, f"{k} RUE ALPHA BRAVO", num=name(k)) for k in range(1, 5)] + [lot(50, "50 RUE ALPHA BRAVO")]
    certs = [cert(k, f"{k} RUE ALPHA BRAVO") for k in (1, 2, 3, 4, 50)] + [cert(100 * k + j, f"{k} RUE ALPHA BRAVO") for k in range(1, 5) for j in range(9)]
    a, b = spark.createDataFrame(lots, LOTS), spark.createDataFrame(certs, CERTS)
    got = {r["rule"]: (r["n_labelled"], r["hits"], round(r["confidence"], 6)) for r in entities.rules(a, b).collect()}
    assert got[1] == (40, 4, round(5 / 42, 6)) and got[4] == (0, 0, 0.5)
    assert rows(entities.cascade(a, b)) == []


def test_a_resolved_lot_leaves_the_cascade(spark):
    """The second pass would join 1 TALNESQUI without its way type; the first has resolved lot 1."""
    lots, certs = [lot(1, "1 RUE TALNESQUI"), lot(2, "2 RUE TALNESQUI")], [cert(1, "1 RUE TALNESQUI"), cert(9, "1 TALNESQUI"), cert(2, "2 TALNESQUI"), *[cert(3 + k, f"{k} AVENUE TALNESQUI", s=200.0) for k in (1, 2)]]
    pairs = entities.passes(*entities.prepare(spark.createDataFrame(lots, LOTS), spark.createDataFrame(certs, CERTS)))
    assert rows(pairs.select("lot_id", "numero_dpe", "rule")) == [(1, name(1), 1), (2, name(2), 4)]


def test_places_stand_in_for_a_missing_address(spark):
    at = lambda rows_, places: [(*r, *p) for r, p in zip(rows_, places)]
    here, near, far, shared = (42.0, -30.0), (42.00002, -30.00001), (42.0002, -30.0), (42.1, -30.1)
    lots = at([lot(1, None), lot(2, "2 RUE ALPHA BRAVO"), lot(3, None), lot(4, "4 RUE ALPHA BRAVO"), lot(5, "5 RUE ALPHA BRAVO"), lot(6, None), lot(7, None, num=name(7)), lot(8, "8 RUE ALPHA BRAVO")], [here, (43.0, -30.0), far, shared, shared, shared, (44.0, 180.0), (45.0, 1.0)])
    certs = at([cert(1, "1 RUE ALPHA BRAVO"), cert(2, None), cert(6, "6 RUE ALPHA BRAVO"), cert(7, "7 RUE ALPHA BRAVO"), cert(8, "9 RUE ALPHA BRAVO")], [near, (43.0, -30.00001), shared, (44.00001, -180.0), (45.0, 1.0)])
    a, b = spark.createDataFrame(lots, LOTS + ", lat double, lon double"), spark.createDataFrame(certs, CERTS + ", lat double, lon double")
    # 6 lies where lots of two locations lie; 8 has an address and so has the certificate beside it
    assert rows(entities.found(a, b)) == [(1, name(1)), (2, name(2))]


def test_a_hot_location(spark, monkeypatch):
    from terroir.operators import joins

    lots = [lot(k, "1 RUE ALPHA BRAVO", s=30.0 + k % 40) for k in range(1001, 1201)] + KNOWN_LOTS
    certs = [cert(k, "1 RUE ALPHA BRAVO", s=30.0 + k) for k in range(40)] + KNOWN_CERTS
    want = sorted(((k, name(c)) for k in range(1001, 1201) for c in range(40) if abs((30 + k % 40) - (30 + c)) <= 3), key=str)
    monkeypatch.setattr(joins.spread_join, "__defaults__", (5,))
    assert run(spark, lots, certs) == want
