import itertools

import pytest

from terroir.llm import addresses as a
from tests.conftest import rows

SCHEMA = "lot_id long, code_insee string, commune string, code_postal string, adresse_brute string"

SAME = [
    "12 RUE DE TALNESQUI ORVMIRJAR", "12 R DE TALNESQUI ORVMIRJAR", "12, rue de talnèsqui orvmirjar", "R. TALNESQUI-ORVMIRJAR 12", "NO 0012 RUE DE TALNESQUI ORVMIRJAR 96100 PORT-AUBREL", "APT4-12 RUE DE TALNESQUIORVMIRJAR",
    "12 rue de talnesqui orvmirjar (port-aubrel)", "LOT NO3 12 R DE TALNESQUI ORVMIRJAR BAT B", "12 RUE DE TALNESUQI ORVMIRJAR", "12 RUE DE TALNESQUI ORVMIRJAR RESIDENCE LES CHENES", "ETAGE 3, 12 RU DE TALNESQUI ORVMIRJAAR - RDC", "12 DE TALNESQUI ORVMIRJAR",
]
OTHERS = ["12 BIS RUE DE TALNESQUI ORVMIRJAR", "13 RUE DE TALNESQUI ORVMIRJAR", "12 AVENUE DE KELDOUBRA CHEPOUJAR", "12 RUE DE TALNESQUI KELGUEKEL"]


def lots(spark, texts, town="96007", start=1):
    return spark.createDataFrame([(start + k, town, "Port-Aubrel", "96100", t) for k, t in enumerate(texts)], SCHEMA)


def test_reading():
    assert a.read("APT40-92,  RUE DES JARJARMIR ORVTALKEL ", "Tournelange") == ("92", "", "RUE", "JARJARMIR ORVTALKEL")
    assert a.read("39BIS. AV DES GUEMIRZEP FLIROSTROST", "X") == ("39", "BIS", "AVENUE", "GUEMIRZEP FLIROSTROST")
    assert a.read("118 T R ST. CHE", "X") == ("118", "TER", "RUE", "SAINT CHE")
    assert a.read("148 boluevard du gal rostpoubra", "X")[2:] == ("BOULEVARD", "GENERAL ROSTPOUBRA")
    assert a.read("", "X") is None and a.read(None) is None and a.read("RUE SANS NUMERO", "X") is None and a.read("42", "X") is None


def test_edits():
    assert [a.edits(*p) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abxc"), ("abc", "axc"), ("abcdef", "badcfe"), ("a", "zzzzzz"))] == [0, 1, 1, 1, 1, 3, 4]


@pytest.mark.parametrize("x, y, close", [("SAINT TALNESQUI ORV", "TALNESQUI ORV", True), ("TALNESQUIORVMIRJAR", "TALNESQUI ORVMIRJAR", True), ("TALNESQUI ORVMIRJAR", "TALNESQUI KELGUEKEL", False), ("TALNESQUI", "TALNESQUI ORVMIRJAR", False), ("ST X", "SAINT X", True)])
def test_alignment(x, y, close):
    assert (a.alignment(x.split(), y.split()) <= a.EDITS) == close == (a.alignment(y.split(), x.split()) <= a.EDITS)


def test_one_location_in_many_writings(spark):
    got = rows(a.found(lots(spark, SAME + OTHERS)))
    assert got == sorted(itertools.combinations(range(1, len(SAME) + 1), 2), key=str)


def test_towns_and_ways_part(spark):
    here = lots(spark, ["12 RUE DE TALNESQUI ORVMIRJAR"]).union(lots(spark, ["12 R DE TALNESQUI ORVMIRJAR"], town="96048", start=50))
    assert a.found(here).count() == 0
    two = lots(spark, ["12 RUE DE TALNESQUI ORVMIRJAR", "12 AV DE TALNESQUI ORVMIRJAR", "12 TALNESQUI ORVMIRJAR", "12, AV TALNESQUI ORVMIRJAR"])
    assert rows(a.found(two)) == [(2, 4)]  # without the way type it may be either


def test_edges(spark):
    odd = [None, "", "  ", "x" * 50_000, "12 " + "RUE " * 2000, "12 RUE DE TALNESQUI ORVMIRJAR", "12 RUE DE TALNESQUI ORVMIRJAR", "12 R DE TALNESQUI ORVMIRJAR"]
    df = lots(spark, odd)
    df = df.union(df).selectExpr("*", "1 AS town", "2 AS text", "3 AS salt", "4 AS root")
    assert rows(a.found(df)) == [(6, 8), (7, 8)]
    assert a.found(lots(spark, odd).limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, "12 RUE X Y"), (2, None, None, None, "12 R X Y"), (None, None, None, None, "12 R. X Y")], SCHEMA)
    assert rows(a.found(nulls)) == [(1, 2)]


def roots(spark, supports, town="96007"):
    """root by name; each name is written at as many numbers as its support."""
    rows_ = [(town, f"{n} RUE {name}", str(n), "", "RUE", name) for name, k in supports.items() for n in range(k)]
    parsed = spark.createDataFrame(rows_, "town string, text string, number string, repetition string, ways string, name string")
    return {r["name"]: r["root"] for r in a.street_roots(parsed).collect()}


def test_a_slip_that_recurs_is_still_a_slip(spark):
    got = roots(spark, {"TALNESQUI ORVMIRJAR": 400, "TALNESUQI ORVMIRJAR": 50, "KELDOUBRA CHEPOUJAR": 100, "KELDOUBRA CHEPOUJAM": 90})
    assert got["TALNESUQI ORVMIRJAR"] == got["TALNESQUI ORVMIRJAR"] == "TALNESQUI ORVMIRJAR"
    assert got["KELDOUBRA CHEPOUJAR"] != got["KELDOUBRA CHEPOUJAM"]  # both well supported: two streets


def test_the_limit_does_not_change_with_the_size_of_the_table(spark):
    from pyspark.sql import functions as F

    got = dict(rows(spark.createDataFrame([(1,), (10,), (1000,), (100_000,)], "h int").select("h", F.floor(a.slip_limit(F.col("h"))))))
    assert got == {1: 1, 10: 5, 1000: 233, 100_000: 20_330}


def test_chains_of_any_length_end_at_one_street(spark):
    # each name is one letter further from the first than the one before, and just rare enough to be a slip of that one alone
    word, supports = list("TLNSQOVMJRKDBCHPFGWXYZTLNSQOVMJRKD"), [6700, 1405, 320, 81, 26, 11, 6, 4, 3, 2, 1]
    names = ["".join(word)]
    for k in range(len(supports) - 1):
        word[2 * k] = "A"
        names.append("".join(word))
    got = roots(spark, dict(zip(names, supports)))
    assert set(got.values()) == {names[0]} and len(got) == 11


def test_a_name_meets_more_than_the_hub_of_its_bands(spark):
    # the hub of every shared band is another street, alike but too far off
    got = roots(spark, {"TALNESQUI ORVMIRJAR GUEPOU": 90, "TALNESQUI ORVMIRJAR CHEBRA": 30, "TALNESQUI ORVMIRJAR CHEBAR": 1})
    assert got == {"TALNESQUI ORVMIRJAR GUEPOU": "TALNESQUI ORVMIRJAR GUEPOU", "TALNESQUI ORVMIRJAR CHEBRA": "TALNESQUI ORVMIRJAR CHEBRA", "TALNESQUI ORVMIRJAR CHEBAR": "TALNESQUI ORVMIRJAR CHEBRA"}


def test_the_prefilter_loses_no_close_pair(spark):
    import random

    rnd = random.Random(5)
    syllables, titles = ["TAL", "NES", "QUI", "ORV", "MIR", "JAR", "KEL"], ["SAINT", "GENERAL", "MONSEIGNEUR"]
    pairs = []
    for _ in range(600):
        x = ["".join(rnd.choices(syllables, k=2)) for _ in range(rnd.randint(1, 3))]
        y = list(x)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(y))
            w, j = y[i], rnd.randrange(len(y[i]))
            y[i] = rnd.choice([w[:j] + w[j + 1 :] or w, w[:j] + rnd.choice("ABC") + w[j:], w[:j] + w[j:][::-1][:2] + w[j + 2 :]])
        x, y = ([t] + n if (t := rnd.choice([None, None, *titles])) else n for n in (x, y))
        pairs.append((" ".join(x), " ".join(y)))
    it = lambda k, n: (k, "T", n, 1, n.replace(" ", ""), "".join(w for w in n.split() if w not in a.TITLE_OF), sum(w in a.TITLE_OF for w in n.split()))
    names = spark.createDataFrame([x for k, (n, m) in enumerate(pairs) for x in (it(2 * k, n), it(2 * k + 1, m))], "place long, town string, name string, support long, whole string, plain string, titles int")
    got = {r["place"] // 2 for r in a._verified(spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "place long, hub long"), names).collect()}
    assert got == {k for k, (x, y) in enumerate(pairs) if a.alignment(x.split(), y.split()) <= a.EDITS}


def test_classes(spark):
    got = rows(a.classes(lots(spark, SAME[:3] + OTHERS[:1] + ["", None])))
    assert [r[:4] for r in got] == [(1, "96007", "12", ""), (2, "96007", "12", ""), (3, "96007", "12", ""), (4, "96007", "12", "BIS")]
