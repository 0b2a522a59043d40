from pyspark.sql import functions as F

from terroir.operators import filters, fold
from terroir.plans import marts
from tests.conftest import rows

SCHEMA = "lot_id long, date_mutation string, code_insee string, no_disposition string, prix double, nature_mutation string, type_local string, surface double, commune string, match_status string, etiquette_dpe string"


def lot(k, disp, prix, kind, s, nature="Vente", date="2022-05-01", status="trouve", label="D", town="X"):
    return (k, date, "64001", disp, prix, nature, kind, s, town, status, label)


LOTS = [
    *[lot(k, "bloc", 200_000.0, "Appartement", 40.0) for k in range(65)][:65],
    lot(100, "dep", 100_000.0, "Maison", 50.0), lot(101, "dep", 100_000.0, "Dépendance", 20.0),
    lot(110, "mix", 100_000.0, "Maison", 50.0), lot(111, "mix", 100_000.0, "Local", 20.0),
    lot(120, "two", 100_000.0, "Maison", 50.0), lot(121, "two", 100_000.0, "Appartement", 20.0),
    lot(130, "com", 100_000.0, "Local", 50.0), lot(140, "ech", 100_000.0, "Maison", 50.0, nature="Echange"),
    lot(150, "one", 1.0, "Maison", 50.0), lot(160, "lo", 200.0 * 50, "Maison", 50.0), lot(161, "hi", 30_000.0 * 50, "Maison", 50.0),
    lot(170, "nul", None, "Maison", 50.0), lot(171, "zero", 100_000.0, "Maison", 0.0), lot(172, "nos", 100_000.0, "Maison", None),
    lot(180, "typ", 100_000.0, "Maison", 50.0), lot(181, "typ", 100_000.0, None, 10.0),
    lot(190, "lab", 100_000.0, "Appartement", 20.0, label="D"), lot(191, "lab", 100_000.0, "Appartement", 30.0, label="E"), lot(192, "lab", 100_000.0, "Appartement", 50.0, label="D", status="resolu_consensus"),
]


def test_reasons_and_reconciliation(spark):
    df = spark.createDataFrame([x for x in LOTS if x[3] != "bloc"], SCHEMA)
    e = fold.exclusions(df).first().asDict()
    assert e == {"n_mutations": 13, "n_points": 4, "sans_habitation": 1, "mixte": 3, "nature": 1, "inexploitable": 3, "hors_bande": 1}
    assert e["n_mutations"] == sum(v for k, v in e.items() if k != "n_mutations")


def test_points(spark):
    p = {r["no_disposition"]: r for r in fold.points(spark.createDataFrame(LOTS, SCHEMA)).collect()}
    assert p["dep"]["prix_m2"] == 2000.0 and p["dep"]["n_lots"] == 1 and p["lo"]["prix_m2"] == 200.0 and p["hi"]["prix_m2"] == 30_000.0
    assert p["lab"]["prix_m2"] == 1000.0 and p["lab"]["annee"] == "2022" and "bloc" not in p


def test_one_point_per_label_and_status_with_one_price(spark):
    p = fold.impact_points(spark.createDataFrame(LOTS, SCHEMA), lot_id="lot_id").where("no_disposition = 'lab'")
    assert rows(p.select("etiquette_dpe", "match_status", "prix_m2")) == [("D", "resolu_consensus", 1000.0), ("D", "trouve", 1000.0), ("E", "trouve", 1000.0)]


def test_impact_counts(spark):
    data = [lot(1, "a", 1e5, "Maison", 50.0), lot(2, "b", 1e5, "Maison", 50.0, date="2021-06-30"), lot(3, "c", 1e5, "Maison", 50.0, date=None), lot(4, "d", 1e5, "Maison", 50.0, status="ambigu"), lot(5, "e", 1e5, "Maison", 50.0, status="resolu_consensus", date="2021-07-01"), lot(6, "f", 1e5, "Maison", 50.0, label=None)]
    c = fold.impact_counts(fold.impact_points(spark.createDataFrame(data, SCHEMA), lot_id="lot_id")).first()
    assert tuple(c) == (6, 5, 3, 1, 2)


def test_cube_equals_selection(spark):
    data = [lot(k, f"s{k}", 1e5 + 1000 * k, ["Maison", "Appartement"][k % 2], 50.0, date=f"{2020 + k % 5}-03-01", status=["trouve", "ambigu", "resolu_consensus"][k % 3], label="ABCDEFG"[k % 7], town="XY"[k % 2]) for k in range(80)]
    p = fold.impact_points(spark.createDataFrame(data, SCHEMA), lot_id="lot_id")
    cube = marts.impact_cube(p)
    for town, lo, hi in (("X", "2021", "2022"), ("Y", "2022", "2024"), ("X", "2023", "2023")):
        cell = cube.where((F.col("commune") == town) & (F.col("annee_min") == lo) & (F.col("annee_max") == hi)).select("groupe", "type_local", "n", "mediane")
        assert rows(cell) == rows(marts.impact(p, commune=town, date_from=f"{lo}-01-01", date_to=f"{hi}-12-31").select("groupe", "type_local", "n", "mediane"))
    counts = marts.impact_counts_by_year(p)
    for kind, group in ((None, None), ("Maison", None), (None, "D"), ("Appartement", "A-C")):
        for year in ("2020", "2021", "2023"):
            live = marts.impact_breakdown(p, commune="X", type_local=kind, group=group, date_from=f"{year}-01-01", date_to=f"{year}-12-31").first()
            cell = counts.where((F.col("commune") == "X") & (F.col("annee") == year) & F.col("type_local").eqNullSafe(kind) & F.col("groupe").eqNullSafe(group)).select("retenues", "resolu_consensus", "pre_reforme_exclus").collect()
            assert (tuple(cell[0]) if cell else (0, 0, 0)) == tuple(live)


def test_empty_and_order(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fold.points(none).count() == 0 and fold.exclusions(none).first()["n_mutations"] == 0
    run = lambda x: rows(fold.points(spark.createDataFrame(x, SCHEMA)))
    assert run(LOTS) == run(LOTS[::-1])


def test_range_and_selection_semantics(spark):
    df = spark.createDataFrame([("2020",), (None,)], "v string")
    count = lambda lo, hi: df.where(filters.in_range(F.col("v"), lo, hi)).count()
    assert (count(None, None), count("2019", None), count(None, "2019"), count("2020", "2020")) == (2, 1, 0, 1)
