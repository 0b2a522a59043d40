import json

from pyspark.sql import functions as F

from terroir.operators import filters, scoring
from terroir.plans import site
from tests.conftest import rows


def test_site_files(spark, sf_dir, tmp_path):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    market = t("agg_marche").where("edition = 0").drop("edition", "p10", "p90")
    iris = spark.createDataFrame([("960070101", "x", "2020", "Maison", 3, 1000.0), (None, "x", "2020", "Maison", 3, 1.0)], "code_iris string, nom_iris string, annee string, type_local string, n long, moyenne double")
    parts = site.payload(market, iris, t("dvf_dpe_matched"), t("iris_polygones"))
    site.export(parts, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == len(parts) == 11
    line = json.loads(spark.read.text(str(tmp_path / "iris")).first()[0])
    assert line == {"annee": "2020", "code_iris": "960070101", "n": 3, "nom_iris": "x", "somme": 3000.0, "type_local": "Maison"} and list(line) == sorted(line)
    assert site.payload(market.limit(0), iris, t("dvf_dpe_matched").limit(0), t("iris_polygones"))["impact.cube"].count() == 0


def test_perimeter(spark):
    towns = spark.createDataFrame([("Saint-Jean", "64001", "64"), ("Tarnos d'Été", "40312", "40")], "nom string, code_insee string, departement string")
    assert filters.perimeter(towns, "40").count() == 1 and filters.perimeter(towns).count() == 2
    assert set(rows(filters.town_choices(towns))) == {("Saint-Jean", "64001", "SAINT-JEAN"), ("Tarnos d'Été", "40312", "TARNOS D ETE")}


def test_cases_and_incoherence(spark):
    pool = spark.createDataFrame([(1, 0, "A", "x", "lot", "2020"), (1, 1, "B", "y", "lot", "2020"), (2, 0, "A", "x", "autre", "2020")], "cas int, pos int, numero_dpe string, adresse_brut string, adresse_brute string, jour string")
    key = lambda d, v="1": {r["cas"]: r["cle"] for r in scoring.cases(d, ["cas"], ["jour"], "m", v).collect()}
    a = key(pool)
    assert a == key(pool.orderBy(F.desc("numero_dpe"))) and a[1] != a[2]
    assert key(pool, "2")[1] != a[1] and key(pool.withColumn("jour", F.lit("2021")))[1] != a[1]
    rec = spark.createDataFrame([(1, "ambigu"), (2, "ambigu"), (3, "trouve")], "id int, match_status string")
    again = spark.createDataFrame([(1, "ambigu"), (2, "trouve")], "id int, match_status string")
    assert rows(scoring.incoherent(rec, again, "id", "ambigu").select("id")) == [(2,)]
