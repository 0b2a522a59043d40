import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terroir.operators import geocode
from terroir.sources import files, rest, sinks
from terroir.streaming import increments
from tests.conftest import rows

HEADER = "|".join(["Code service CH", *files.REQUIRED[1:], "Autre"])


def vintage(tmp_path, header=HEADER, name="v.txt"):
    names = header.split("|")
    line = {n: "" for n in names} | {"Code departement": "96", "Code commune": "7", "Date mutation": "04/05/2021", "Valeur fonciere": "1000,50", "Autre": "é"}
    other = line | {"Code commune": "48"}
    p = tmp_path / name
    p.write_text("\n".join([header, *["|".join(x[n] for n in names) for x in (line, other)]]), encoding="utf-8")
    return str(p)


def test_vintage(spark, tmp_path):
    df = files.read_vintage(spark, vintage(tmp_path), ["96007"])
    assert df.count() == 1 and set(df.dtypes) >= {("Identifiant de document", "string"), ("Code commune", "string")} and df.first()["Code commune"] == "7"
    assert files.read_vintage(spark, vintage(tmp_path)).count() == 2
    from terroir.operators.clean import project_raw

    r = project_raw(files.read_vintage(spark, vintage(tmp_path))).orderBy("code_insee").first()
    assert (str(r["date_mutation"]), r["code_insee"], r["valeur_fonciere"]) == ("2021-05-04", "96007", "1000,50")


@pytest.mark.parametrize("header", ["<html>", "a|b|c", HEADER.replace("Type local", "Typ")])
def test_bad_vintage(spark, tmp_path, header):
    with pytest.raises(ValueError):
        files.read_vintage(spark, vintage(tmp_path, header))


def test_alias_collision(spark):
    with pytest.raises(ValueError):
        files.alias_columns(spark.createDataFrame([(1, 2)], "`Code service CH` int, `Identifiant de document` int"))


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": "x", "b": 1.5, "c": 3}\n\n{"b": 2.0}\n', encoding="utf-8")
    assert rows(files.read_json_lines(spark, str(p), "a string, b double")) == sorted([("x", 1.5), (None, 2.0)], key=str)
    df = files.read_json_lines(spark, str(p), "a string, b double")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert rows(files.read_json_lines(spark, str(tmp_path / "out"), "a string, b double")) == rows(df)


def test_zip_catalog_and_editions(spark, tmp_path):
    for names, good in ((["a.txt"], True), ([], False), (["a", "b"], False)):
        z = tmp_path / "x.zip"
        with zipfile.ZipFile(z, "w") as f:
            for n in names:
                f.writestr(n, "hello")
        if good:
            assert open(files.unzip_single(str(z), str(tmp_path))).read() == "hello"
        else:
            with pytest.raises(ValueError):
                files.unzip_single(str(z), str(tmp_path))
    cat = spark.createDataFrame([("Valeurs 2022", "txt.zip", "u2"), ("Valeurs 2020", "txt.zip", "u0"), ("Notice", "pdf", "n"), ("FAQ", "txt.zip", "f"), ("Valeurs 2021", "txt.zip", None), (None, "txt.zip", "x")], "title string, format string, url string")
    assert [r["year"] for r in files.list_vintages(cat).collect()] == [2020, 2022]
    assert files.vintage_url(2016, {2016: ("ed", "txt")}, "http://m") == "http://m/ed/valeursfoncieres-2016.txt"
    with pytest.raises(ValueError):
        files.vintage_url(1999, {}, "http://m")


def test_geojson_and_slimming(spark, tmp_path):
    feature = lambda code, x: {"type": "Feature", "properties": {"code_iris": code, "nom_iris": "n", "z": 1}, "geometry": {"type": "Polygon", "coordinates": [[[x + 0.1234567, 0], [x + 1, 0], [x + 1, 1], [x + 0.1234567, 0]]]}}
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("B", 0), feature("A", 5)]}))
    df = files.read_geojson(spark, str(p))
    assert [(r["pos"], r["code_iris"], r["code_insee"]) for r in df.orderBy("pos").collect()] == [(0, "B", None), (1, "A", None)]
    slim = json.loads(sinks.slim_features(df.where("pos = 0")).first()["geometry"])
    assert slim["coordinates"][0][0][0] == 0.12346
    from terroir.operators.spatial import attach_region

    pts = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.5, 5.9)], "id long, lat double, lon double")
    assert rows(attach_region(pts, df).select("id", "region")) == [(1, "B"), (2, "A")]


def test_resolution_is_all_or_nothing(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("x")
    live, snap = {"a": str(a), "b": str(b)}, {"a": "sa", "b": "sb"}
    assert files.resolve_sources(live, snap) == snap
    b.write_text("x")
    assert files.resolve_sources(live, snap) == live


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.26), (1, None, None)], "k int, s string, moyenne double")
    sinks.write_table(df, str(tmp_path / "t"), {"k": "bigint", "absent": "string", "s": "string"})
    assert spark.read.parquet(str(tmp_path / "t")).dtypes == [("k", "bigint"), ("absent", "string"), ("s", "string")]
    assert [json.loads(r[0]) for r in sinks.cube_lines(df.orderBy("k")).collect()] == [{"k": 1, "moyenne": None, "s": None}, {"k": 2, "moyenne": 1.3, "s": "b"}]
    linked = spark.createDataFrame([tuple("z" if c != "surface" and c != "prix" else 1.0 for c in sinks.PUBLISHED), tuple("a" if c != "surface" and c != "prix" else None for c in sinks.PUBLISHED)], ", ".join(f"{c} {'double' if c in ('surface', 'prix') else 'string'}" for c in sinks.PUBLISHED))
    src = tmp_path / "geo.json"
    src.write_text("{}")
    out = tmp_path / "pub"
    out.mkdir()
    summary = sinks.publish({"agg": df}, linked, str(out), {"geo.json": str(src)})
    assert [(x["name"], x["rows"]) for x in summary] == [("agg", 2), ("dvf_dpe_matched", 2), ("geo.json", None)] and all(x["bytes"] > 0 for x in summary)
    assert [r["commune"] for r in spark.read.parquet(str(out / "dvf_dpe_matched.parquet")).collect()] == ["a", "z"]


def test_caches_and_stages(spark, tmp_path):
    place, schema = str(tmp_path / "cache"), "cle string, v int"
    assert sinks.load_cache(spark, place, schema).count() == 0
    for n in (2, 3):
        sinks.replace_atomically(spark.createDataFrame([(str(k), k) for k in range(n)], schema), place, "cle")
        assert sinks.load_cache(spark, place, schema).count() == n
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path / "stage"), build).count() == 3
    assert len(built) == 1
    assert increments.append_vintages(spark, str(tmp_path / "v"), [2021, 2020], lambda y: spark.range(y - 2018)) == [2020, 2021]
    assert increments.append_vintages(spark, str(tmp_path / "v"), [2020, 2022], lambda y: spark.range(1)) == [2022]
    assert sorted(r["year"] for r in spark.read.parquet(str(tmp_path / "v")).select("year").distinct().collect()) == [2020, 2021, 2022] and not sinks.vintage_missing(str(tmp_path / "v"), 2020)


def test_paged_source(spark, tmp_path):
    with pytest.raises(ValueError):
        rest.town_query([])
    assert rest.town_query(["1", "2"]) == "code_insee_ban:1 OR code_insee_ban:2"
    assert "select=a%2Cb" in rest.first_url("http://x", ["1"], 10, ["a", "b"]) and "select" not in rest.first_url("http://x", ["1"], 10, [])
    pages = {"u1": {"results": [1, 2], "next": "u2"}, "u2": {"results": [], "next": "u3"}, "u3": {"results": [3]}}
    assert list(rest.pages(pages.__getitem__, "u1")) == [1, 2, 3] and list(rest.pages(pages.__getitem__, None)) == []
    (tmp_path / "0.json").write_text(json.dumps({"results": [{"numero_dpe": "a", "code_insee_ban": "1"}, {"numero_dpe": "b", "code_insee_ban": "2"}], "next": "p/1.json"}))
    (tmp_path / "1.json").write_text(json.dumps({"results": [{"numero_dpe": "c", "code_insee_ban": "1", "extra": 5}]}))
    rest.register(spark)
    df = spark.read.format("terroir_pages").option("folder", str(tmp_path)).option("codes", "1,2").load()
    assert rows(df) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert rows(df.where("code_insee_ban = '1'")) == [("a", "1"), ("c", "1")] and rows(df.where("code_insee_ban IN ('2')")) == [("b", "2")]
    assert df.where("code_insee_ban = '1'").rdd.getNumPartitions() == 1  # the other town is not even asked for


def test_geocode_cache(spark):
    cache = spark.createDataFrame([("1 rue x", 1.0, 2.0), ("2 rue x", None, None)], "cle string, lat double, lon double")
    lots = spark.createDataFrame([(1, " 1  RUE x"), (2, "2 rue X"), (3, "3 rue x"), (4, ""), (5, None), (6, "3 RUE X")], "id int, adresse_geocodage string")
    assert rows(geocode.geocode(lots, cache).select("id", "statut_geocodage", "lat")) == [(1, "found", 1.0), (2, "not_found", None), (3, "missing", None), (4, "no_address", None), (5, "no_address", None), (6, "missing", None)]
    assert rows(geocode.to_look_up(lots, cache)) == [("3 rue x",)]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        files.require_columns(spark.range(1), ["id", "x"])
    assert files.require_columns(spark.range(1).withColumn("x", F.lit(1)), ["x"]).count() == 1


def test_a_cache_is_never_seen_missing(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "cle string, v int"
    frame = lambda v: spark.createDataFrame([("a", v)], schema)
    sinks.replace_atomically(frame(1), path, "cle")
    sinks.replace_atomically(frame(2), path, "cle")
    assert [r["v"] for r in sinks.load_cache(spark, path, schema).collect()] == [2]
    (tmp_path / "cache").rename(tmp_path / "elsewhere")  # as between the two moves
    assert [r["v"] for r in sinks.load_cache(spark, path, schema).collect()] == [1]


def test_a_stage_without_rows_is_built_again(spark, tmp_path):
    path, made = str(tmp_path / "stage"), []

    def build(rows_):
        made.append(len(rows_))
        return spark.createDataFrame(rows_, "v int")

    for rows_ in ([], [(1,)], [(2,)]):
        sinks.stage(spark, path, lambda rows_=rows_: build(rows_))
    assert made == [0, 1]


def test_blank_lines_under_either_kind_of_schema(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "l.json").write_text('{"a": 1}\n\n{"b": 2}\n  \n{"a": null, "b": 3}\n')
    for schema in ("a int, b int", T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType())):
        assert files.read_json_lines(spark, str(tmp_path / "l.json"), schema).count() == 3
