import json
from datetime import datetime

from terroir.operators import drift
from tests.conftest import rows

FILES = "fichier_id long, flux string, nom_fichier string, recu_le timestamp"
LINES = "fichier_id long, ligne int, contenu string"


def build(spark, *versions, flux="f"):
    """A flux of one file per version; a version is a function line number -> object, or a list of raw texts."""
    files = [(10 - k, flux, f"{flux}_{k}", datetime(2020, 1, 1 + k)) for k in range(len(versions))]  # ids run against time
    lines = []
    for k, v in enumerate(versions):
        texts = v if isinstance(v, list) else [json.dumps(v(i)) for i in range(60)]
        lines += [(10 - k, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES)


def base(i, **more):
    return {"id": f"D{i:07d}", "ville": f"960{i % 9:02d}", "date": f"20{16 + i % 9}-0{1 + i % 9}-1{i % 9}", "prix": 1000.0 * (50 + i), "pieces": str(i % 6)} | more


def test_all_kinds_of_change(spark):
    def renamed(i):
        d = base(i + 7)
        d["commune_code"] = d.pop("ville")
        return d

    versions = [
        base, lambda i: base(i + 3, vefa=bool(i % 2)), renamed, lambda i: renamed(i) | {"pieces": i % 6}, lambda i: renamed(i) | {"pieces": i % 6, "date": base(i)["date"].replace("-", "")},
        lambda i: {k: v for k, v in renamed(i).items() if k != "prix"} | {"pieces": i % 6, "date": 17000 + 31 * i},
        lambda i: dict(reversed(list(({k: v for k, v in renamed(i).items() if k != "prix"} | {"pieces": i % 6, "date": 17000 + 31 * i}).items()))),
    ]
    got = rows(drift.changes(*build(spark, *versions)))
    assert got == sorted(
        [(9, "ajout", "vefa", ""), (8, "renommage", "ville", "commune_code"), (8, "retrait", "vefa", ""), (7, "type", "pieces", "integer"), (6, "format", "date", ""), (5, "retrait", "prix", ""), (5, "type", "date", "integer")], key=str
    )


def test_numbers_and_integers_differ(spark):
    got = rows(drift.changes(*build(spark, lambda i: {"s": 1.0 * i}, lambda i: {"s": i}, lambda i: {"s": str(i)}, lambda i: {"s": i > 3})))
    assert got == [(7, "type", "s", "boolean"), (8, "type", "s", "string"), (9, "type", "s", "integer")]


def test_other_content_is_no_renaming(spark):
    a = lambda i: {"id": str(i), "ville": f"960{i % 9:02d}"}
    b = lambda i: {"id": str(i), "voie": f"{(i * 7919) % 10000:04d}"}
    assert rows(drift.changes(*build(spark, a, b))) == [(9, "ajout", "voie", ""), (9, "retrait", "ville", "")]


def test_minority_lines_nulls_and_junk_are_no_change(spark):
    def dirty(i):
        d = base(i)
        if i % 10 == 0:
            d.pop("ville")
        if i % 11 == 0:
            d["prix"] = None
        if i % 13 == 0:
            d["pieces"] = 3
        if i % 17 == 0:
            d["stray"] = 1
        return d

    texts = [json.dumps(dirty(i)) for i in range(60)] + ["", "not json", "[1, 2]", "null"]
    assert rows(drift.changes(*build(spark, base, texts))) == []


def test_empty_tables_and_files_without_lines(spark):
    lines, files = build(spark, base, [], lambda i: base(i, x=1))
    assert rows(drift.changes(lines, files)) == [(8, "ajout", "x", "")]
    assert drift.changes(lines.limit(0), files).count() == 0 and drift.changes(lines, files.limit(0)).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    lines, files = build(spark, base, lambda i: base(i, x=1))
    twice = lines.union(lines).selectExpr("*", "1 AS champ", "2 AS type")
    assert rows(drift.changes(twice, files.union(files))) == [(9, "ajout", "x", "")]


def test_very_long_value(spark):
    lines, files = build(spark, base, [json.dumps(base(i, note="x" * 200_000 if i == 0 else "y")) for i in range(20)])
    assert rows(drift.changes(lines, files)) == [(9, "ajout", "note", "")]


def test_unified_follows_renames_types_and_formats(spark):
    targets = {"ville": "string", "date": "date", "prix": "double", "pieces": "string"}
    versions = [base, lambda i: {k if k != "ville" else "v2": v for k, v in base(i).items()}, lambda i: {k if k != "ville" else "v3": v for k, v in base(i).items()} | {"date": base(i)["date"].replace("-", ""), "prix": str(base(i)["prix"]).replace(".", ",")}]
    out = drift.unified(*build(spark, *versions), targets=targets).orderBy("ligne", "fichier_id").collect()
    assert len(out) == 180
    for i in range(60):
        assert len({(str(r["date"]), r["ville"], r["prix"], r["pieces"]) for r in out[3 * i : 3 * i + 3]}) == 1
    assert out[0]["prix"] == 50_000.0 and out[0]["ville"] == "96000"


def test_types_keep_every_alternative(spark):
    t = {(r["champ"], r["type"]): r["premier_fichier"] for r in drift.fused_types(*build(spark, lambda i: {"s": 1.5}, lambda i: {"s": "x" if i else 2})).collect()}
    assert t == {("s", "number"): 10, ("s", "string"): 9, ("s", "integer"): 9}
    branched = drift.unified(*build(spark, lambda i: {"s": 1.5}, lambda i: {"s": "2,5"}), targets={"s": "double"}, branches=True)
    assert {(r["s"], r["s_number"], r["s_string"]) for r in branched.collect()} == {(1.5, 1.5, None), (2.5, None, "2,5")}


def test_unified_keeps_fields_that_are_no_targets(spark):
    first = lambda i: base(i, parcelle=f"AB{i:05d}")
    second = lambda i: {k if k != "parcelle" else "section": v for k, v in first(i).items()} | {"vefa": bool(i % 2), "a.b c": {"x": i}, "Prix": i, "ligne": "L"}
    out = drift.unified(*build(spark, first, second), targets={"prix": "double"}, branches=False).orderBy("ligne", "fichier_id").collect()
    assert len(out) == 120 and out[0].asDict().keys() == {"fichier_id", "ligne", "prix", "Prix_2", "a.b c", "date", "id", "ligne_2", "parcelle", "pieces", "vefa", "ville"}
    for i in range(60):
        new, old = out[2 * i], out[2 * i + 1]
        assert new["parcelle"] == old["parcelle"] == f"AB{i:05d}" and new["vefa"] == str(bool(i % 2)).lower() and old["vefa"] is None
        assert json.loads(new["a.b c"]) == {"x": i} and new["Prix_2"] == str(i) and new["prix"] == old["prix"] and new["ligne_2"] == "L"


def test_table_keeps_what_cannot_be_converted(spark):
    named = ["12 mars 2021", "3 févr. 2020", "1 August 2019", "31 février 2021", "mars 2021", "12 marche 2021"]
    stray = [json.dumps({"prix": p, "date_mutation": d}) for p, d in zip([1.5, "sur demande", 3, True, {"x": 1}, [2]], named)]
    out = drift.unified(*build(spark, stray)).orderBy("ligne").collect()
    assert [str(r["date_mutation"]) for r in out] == ["2021-03-12", "2020-02-03", "2019-08-01", "None", "None", "None"]
    assert [r["date_mutation_string"] for r in out] == named
    assert [r["prix"] for r in out] == [1.5, None, 3.0, None, None, None]
    assert [(r["prix_number"], r["prix_string"], r["prix_integer"], r["prix_boolean"], r["prix_object"], r["prix_array"]) for r in out] == [
        (1.5, None, None, None, None, None), (None, "sur demande", None, None, None, None), (None, None, 3, None, None, None), (None, None, None, True, None, None), (None, None, None, None, '{"x":1}', None), (None, None, None, None, None, "[2]")
    ]


def few(i, **more):
    return {"id": f"D{(i * 7919 + 13) % 10**7:07d}", "ville": f"960{i % 3:02d}", "prix": 1000.0 * (50 + i)} | more


def test_small_files_are_judged_like_large_ones(spark):
    """Ids never repeat, so they are compared by shape, in ten lines as in thousands."""
    for n in (10, 38, 400):
        first, second = ([json.dumps(few(i + k * n) if not k else {"ident" if f == "id" else f: v for f, v in few(i + k * n).items()}) for i in range(n)] for k in (0, 1))
        assert rows(drift.changes(*build(spark, first, second))) == [(9, "renommage", "id", "ident")]


def test_likeness_does_not_depend_on_size():
    import random

    rnd = random.Random(4)

    def path(n, draw):
        p = drift.Path()
        for _ in range(n):
            v = draw()
            for kind, case in (("t", "string"), ("s", "A" if v < 0 else "9"), ("v", str(v))):
                p.hist[kind][case] = p.hist[kind].get(case, 0) + 1
        return p

    few_kinds, others, ids = (lambda: rnd.randrange(5)), (lambda: 50 + rnd.randrange(5)), (lambda: rnd.randrange(10**9))
    for n in (10, 40, 1000):
        same = [drift.likeness(path(n, few_kinds), path(n, few_kinds)) for _ in range(50)]
        assert sorted(same)[5] >= drift.SAME_CONTENT
        assert max(drift.likeness(path(n, few_kinds), path(n, others)) for _ in range(50)) < drift.SAME_CONTENT
        assert min(drift.likeness(path(n, ids), path(n, ids)) for _ in range(50)) == 1.0


def test_shapes_are_those_of_whole_texts(spark):
    long = lambda tail: (lambda i: {"id": f"{i}", "x" if tail else "y": " ".join(["lot 1"] * 40) + (f" {i}" if tail else "-A")})
    assert rows(drift.changes(*build(spark, long(True), long(False)))) == [(9, "ajout", "y", ""), (9, "retrait", "x", "")]


def test_the_order_of_month_and_day_is_told_by_the_file(spark):
    us, eu = ["03/25/2020", "03/05/2020", "12/31/2021"], ["25/03/2020", "03/05/2020", "31/12/2021"]
    lines, files = build(spark, *[[json.dumps({"date_mutation": d}) for d in day] for day in (us, eu, us[1:2])])
    assert rows(drift.changes(lines, files)) == [(9, "format", "date_mutation", "")]
    got = rows(drift.unified(lines, files).select("fichier_id", "ligne", "date_mutation"))
    assert [(f, n, str(d)) for f, n, d in got] == [
        (10, 0, "2020-03-25"), (10, 1, "2020-03-05"), (10, 2, "2021-12-31"), (8, 0, "2020-05-03"), (9, 0, "2020-03-25"), (9, 1, "2020-05-03"), (9, 2, "2021-12-31")
    ]


def test_alternatives_that_appear(spark):
    versions = [lambda i: {"s": 1.5, "t": i}, lambda i: {"s": "x" if i == 7 else 1.5, "t": i}, lambda i: {"s": "x" if i % 2 else 1.5, "t": None if i else True}]
    lines, files = build(spark, *versions)
    assert rows(drift.appearing(lines, files)) == [(8, "t", "boolean", 1), (9, "s", "string", 1)]
    union = drift.Union("a", "b", None, None)
    assert union.alternatives == {} and union.dominant == (None, None)


def test_a_name_that_changes_hands(spark):
    """Two fields swap names in one file: each value stands under its own canonical name."""
    first = lambda i: {"a": f"X{i:04d}", "b": bool(i % 2), "c": "k"}
    lines, files = build(spark, first, lambda i: {"d": f"X{i + 60:04d}", "b": bool(i % 2), "c": "k"}, lambda i: {"d": f"X{i + 120:04d}", "a": bool(i % 2), "c": "k"})
    out = drift.unified(lines, files, targets={}, branches=False)
    got = {(r["fichier_id"], r["ligne"]): (r["a"], r["b"]) for r in out.collect()}
    assert all(got[(10 - k, i)] == (f"X{i + 60 * k:04d}", str(bool(i % 2)).lower()) for k in range(3) for i in range(60))


def test_a_line_delivered_in_two_versions(spark):
    lines, files = build(spark, [json.dumps({"prix": 1.5})])
    both = lines.union(lines).union(spark.createDataFrame([(10, 0, json.dumps({"prix": 2.5}))], LINES))
    assert [r["prix"] for r in drift.unified(both, files, branches=False).collect()] == [2.5]
