"""Queries of the smaller operators: raw projections, perimeters, labels, cases put to the scorer, reports and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.functions import text
from terroir.functions.geo import haversine_m
from terroir.operators import clean, filters, fold, linkage, scoring, spatial, stats
from terroir.plans import marts, site
from terroir.session import table
from terroir.sources import files

#: Ties of the distance, which is null where either side has no coordinates.
TIES = ("numero_dpe", "etiquette_dpe", "surface_c", "lat_c", "lon_c")


def nearest(pool: DataFrame) -> DataFrame:
    """The nearest candidates of each profile; distances to the micrometre, so that equal ones are ties on any machine."""
    far = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c")), 6)
    return scoring.top_candidates(pool, linkage.PROFILE, far, TIES)


def undecided(spark: SparkSession, d: str) -> DataFrame:
    """The nearest candidates of each undecided profile, the case as one column ``cas``."""
    pool = linkage.undecided_pools(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))
    return nearest(pool).withColumn("cas", F.struct(*linkage.PROFILE))


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Masked pools decided on the answers of a deterministic stand-in for the scorer."""
    h = F.conv(F.substring(F.md5("numero_dpe"), 1, 4), 16, 10).cast("int")
    a = nearest(linkage.masked_pools(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))).withColumns({"score": (h % 201) / 100.0, "confidence": (h % 101) / 100.0})
    flat = scoring.best_candidates(a, linkage.PROFILE, ["numero_dpe", "reponse", "regime"])
    return scoring.evaluate(scoring.decide(flat.withColumns({"garde": F.col("numero_dpe").rlike("[0-8].$"), "entree": F.lit("ambigu")}), entry="entree"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    """The decided cases as a run: those whose certificate's hash is divisible by three were in the cache."""
    h = F.conv(F.substring(F.md5("numero_dpe"), 1, 4), 16, 10).cast("long")
    return decided(spark, d).select("motif", F.when(h % 3 == 0, "cache").otherwise("demande").alias("source"), (h % 7).alias("input_tokens"), (h % 11).alias("duree_ms"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _of_case(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(f"cas.{c}").alias(c) for c in ("code", "adresse", "surface", "lat")], *columns)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dvf_dpe_matched")


def _impact(spark: SparkSession, d: str) -> DataFrame:
    return fold.impact_points(_linked(spark, d))


def filter_p2_project_raw(spark, d):
    """Lots under the official names of a raw vintage, and from there under their working names again."""
    code, c = F.col("code_insee"), F.col
    raw = table(spark, d, "dvf_clean").select(
        F.date_format("date_mutation", "dd/MM/yyyy").alias("Date mutation"), F.substring(code, 1, 2).alias("Code departement"), F.regexp_replace(F.substring(code, 3, 3), "^0+(?=.)", "").alias("Code commune"),
        c("identifiant_document").alias("Identifiant de document"), c("no_disposition").alias("No disposition"), c("nature_mutation").alias("Nature mutation"), c("prix").cast("string").alias("Valeur fonciere"), F.lit("1").alias("No voie"),
        F.lit("B").alias("B/T/Q"), F.lit("RUE").alias("Type de voie"), c("adresse_brute").alias("Voie"), c("code_postal").alias("Code postal"), c("commune").alias("Commune"), c("type_local").alias("Type local"),
        c("nombre_pieces_principales").alias("Nombre pieces principales"), c("surface").cast("string").alias("Surface reelle bati"),
    )
    out = clean.project_raw(files.require_columns(raw, files.REQUIRED))
    return out.select(F.col("date_mutation").cast("string").alias("date_mutation"), "code_insee", "identifiant_document", "no_disposition", "nature_mutation", "btq", F.col("voie").alias("adresse"), "code_postal", "commune", "type_local").distinct()


def _towns(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "dpe_clean").where(F.col("code_insee_ban").isNotNull() & F.col("nom_commune_ban").isNotNull())
    return known.select(F.col("nom_commune_ban").alias("nom"), F.col("code_insee_ban").alias("code_insee"), F.substring("code_insee_ban", 1, 2).alias("departement")).distinct()


def filter_p13_perimeter(spark, d):
    return filters.perimeter(_towns(spark, d), "96")


def filter_p14_town_choices(spark, d):
    return filters.town_choices(_towns(spark, d))


def fn_f13_pool_fingerprint(spark, d):
    """The fingerprint of the pool of every undecided profile, cut to the candidates that are asked about."""
    return _of_case(scoring.pool_fingerprint(undecided(spark, d), ["cas"], address="adresse_c"), "empreinte")


def fn_f15_reference(spark, d):
    return stats.count_by(undecided(spark, d).select(scoring.reference(F.col("pos")).alias("ref")), "ref")


def fn_f16_resource_year(spark, d):
    """Year of the files' names, here followed by that of their delivery."""
    return table(spark, d, "dvf_fichiers").select("fichier_id", text.resource_year(F.concat("nom_fichier", F.lit(" "), F.year("recu_le").cast("string"))).alias("annee")).distinct()


def fn_f17_signed_percent(spark, d):
    a = table(spark, d, "agg_marche").where("moyenne IS NOT NULL AND mediane > 0")
    return a.select("edition", "commune", "annee", "type_local", text.signed_percent(F.round((F.col("moyenne") / F.col("mediane") - 1) * 100), 0).alias("ecart")).distinct()


def fn_f18_window_label(spark, d):
    years = (F.lit(2025) - F.col("annee").cast("int")).alias("ans")
    return table(spark, d, "agg_marche").where("annee IS NOT NULL").select("annee", years).distinct().select("annee", text.window_label(F.col("ans"), F.col("annee"), F.lit("2016")).alias("libelle"))


def fn_f19_start_year(spark, d):
    return table(spark, d, "agg_marche").select("annee").distinct().select("annee", marts.start_year(F.col("annee")).alias("debut"))


def fn_f22_coordinates(spark, d):
    """Number of coordinates, the first and the last of each polygon, all rings in a row."""
    p = spatial.flat_coordinates(F.col("geometry"))
    return table(spark, d, "iris_polygones").select("code_iris", F.size(p).alias("n"), F.element_at(p, 1).alias("premier"), F.element_at(p, -1).alias("dernier"))


def agg_a23_lots_by_town(spark, d):
    return stats.most_frequent(table(spark, d, "dvf_clean").where(clean.row_class(F.col("prix"), F.col("surface")) == "kept"), "commune")


def agg_a24_years(spark, d):
    return marts.years_and_dates(table(spark, d, "agg_marche"), _linked(spark, d))


def agg_a26_run(spark, d):
    """Totals of a run over the masked pools."""
    return scoring.run_totals(_run(spark, d))


def agg_a26_reasons(spark, d):
    return scoring.run_counts(_run(spark, d), "source", "motif")


def sort_o4_top_candidates(spark, d):
    """The eight nearest certificates of each undecided profile, those without coordinates last."""
    return undecided(spark, d).select("code", "adresse", "lat", "lon", "surface", "kind", F.col("pos").cast("long").alias("pos"), "numero_dpe")


def sort_o8_towns(spark, d):
    """The town table by its change, descending, towns without one last."""
    return _rounded(stats.sorted_table(marts.town_table(table(spark, d, "agg_marche").where("edition = 1"), "2024", 5), "evolution", True, ["commune", "type_local"]).select("commune", "type_local", "evolution", "n"))


def cube_m10_series(spark, d):
    """What a report draws of each town and type."""
    r = marts.report_series(table(spark, d, "agg_marche").where("edition = 0"), "2025")
    return _rounded(r.select("commune", "type_local", "annee_debut", "n_debut", "n_fin", F.size("points").alias("annees"), F.element_at("points", -1)["prix"].alias("dernier_prix")))


def cube_m10_evolutions(spark, d):
    e = marts.report_evolutions(table(spark, d, "agg_marche").where("edition = 0"), "2025")
    return _rounded(e.select("commune", "type_local", "fenetre_ans", "libelle", "prix_debut", "prix_fin", "raison", F.col("variation_txt").isNotNull().alias("calculee")))


def cube_m10_labels(spark, d):
    return marts.report_labels(_impact(spark, d)).select("commune", "type_local", "n", F.size("ecarts").cast("long").alias("n_ecarts"))


def cube_m13_global(spark, d):
    return _rounded(marts.global_series(marts.trend_by_type(fold.points(table(spark, d, "dvf_iris"))), "Maison", "2018", "2023"))


def cube_m13_town(spark, d):
    return marts.town_series(table(spark, d, "agg_marche").where("edition = 1"), "Vaumirac", "Appartement", "2018", "2023").select("annee", "n", "moyenne", "mediane")


def cube_m13_counts(spark, d):
    counts = marts.impact_counts_by_year(_impact(spark, d))
    level = lambda t, g: marts.counts_of_range(counts, "Vaumirac", "2019", "2024", t, g).select(F.lit(t).cast("string").alias("type_local"), F.lit(g).cast("string").alias("groupe"), "retenues", "resolu_consensus", "pre_reforme_exclus")
    return level(None, None).unionByName(level("Maison", None)).unionByName(level("Maison", "D")).unionByName(level(None, "absent"))


def cube_m13_ladder(spark, d):
    ladder = marts.label_ladder(_impact(spark, d))
    return _rounded(marts.ladder_of(ladder, "Maison").unionByName(marts.ladder_of(ladder, "Appartement", "Vaumirac")))


def cube_m13_iris(spark, d):
    points = fold.points(table(spark, d, "dvf_iris"), carry=("commune", "type_local", "code_iris", "nom_iris"))
    return _rounded(marts.iris_values(marts.iris_year_sums(marts.by_iris(points, per_year=True)), "Appartement", "2018", "2022"))


def site_m11_parts(spark, d):
    """Rows of parts of the site."""
    parts = site.payload(table(spark, d, "agg_marche"), table(spark, d, "agg_iris").withColumn("annee", F.lit("2020")), _linked(spark, d), table(spark, d, "iris_polygones"))
    kept = [parts[k].select(F.lit(k).alias("partie")) for k in ("meta", "meta.appariement", "marche.communes", "impact.comptages", "communes.appariement", "iris.geojson")]
    return stats.count_by(reduce(DataFrame.unionByName, kept), "partie")


def score_d1_states(spark, d):
    """What is asked of each undecided profile."""
    return _of_case(scoring.states(undecided(spark, d), ["cas"], "adresse", "adresse_c"), "etat")


def score_d2_questions(spark, d):
    return stats.count_by(scoring.questions(undecided(spark, d), ["cas"]).select("cas.code", "ref", "type"), "code", "ref", "type")


def score_d5_responses(spark, d):
    """A response per document in the shape of the service, read again."""
    answer = F.struct(F.lit("score").alias("type"), (F.col("n_cells") / 4).alias("score"), F.lit(0.5).alias("confidence"))
    raw = F.to_json(F.struct(F.lit("m1").alias("model"), F.create_map(F.lit("c0"), answer).alias("answers"), F.struct(F.col("n_chars").alias("input_tokens")).alias("usage")))
    r = table(spark, d, "documents").select("doc_id", scoring.read_response(raw, "m1").alias("r"))
    one = F.col("r.reponses")["c0"]
    return r.select("doc_id", one["score"].alias("score"), one["confidence"].alias("confiance"), F.col("r.modele").alias("modele"), F.col("r.input_tokens").alias("input_tokens"))


def score_d7_cases(spark, d):
    """How many cases there are, how many different keys, and over how many candidates."""
    c = scoring.cases(undecided(spark, d).withColumn("adresse_brut", F.col("adresse_c")), ["cas"], ["code"], "m1", "v1", "adresse")
    return c.agg(F.count(F.lit(1)).alias("cas"), F.countDistinct("cle").alias("cles"), F.sum(F.size(F.from_json("etat", "struct<candidats:array<struct<ref:string>>>")["candidats"])).alias("candidats"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_p2_project_raw, filter_p13_perimeter, filter_p14_town_choices, fn_f13_pool_fingerprint, fn_f15_reference, fn_f16_resource_year, fn_f17_signed_percent, fn_f18_window_label, fn_f19_start_year, fn_f22_coordinates,
        agg_a23_lots_by_town, agg_a24_years, agg_a26_run, agg_a26_reasons, sort_o4_top_candidates, sort_o8_towns, cube_m10_series, cube_m10_evolutions, cube_m10_labels, cube_m13_global, cube_m13_town, cube_m13_counts, cube_m13_ladder, cube_m13_iris,
        site_m11_parts, score_d1_states, score_d2_questions, score_d5_responses, score_d7_cases,
    )
}
