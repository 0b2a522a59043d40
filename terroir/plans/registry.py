"""All queries of the library proper, by name. Prefixes tell the kind of operator; problem queries are named pN_."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.constants import CONFIDENCE_EDGES, DISTANCE_EDGES, MARGIN_EDGES
from terroir.functions import text
from terroir.functions.geo import haversine_m
from terroir.operators import clean, drift, filters, fold, geocode, linkage, scoring, spatial, stats
from terroir.plans import cases, marts, oracles
from terroir.session import table
from terroir.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Figures rounded: sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _lots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dvf_iris")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dvf_dpe_matched")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return fold.points(_lots(spark, d))


def _iris_points(spark: SparkSession, d: str) -> DataFrame:
    return fold.points(_lots(spark, d), carry=("commune", "type_local", "code_iris", "nom_iris"))


def _impact_points(spark: SparkSession, d: str) -> DataFrame:
    return fold.impact_points(_linked(spark, d))


# --- problems of the core ---


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "dvf_brut"), table(spark, sf_dir, "dvf_fichiers"))


@query
def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all files as one table: every field in its canonical conversion and in a branch per type."""
    return drift.unified(table(spark, sf_dir, "dvf_brut"), table(spark, sf_dir, "dvf_fichiers"), branches=True)


@query
def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four canonical fields of every line of all files."""
    whole = drift.unified(table(spark, sf_dir, "dvf_brut"), table(spark, sf_dir, "dvf_fichiers"), branches=False)
    return whole.select("fichier_id", "ligne", F.col("date_mutation").cast("string").alias("date_mutation"), "prix", "surface", "code_insee")


@query
def p4_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alternative type of every path of a flux and the file that brought it."""
    return drift.fused_types(table(spark, sf_dir, "dvf_brut"), table(spark, sf_dir, "dvf_fichiers"))


@query
def p4_appearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative types of a field, minorities too, that the file before in the flux did not hold."""
    return drift.appearing(table(spark, sf_dir, "dvf_brut"), table(spark, sf_dir, "dvf_fichiers"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.found(*(table(spark, sf_dir, t) for t in ("dvf_geocoded", "dvf_iris", "iris_polygones")))


# --- scans and sinks ---


@query
def scan_s1_projection(spark, d):
    return files.read_columns(spark, f"{d}/dvf_clean.parquet", ["lot_id", "commune", "type_local", "surface"])


@query
def scan_s2_several_files(spark, d):
    return files.read_columns(spark, [f"{d}/dvf_geocoded.parquet", f"{d}/dvf_iris.parquet"], ["lot_id", "lat", "lon"])


@query
def scan_s17_mart(spark, d):
    return files.read_columns(spark, f"{d}/agg_marche.parquet", ["edition", "commune", "annee", "type_local", "n", "moyenne", "mediane"])


@query
def sink_k1_conform(spark, d):
    """Declared columns and types; the absent one is null, the date becomes text."""
    columns = {"lot_id": "bigint", "date_mutation": "string", "prix": "double", "nombre_pieces_principales": "string", "etage": "string"}
    return sinks.conform(table(spark, d, "dvf_clean"), columns, as_text=["date_mutation"])


@query
def sink_k3_total_order(spark, d):
    return sinks.in_total_order(_linked(spark, d))


@query
def sink_k5_cube_lines(spark, d):
    return sinks.cube_lines(table(spark, d, "agg_marche").select("commune", "annee", "type_local", "n", "moyenne", "mediane"))


@query
def sink_k6_slim_geojson(spark, d):
    return sinks.slim_features(table(spark, d, "iris_polygones"))


# --- filters and cleaning ---


@query
def filter_p1_perimeter(spark, d):
    """Lots of three towns, by the code put together from department and town number."""
    code = F.col("code_insee")
    return table(spark, d, "dvf_clean").where(clean.in_perimeter(F.substring(code, 1, 2), F.regexp_replace(F.substring(code, 3, 3), "^0+", ""), ["96007", "00356", "00017"])).select("lot_id", "code_insee")


@query
def filter_p3_row_class(spark, d):
    lots = table(spark, d, "dvf_clean").withColumn("classe", clean.row_class(F.col("prix"), F.col("surface")))
    return clean.class_counts(lots)


@query
def filter_p4_clean_lots(spark, d):
    """Lots as a raw vintage writes them (decimal commas; number, repetition, way type and street apart) through the cleaning of prices, areas and addresses."""
    part = lambda k: F.regexp_extract("adresse_brute", r"^ *([0-9]+)?( *(?:BIS|TER) )? *([A-Za-z]+)?(.*)$", k)
    raw = table(spark, d, "dvf_clean").select(
        "lot_id", F.regexp_replace(F.col("prix").cast("decimal(18,2)").cast("string"), r"\.", ",").alias("valeur_fonciere"), F.col("surface").cast("decimal(18,1)").cast("string").alias("surface_reelle_bati"),
        part(1).alias("no_voie"), part(2).alias("btq"), part(3).alias("type_voie"), part(4).alias("voie"),
    )
    return clean.clean_lots(raw).select("lot_id", "prix", "surface", "adresse_brute", "adresse_normalisee", "classe").distinct()


@query
def filter_p5_date_class(spark, d):
    c = table(spark, d, "dpe_clean").withColumn("classe", clean.date_class(F.col("date_etablissement_dpe")))
    return clean.class_counts(c)


@query
def filter_p6_clean_certificates(spark, d):
    """The tables hold no postcode and town as declared; made up here from the others, so that a query made of those would show."""
    declared = {"code_postal_brut": F.reverse("code_postal_ban"), "nom_commune_brut": F.concat(F.lit(" "), F.upper("nom_commune_ban"), F.lit(" "))}
    return clean.clean_certificates(table(spark, d, "dpe_clean").withColumns(declared)).select("numero_dpe", "adresse_normalisee", "adresse_geocodage", "classe").distinct()


@query
def filter_p8_market(spark, d):
    return filters.filter_market(table(spark, d, "agg_marche"), type_local="Maison", year_from="2019", year_to="2022")


@query
def filter_p9_iris(spark, d):
    return filters.filter_iris(table(spark, d, "agg_iris"), town="96007", type_local="Appartement")


@query
def filter_p10_selection(spark, d):
    keep = filters.selection(type_local="Appartement", date_from="2020-01-01", date_to="2023-12-31", group="A-C")
    return _linked(spark, d).where(keep).select("match_id", "commune", "date_mutation", "etiquette_dpe")


@query
def filter_p11_certain_after_reform(spark, d):
    return fold.impact_rows(_linked(spark, d)).select("match_id", "match_status", "date_mutation")


@query
def clean_latest_delivery(spark, d):
    return clean.latest_delivery(table(spark, d, "dvf_clean")).select("lot_id", F.col("recu_le").cast("string").alias("recu_le"), "prix")


# --- functions ---


@query
def fn_f1_french_decimal(spark, d):
    raw = F.concat(F.lit(" "), F.regexp_replace(F.col("surface").cast("decimal(18,1)").cast("string"), r"\.", ","))
    return table(spark, d, "dvf_clean").select("lot_id", text.parse_french_decimal(raw).alias("surface")).distinct()


@query
def fn_f2_compose(spark, d):
    part = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return table(spark, d, "dvf_clean").select("lot_id", text.compose_address(part(F.col("code_postal")), F.lit(" "), F.col("type_local"), part(F.col("commune"))).alias("adresse")).distinct()


@query
def fn_f3_normalize_address(spark, d):
    """Distinct raw addresses and their normal form."""
    return table(spark, d, "dvf_clean").select("adresse_brute").distinct().withColumn("adresse", text.normalize_address(F.col("adresse_brute")))


@query
def fn_f4_geocoding_query(spark, d):
    return table(spark, d, "dvf_clean").select("lot_id", text.geocoding_query(F.col("adresse_brute"), F.col("code_postal"), F.col("commune")).alias("requete")).distinct()


@query
def fn_f6_geocode_key(spark, d):
    return table(spark, d, "dpe_clean").select(text.geocode_key(F.col("adresse_geocodage")).alias("cle")).distinct()


@query
def fn_f7_label_group(spark, d):
    return stats.count_by(_linked(spark, d).select("etiquette_dpe", text.label_group(F.col("etiquette_dpe")).alias("groupe")), "etiquette_dpe", "groupe")


@query
def fn_f8_registry_town(spark, d):
    return table(spark, d, "dpe_clean").select("nom_commune_ban", text.registry_town(F.col("nom_commune_ban")).alias("nom")).distinct()


@query
def fn_f9_haversine(spark, d):
    """Distance of each geocoded lot to a fixed point."""
    return table(spark, d, "dvf_geocoded").select("lot_id", F.round(haversine_m(F.col("lat"), F.col("lon"), F.lit(42.0), F.lit(-30.5)), 3).alias("m")).distinct()


@query
def fn_f14_cache_key(spark, d):
    key = scoring.cache_key(F.col("code_insee"), F.col("no_disposition"), F.col("date_mutation"), F.trim("adresse_brute"), F.lit("v1"))
    return _linked(spark, d).select("match_id", key.alias("cle"))


@query
def fn_f23_class_edges(spark, d):
    return stats.class_edges(table(spark, d, "agg_iris"), "mediane")


@query
def fn_f24_extent(spark, d):
    return spatial.extents(table(spark, d, "iris_polygones"))


# --- joins and linkage ---


@query
def join_j1_calibration(spark, d):
    return _rounded(linkage.calibration_pairs(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean")), 3).select("adresse", "distance_m")


@query
def join_j2_exact(spark, d):
    pool = linkage.exact_candidates(linkage.profiles(table(spark, d, "dvf_geocoded")).select(*linkage.PROFILE).distinct(), linkage._certificates(table(spark, d, "dpe_clean")))
    return pool.select("code", "adresse", "kind", "numero_dpe")


@query
def join_j3_distance(spark, d):
    pool = linkage.near_candidates(linkage.profiles(table(spark, d, "dvf_geocoded")).select(*linkage.PROFILE).distinct(), linkage._certificates(table(spark, d, "dpe_clean")))
    return pool.select("code", "adresse", "lat", "lon", "kind", "numero_dpe")


@query
def join_j4_without_town(spark, d):
    return table(spark, d, "dpe_clean").where(F.trim(F.coalesce("code_insee_ban", F.lit(""))) == "").select("numero_dpe").distinct()


@query
def join_j5_region(spark, d):
    """Every geocoded lot with the polygon that holds it, and how it was placed."""
    return spatial.placement(table(spark, d, "dvf_geocoded").select("lot_id", "lat", "lon").distinct(), table(spark, d, "iris_polygones"))


@query
def join_j6_geocode_cache(spark, d):
    """Lots against the certificates' coordinates as a cache of addresses."""
    cache = table(spark, d, "dpe_clean").select(text.geocode_key(F.concat_ws(" ", F.col("adresse_brut"), "code_postal_ban", "nom_commune_ban")).alias("cle"), "lat", "lon")
    lots = table(spark, d, "dvf_clean").select("lot_id", text.geocoding_query(F.col("adresse_brute"), F.col("code_postal"), F.col("commune")).alias("adresse_geocodage")).distinct()
    return stats.count_by(geocode.geocode(lots, cache), "statut_geocodage")


@query
def join_j6_to_look_up(spark, d):
    cache = table(spark, d, "dpe_clean").select(text.geocode_key(F.concat_ws(" ", F.col("adresse_brut"), "code_postal_ban", "nom_commune_ban")).alias("cle"))
    lots = table(spark, d, "dvf_clean").select(text.geocoding_query(F.col("adresse_brute"), F.col("code_postal"), F.col("commune")).alias("adresse_geocodage"))
    return geocode.to_look_up(lots, cache)


@query
def join_j9_choropleth(spark, d):
    values = marts.iris_map(table(spark, d, "agg_iris").where("edition = 0"), "Maison")
    return _rounded(marts.choropleth(table(spark, d, "iris_polygones"), values))


@query
def join_j11_status_grid(spark, d):
    return marts.town_matching_grid(_linked(spark, d))


@query
def link_l1_dedup(spark, d):
    return linkage.dedup_certificates(table(spark, d, "dpe_clean")).select("numero_dpe", "adresse_normalisee", "lat", "lon")


@query
def link_l8_cascade(spark, d):
    """Every lot with its state, method, flag, certificate and carried columns."""
    return linkage.link(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean")).select("lot_id", *linkage.RESULT)


@query
def link_l11_undecided(spark, d):
    pools = linkage.undecided_pools(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))
    return pools.select("code", "adresse", "lat", "lon", "surface", "kind", "numero_dpe")


@query
def link_l12_masked(spark, d):
    pools = linkage.masked_pools(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))
    return pools.select("code", "adresse", "lat", "lon", "surface", "kind", "numero_dpe", "reponse", "regime")


@query
def link_l13_report(spark, d):
    certs = table(spark, d, "dpe_clean")
    return linkage.report(linkage.link(table(spark, d, "dvf_geocoded"), certs), certs)


# --- aggregates ---


@query
def agg_a1_by_keys(spark, d):
    return _rounded(stats.aggregate_by(table(spark, d, "dvf_clean"), ["commune", "type_local"], "prix"))


@query
def agg_a2_sales(spark, d):
    return _rounded(_points(spark, d)).select("date_mutation", "code_insee", "no_disposition", "prix", "commune", "type_local", "prix_m2", "annee", "n_lots")


@query
def agg_a2_exclusions(spark, d):
    return fold.exclusions(_lots(spark, d))


@query
def agg_a3_impact_counts(spark, d):
    return fold.impact_counts(_impact_points(spark, d))


@query
def agg_a4_market(spark, d):
    return _rounded(marts.market(_points(spark, d)))


@query
def agg_a5_labels(spark, d):
    return _rounded(marts.by_label(_impact_points(spark, d)))


@query
def agg_a6_iris(spark, d):
    return _rounded(marts.by_iris(_iris_points(spark, d)))


@query
def agg_a7_iris_year(spark, d):
    return _rounded(marts.by_iris(_iris_points(spark, d), per_year=True))


@query
def agg_a8_trend(spark, d):
    return _rounded(marts.trend(_points(spark, d), type_local="Appartement", year_from="2017"))


@query
def agg_a9_impact(spark, d):
    return _rounded(marts.impact(_impact_points(spark, d), date_from="2022-01-01", date_to="2024-12-31"))


@query
def agg_a10_breakdown(spark, d):
    return marts.impact_breakdown(_impact_points(spark, d), type_local="Appartement", group="D")


@query
def agg_a11_statuses(spark, d):
    return stats.count_by(_linked(spark, d), "match_status")


@query
def agg_a12_rate(spark, d):
    return _rounded(marts.matching_rate(_linked(spark, d)))


@query
def agg_a13_town_matching(spark, d):
    return marts.town_matching(_linked(spark, d))


@query
def agg_a14_best_status(spark, d):
    return marts.sales_by_best_status(_linked(spark, d))


@query
def agg_a15_vintage(spark, d):
    return stats.span(table(spark, d, "dvf_clean").select(F.col("date_mutation").cast("string").alias("jour")), "jour")


@query
def agg_a16_by_town(spark, d):
    return stats.count_by(table(spark, d, "dpe_clean"), "code_insee_ban")


@query
def agg_a17_distances(spark, d):
    pairs = linkage.calibration_pairs(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))
    return _rounded(stats.distribution(pairs, "distance_m"), 3)


@query
def agg_a18_histogram(spark, d):
    pairs = linkage.calibration_pairs(table(spark, d, "dvf_geocoded"), table(spark, d, "dpe_clean"))
    return stats.histogram(pairs.select(F.round("distance_m", 6).alias("distance_m")), "distance_m", DISTANCE_EDGES)


@query
def agg_a21_colour_range(spark, d):
    return stats.value_range(table(spark, d, "agg_iris").where("type_local = 'Maison'"), "mediane")


@query
def agg_a22_centre(spark, d):
    c = spatial.centre(table(spark, d, "iris_polygones"), prefix="96")
    return c.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query
def agg_a25_readd(spark, d):
    sums = marts.iris_year_sums(marts.by_iris(_iris_points(spark, d), per_year=True))
    return _rounded(marts.readd_iris(sums, "2018", "2022"))


@query
def agg_a25_readd_counts(spark, d):
    return marts.readd_counts(marts.impact_counts_by_year(_impact_points(spark, d)), "2021", "2024")


@query
def sort_o2_series(spark, d):
    return stats.ordered(filters.filter_market(table(spark, d, "agg_marche"), commune="Vaumirac", type_local="Maison"), ["annee", "edition"])


@query
def sort_o5_sample(spark, d):
    return scoring.sample(_linked(spark, d).select("match_id", F.sha2(F.col("match_id").cast("string"), 256).alias("cle")), "cle", 50)


@query
def sort_o6_stratified(spark, d):
    keyed = _linked(spark, d).select("match_id", "match_status", F.sha2(F.col("match_id").cast("string"), 256).alias("cle"))
    return scoring.stratified_sample(keyed, "match_status", "cle", 20)


@query
def sort_o7_years(spark, d):
    return table(spark, d, "agg_marche").agg(F.min("annee").alias("premiere"), F.max("annee").alias("derniere"))


# --- cubes ---


@query
def cube_m1_impact(spark, d):
    return _rounded(marts.impact_cube(_impact_points(spark, d)))


@query
def cube_m2_counts(spark, d):
    return marts.impact_counts_by_year(_impact_points(spark, d))


@query
def cube_m3_iris_sums(spark, d):
    return _rounded(marts.iris_year_sums(marts.by_iris(_iris_points(spark, d), per_year=True)), 2)


@query
def cube_m4_trend_by_type(spark, d):
    return _rounded(marts.trend_by_type(_points(spark, d)))


@query
def cube_m5_ladder(spark, d):
    return _rounded(marts.label_ladder(_impact_points(spark, d)))


@query
def cube_m6_towns(spark, d):
    return _rounded(marts.town_table(table(spark, d, "agg_marche").where("edition = 1"), "2024", 5))


@query
def cube_m7_iris_map(spark, d):
    return marts.iris_map(table(spark, d, "agg_iris").where("edition = 0"), "Appartement", "moyenne", "96007")


@query
def cube_m8_evolution(spark, d):
    series = table(spark, d, "agg_marche").where("edition = 0 AND commune = 'Vaumirac' AND type_local = 'Maison'").select("annee", F.col("moyenne").alias("prix"))
    return _rounded(marts.evolution(series, "2025"))


@query
def cube_m10_label_arrays(spark, d):
    return marts.label_arrays(_impact_points(spark, d))


@query
def cube_m12_discount(spark, d):
    return _rounded(marts.discount(_impact_points(spark, d)))


@query
def cube_m13_series(spark, d):
    return _rounded(marts.series_of_cube(marts.impact_cube(_impact_points(spark, d)), "Vaumirac", "2018", "2023"))


# --- scoring ---


@query
def score_d4_decisions(spark, d):
    return _rounded(cases.decided(spark, d).select("code", "adresse", "numero_dpe", "score", "marge", "confiance", "motif", "correct_top1", "match_status"))


@query
def score_a19_accuracy(spark, d):
    return _rounded(stats.accuracy_by(cases.decided(spark, d), "confiance", "correct_top1", CONFIDENCE_EDGES))


@query
def score_a19_margins(spark, d):
    return _rounded(stats.accuracy_by(cases.decided(spark, d), "marge", "correct_top1", MARGIN_EDGES))


@query
def score_a20_summary(spark, d):
    return _rounded(scoring.summarize(cases.decided(spark, d)))


def queries() -> dict[str, Query]:
    return _QUERIES | cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
