"""Linking sale lots to certificates inside a town: exact address, else distance, then kind of building, floor area and consensus
of labels, always ending in one of four states.

The outcome is a function of six columns of a lot (its profile), so distinct profiles are linked and the lots joined back. The exact pass is an
equi-join on (town, address); the distance pass, for profiles it left without candidates, an equi-join on grid cells followed by the exact box and
distance tests. Candidates are then judged by windows over the profile and reduced to one row.

The box of the distance pass is part of the meaning: at 111 320 m a degree it is a hair tighter than the circle.

Scale: no pair is made that shares neither an address nor a neighbouring cell, and both sides are reduced to what the outcome
depends on. At one address, certificates without duplicates and profiles are as many as there are different values, however many
rows lie there. The distance pass does not depend on the lot's address at all, nor on which of several like certificates it meets, so it joins distinct
(town, place, area, kind) with counted classes of certificates: a fallback point with a third of all lots and certificates is a
bounded number of pairs. Only pools that are themselves the result (``undecided_pools``, ``masked_pools``) list certificates one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terroir.constants import CERTAIN, REFORM, STATUSES, SURFACE_TOLERANCE
from terroir.functions.geo import DISTANCE_THRESHOLD_M, METRES_PER_DEGREE, box_half_widths, cell, haversine_m
from terroir.operators.joins import spread_join
from terroir.session import cut_lineage

PROFILE = ("code", "adresse", "lat", "lon", "surface", "kind")
#: What the distance pass depends on.
PLACE = ("code", "lat", "lon", "surface", "kind")
#: Degrees of latitude from which on cells are not told apart by longitude.
POLAR = 89.0
CARRIED = ("etiquette_dpe", "etiquette_ges", "type_batiment", "periode_construction")


def dedup_certificates(certs: DataFrame) -> DataFrame:
    """One certificate per (town, address, rounded area, label, GES, period, building): the latest by (date, id, lat, lon, area), nulls lowest.
    Certificates without an address or a town are all kept."""
    addr, town = F.trim(F.coalesce("adresse_normalisee", F.lit(""))), F.trim(F.coalesce("code_insee_ban", F.lit("")))
    keyed = certs.withColumns({"_a": addr, "_t": town, "_s": F.round("surface_habitable_logement", 1)})
    whole = F.struct(F.coalesce("date_etablissement_dpe", F.lit("")).alias("d"), F.coalesce("numero_dpe", F.lit("")).alias("i"), "lat", "lon", "surface_habitable_logement", F.struct(*[F.col(c) for c in certs.columns]).alias("row"))
    grouped = keyed.where((F.col("_a") != "") & (F.col("_t") != "")).groupBy("_t", "_a", "_s", "etiquette_dpe", "etiquette_ges", "periode_construction", "type_batiment").agg(F.max(whole)["row"].alias("row")).select("row.*")
    return grouped.unionByName(keyed.where((F.col("_a") == "") | (F.col("_t") == "")).select(*certs.columns))


def profiles(lots: DataFrame) -> DataFrame:
    """The six columns that decide, by lot."""
    return lots.select("*", F.trim("code_insee").alias("code"), F.coalesce("adresse_normalisee", F.lit("")).alias("adresse"), F.col("type_local").alias("kind"))


def _certificates(certs: DataFrame) -> DataFrame:
    return dedup_certificates(certs).where(F.trim(F.coalesce("code_insee_ban", F.lit(""))) != "").select(
        F.trim("code_insee_ban").alias("code"), F.col("adresse_normalisee").alias("adresse_c"), F.col("lat").alias("lat_c"), F.col("lon").alias("lon_c"), F.col("surface_habitable_logement").alias("surface_c"), "numero_dpe", *CARRIED
    )


def exact_candidates(prof: DataFrame, certs: DataFrame) -> DataFrame:
    """Profiles with the certificates of their town at the same, non-empty address; ``poids`` is 1."""
    met = prof.where(F.col("adresse") != "").join(certs.withColumnRenamed("adresse_c", "adresse"), ["code", "adresse"])
    return met.select(*PROFILE, "numero_dpe", "surface_c", *CARRIED, "lat_c", "lon_c", F.col("adresse").alias("adresse_c"), F.lit("texte_exact").alias("passe"), F.lit(1).cast("long").alias("poids"))


def classes(certs: DataFrame) -> DataFrame:
    """Certificates that no outcome tells apart, as one row with their number and the least id."""
    same = ["code", "lat_c", "lon_c", "surface_c", *CARRIED]
    return certs.groupBy(*same).agg(F.min("numero_dpe").alias("numero_dpe"), F.count(F.lit(1)).alias("poids"))


def near_candidates(prof: DataFrame, certs: DataFrame, metres: float = DISTANCE_THRESHOLD_M, keys: tuple[str, ...] = PROFILE) -> DataFrame:
    """Profiles (or their distinct ``keys``) with the certificates, or classes of them, of their town inside the box and within the distance."""
    # beyond POLAR degrees a box would span ever more cells of longitude: there all of them are one
    h_lat, h_lon = box_half_widths(F.col("lat"), metres)
    pole = F.lit(-(2**62)).cast("long")
    across = lambda c, h: F.sequence(cell(c - h, metres), cell(c + h, metres))
    placed = prof.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    low, high = (F.abs("lat") - h_lat <= POLAR, F.abs("lat") + h_lat >= POLAR)
    none = F.array().cast("array<bigint>")
    columns = F.concat(F.when(low, across(F.col("lon"), F.least(h_lon, F.lit(360.0)))).otherwise(none), F.when(high, F.array(pole)).otherwise(none))
    probe = placed.withColumn("ci", F.explode(across(F.col("lat"), h_lat))).withColumn("cj", F.explode(columns))
    own = F.when(F.abs("lat_c") > POLAR, pole).otherwise(cell(F.col("lon_c"), metres))
    held = certs.where(F.col("lat_c").isNotNull() & F.col("lon_c").isNotNull()).withColumns({"ci": cell(F.col("lat_c"), metres), "cj": own})
    inside = (F.abs(F.col("lat_c") - F.col("lat")) <= h_lat) & (F.abs(F.col("lon_c") - F.col("lon")) <= h_lon) & (haversine_m(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c")) <= metres)
    weight = F.col("poids") if "poids" in certs.columns else F.lit(1).cast("long").alias("poids")
    address = [c for c in ("adresse_c",) if c in certs.columns]
    return probe.join(held, ["code", "ci", "cj"]).where(inside).select(*keys, "numero_dpe", "surface_c", *CARRIED, "lat_c", "lon_c", *address, F.lit("distance").alias("passe"), weight)


def without_exact(prof: DataFrame, certs: DataFrame) -> DataFrame:
    """Profiles that no certificate shares an address with."""
    met = certs.where(F.col("adresse_c") != "").select("code", F.col("adresse_c").alias("adresse")).distinct()
    return prof.join(met, ["code", "adresse"], "left_anti")


def candidates(lots: DataFrame, certs: DataFrame, metres: float = DISTANCE_THRESHOLD_M) -> DataFrame:
    """All candidates of all profiles one by one, of the first pass that has any."""
    prof = profiles(lots).select(*PROFILE).distinct()
    cert = _certificates(certs)
    return exact_candidates(prof, cert).unionByName(near_candidates(without_exact(prof, cert), cert, metres))


def judged(pool: DataFrame, tolerance: float = SURFACE_TOLERANCE, keys: tuple[str, ...] = PROFILE) -> DataFrame:
    """Candidates with: n (pool), filtre (the kind of building narrowed it), garde (kept by that), m (kept), dans (area within tolerance),
    retenu (in the subset to be judged)."""
    w = Window.partitionBy(*keys)
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("poids"))).over(w), F.lit(0))
    clash = ((F.col("kind") == "Appartement") & (F.col("type_batiment") == "maison")) | ((F.col("kind") == "Maison") & (F.col("type_batiment") == "appartement"))
    ok = ~F.coalesce(clash, F.lit(False))
    near = F.coalesce(F.abs(F.col("surface") - F.col("surface_c")) <= tolerance, F.lit(False))
    a = pool.withColumns({"n": F.sum("poids").over(w), "_ok": ok, "_n_ok": number(ok)})
    a = a.withColumn("filtre", (F.col("n") > 1) & (F.col("_n_ok") > 0) & (F.col("_n_ok") < F.col("n")))
    # a single exact or near candidate is taken as it is; the filter only narrows pools
    a = a.withColumn("garde", ~F.col("filtre") | F.col("_ok")).withColumn("dans", near & F.col("garde"))
    a = a.withColumns({"m": number(F.col("garde")), "_d": number(F.col("dans"))})
    return a.withColumn("retenu", F.col("garde") & (F.col("dans") | (F.col("_d") == 0))).drop("_ok", "_n_ok")


def resolve(pool: DataFrame, tolerance: float = SURFACE_TOLERANCE, keys: tuple[str, ...] = PROFILE) -> DataFrame:
    """One row per profile with candidates: match_status, match_methode, filtre_type_applique, numero_dpe and the carried columns."""
    return outcomes(judged(pool, tolerance, keys), keys)


def outcomes(j: DataFrame, keys: tuple[str, ...] = PROFILE) -> DataFrame:
    """The outcomes of judged candidates."""
    kept = F.col("retenu")
    same = lambda c: (F.count_if(kept & F.col(c).isNotNull()) == F.count_if(kept)) & (F.min(F.when(kept, F.col(c))) == F.max(F.when(kept, F.col(c))))
    one = j.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.first("filtre").alias("filtre"), F.min("passe").alias("passe"), F.sum(F.when(kept, F.col("poids"))).alias("k"),
        F.min(F.when(kept, F.struct("numero_dpe", *CARRIED))).alias("row"), *[F.min(F.when(kept, F.col(c))).alias(f"v_{c}") for c in CARRIED], *[same(c).alias(f"u_{c}") for c in CARRIED],
    )
    single = (F.col("m") == 1) | (F.col("k") == 1)
    agreed = ~single & F.coalesce("u_etiquette_dpe", F.lit(False))
    status = F.when(single, "trouve").when(agreed, "resolu_consensus").otherwise("ambigu")
    method = F.when(F.col("m") == 1, F.col("passe")).when(F.col("k") == 1, F.concat("passe", F.lit("_surface"))).when(agreed, "consensus_etiquette")
    carried = [F.when(single, F.col("row")[c]).when(agreed & F.col(f"u_{c}"), F.col(f"v_{c}")).alias(c) for c in CARRIED]
    return one.select(*keys, status.alias("match_status"), method.alias("match_methode"), F.col("filtre").alias("filtre_type_applique"), F.when(single, F.col("row.numero_dpe")).alias("numero_dpe"), *carried)


RESULT = ("match_status", "match_methode", "filtre_type_applique", "numero_dpe", *CARRIED)


def _rejoin(lots: DataFrame, by_profile: DataFrame, how: str = "left", keys: tuple[str, ...] = PROFILE) -> DataFrame:
    on = None
    for c in keys:
        test = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        on = test if on is None else on & test
    return lots.alias("l").join(by_profile.alias("r"), on, how)


def link(lots: DataFrame, certs: DataFrame, metres: float = DISTANCE_THRESHOLD_M, tolerance: float = SURFACE_TOLERANCE) -> DataFrame:
    """Every lot with its outcome; lots keep their own columns but for those of the outcome."""
    prof, cert = profiles(lots).select(*PROFILE).distinct(), _certificates(certs)
    rest = without_exact(prof, cert)
    near = resolve(near_candidates(rest.select(*PLACE).distinct(), classes(cert), metres, PLACE), tolerance, PLACE)
    by_place = _rejoin(rest, near, "inner", PLACE).select(*[F.col(f"l.{c}") for c in PROFILE], *[F.col(f"r.{c}") for c in RESULT])
    found = resolve(exact_candidates(prof, cert), tolerance).unionByName(by_place)
    base = profiles(lots.drop(*[c for c in RESULT if c in lots.columns]))
    out = _rejoin(base, found)
    own = [F.col(f"l.{c}") for c in base.columns if c not in ("code", "adresse", "kind")]
    extra = [F.coalesce(F.col("match_status"), F.lit("non_trouve")).alias("match_status"), F.col("match_methode"), F.coalesce(F.col("filtre_type_applique"), F.lit(False)).alias("filtre_type_applique")]
    return out.select(*own, *extra, F.col("numero_dpe"), *[F.col(f"r.{c}") for c in CARRIED])


def undecided_pools(lots: DataFrame, certs: DataFrame, metres: float = DISTANCE_THRESHOLD_M, tolerance: float = SURFACE_TOLERANCE) -> DataFrame:
    """The judged candidates of every ambiguous profile."""
    pool = cut_lineage(judged(candidates(lots, certs, metres), tolerance))  # read twice
    open_ = outcomes(pool).where(F.col("match_status") == "ambigu").select(*PROFILE)
    return _rejoin(pool.where(F.col("retenu")), open_, "left_semi")


def masked_pools(lots: DataFrame, certs: DataFrame, metres: float = DISTANCE_THRESHOLD_M, tolerance: float = SURFACE_TOLERANCE) -> DataFrame:
    """For profiles found with certainty, the pool as it was before the floor area decided, and whether it had several
    (``regime`` isole or multi): cases with a known answer."""
    pool = cut_lineage(judged(candidates(lots, certs, metres), tolerance))  # read twice
    sure = outcomes(pool).where(F.col("match_status") == "trouve").select(*PROFILE, F.col("numero_dpe").alias("reponse"))
    kept = pool.where(F.col("garde"))
    out = _rejoin(kept, sure, "inner")
    return out.select(*[F.col(f"l.{c}") for c in kept.columns], F.col("reponse"), F.when(F.col("m") == 1, "isole").otherwise("multi").alias("regime"))


def report(linked: DataFrame, certs: DataFrame, cutoff: str = REFORM) -> DataFrame:
    """One row of counters over linked lots; ``pre_reforme`` counts certain lots before the cutoff, null dates included."""
    sure = F.col("match_status").isin(*CERTAIN)
    towns = certs.agg(F.count_if(F.trim(F.coalesce("code_insee_ban", F.lit(""))) == "").alias("dpe_sans_commune"))
    counted = linked.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("match_status") == s).alias(s) for s in STATUSES], F.count_if(F.col("filtre_type_applique")).alias("filtre_type"),
        F.count_if(sure & (F.coalesce(F.col("date_mutation").cast("string"), F.lit("")) < cutoff)).alias("pre_reforme"),
    )
    both = counted.unionByName(towns, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def calibration_pairs(lots: DataFrame, certs: DataFrame) -> DataFrame:
    """Distinct (address, both coordinates) of lots and certificates that share a normalised address, with their distance; not
    limited to one town."""
    a = lots.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("adresse_normalisee") != "")).select(F.col("adresse_normalisee").alias("adresse"), "lat", "lon").distinct()
    b = certs.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("adresse_normalisee").alias("adresse"), F.col("lat").alias("lat_c"), F.col("lon").alias("lon_c")).distinct()
    return spread_join(a, b, ["adresse"], ["lat", "lon"], hot=5_000).select("adresse", "lat", "lon", "lat_c", "lon_c", haversine_m(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c")).alias("distance_m"))


