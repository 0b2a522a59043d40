"""Matching entities across sources without keys: a deterministic rule cascade.

Lots without a certificate number and certificates share no key, only noisy attributes: the address, the floor area, the kind of
building and the place. The cascade is a sequence of passes, each an exact join on a weaker combination of attributes than the one
before; lots that a pass resolves are anti-joined away before the next one is made:

1. location (``addresses``) with its way type, kind of building, floor area;
2. location whose way type one side leaves open, kind, area;
3. location and kind alone, where one side lacks the area and the location is a single dwelling;
4. place on the map, kind and area, where one side has no readable address.

Areas enter as buckets as wide as the tolerance, each certificate under its own and both neighbours, places as cubes of space with
certificates under all they may reach; the exact difference decides after the join. A dwelling may have several certificates, whose areas differ: every one within
the tolerance belongs to it, so the three rules on the difference of area are graded within the first pass, not passes of their own.

Confidence of a rule is the precision of its pairs on labelled lots, those whose certificate number is known: pairs with the known number among all pairs
the rule makes for lots it resolves, smoothed by ``prior`` hits in ``weight`` pairs. Labelled lots go through the same passes, decide nothing and are
no part of the result, so all of them are held out. Where a dwelling has several certificates a label names only one, which makes the
figure a lower bound. A rule must exceed ``least``; one without labelled lots has the prior's half and gives no match.

Scale: addresses are resolved once per distinct text; lots and certificates meet by (location, bucket of area), whose hot keys are counted and
split. Labels are counted in Spark; a row per rule is what the precision reduces to.

Defined results: lots of outbuildings and of business premises are no dwellings; lots of null type may be one; without an address and without
coordinates nothing is matched, nor by a place where lots of several locations lie (a town's fallback point);
rows repeated count once; of attributes that differ within a lot the greatest is taken; coordinates may be absent from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.functions.geo import haversine_m, sphere_cells
from terroir.functions.text import registry_town
from terroir.llm import addresses
from terroir.llm.survivors import trimmed, usable_number
from terroir.operators.joins import spread_join
from terroir.session import cut_lineage

#: Parameters: m2 by which the areas of one dwelling may differ, metres by which its places may, smoothing, least confidence.
TOLERANCE, METRES, PRIOR, WEIGHT, LEAST = 3.0, 5.0, 1.0, 2.0, 0.5
_EPS = 1e-6

#: What kinds of building a type of lot may be in.
KINDS = {"Appartement": ("appartement", "immeuble"), "Maison": ("maison",)}

RULES = {
    "location, kind, area within 1": 1,
    "location, kind, area within 2": 2,
    "location, kind, area within tolerance": 3,
    "location but for the way type, kind, area": 4,
    "location, kind, single dwelling without area": 5,
    "place, kind, area": 6,
}


def towns(lots: DataFrame, certificates: DataFrame) -> DataFrame:
    """name, code: the code most rows give a town's name, for rows that lack the code."""
    both = lots.select(registry_town(F.col("commune")).alias("name"), F.nullif(F.trim("code_insee"), F.lit("")).alias("code")).unionByName(
        certificates.select(registry_town(F.col("nom_commune_ban")).alias("name"), F.nullif(F.trim("code_insee_ban"), F.lit("")).alias("code"))
    )
    counted = both.where(F.col("name").isNotNull() & F.col("code").isNotNull()).groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("name").agg(F.max(F.struct("n", "code"))["code"].alias("town_code"))


def _text(normal: str, raw: str) -> Column:
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(blank(normal), blank(raw))


def _coordinates(rows: DataFrame) -> Column:
    """(lat, lon) of a row, null unless both are there and on the globe."""
    if not {"lat", "lon"} <= set(rows.columns):
        return F.lit(None).cast("struct<lat:double,lon:double>")
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 360), F.struct(lat.alias("lat"), lon.alias("lon")))


def prepare(matched: DataFrame, certificates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lots that may be dwellings (lot_id, known number or null, kind, area, at) and certificates (numero_dpe, building, area, at), both with
    their location, null where the address denotes none."""
    lots = (
        matched.where(F.col("lot_id").isNotNull())
        .groupBy("lot_id")
        .agg(
            F.max(F.when(usable_number(F.col("numero_dpe")), F.struct(F.coalesce("confiance", F.lit(0)), "apparie_le", "match_id", F.upper(trimmed(F.col("numero_dpe"))).alias("num"))))["num"].alias("known"),
            F.max("type_local").alias("kind"), F.max("surface").alias("area"), F.max(_text("adresse_normalisee", "adresse_brute")).alias("text"),
            F.max("commune").alias("town_name"), F.max(F.nullif(F.trim("code_insee"), F.lit(""))).alias("code"), F.max(_coordinates(matched)).alias("at"),
        )
        .where(F.col("kind").isNull() | F.col("kind").isin(*KINDS))
    )
    certs = certificates.where(trimmed(F.col("numero_dpe")) != "").select(
        F.col("numero_dpe"), F.lower(trimmed(F.col("type_batiment"))).alias("building"), F.col("surface_habitable_logement").alias("area"), _text("adresse_normalisee", "adresse_brut").alias("text"),
        F.col("nom_commune_ban").alias("town_name"), F.nullif(F.trim("code_insee_ban"), F.lit("")).alias("code"), _coordinates(certificates).alias("at"),
    ).distinct()
    names = towns(matched, certificates)
    keyed = lambda d: d.withColumn("name", registry_town(F.col("town_name"))).join(names, "name", "left").withColumn("town", F.coalesce("code", "town_code", "name")).drop("name", "town_code", "code")
    lots, certs = cut_lineage(keyed(lots)), cut_lineage(keyed(certs))
    texts = lots.select("town", "text", "town_name").unionByName(certs.select("town", "text", "town_name")).where(F.col("text").isNotNull() & F.col("town").isNotNull())
    placed = cut_lineage(addresses.locate(texts.groupBy("town", "text").agg(F.max("town_name").alias("town_name"))))
    site = lambda d: d.drop("town_name").join(placed, ["town", "text"], "left").drop("text")
    lots, certs = cut_lineage(site(lots)), site(certs).distinct()
    # certificates of a house that say nothing of its area take that of the house's others
    house = F.when((F.col("building") == "maison") & (F.col("way") != ""), F.struct(*_SITE, "way"))
    areas = certs.where(house.isNotNull()).groupBy(*_SITE, "way", "building").agg(F.max("area").alias("house_area"), (F.max("area") - F.min("area")).alias("range")).where(F.col("range") <= 2 * TOLERANCE).drop("range")
    return lots, cut_lineage(certs.join(areas, [*_SITE, "way", "building"], "left").withColumn("area", F.coalesce("area", "house_area")).drop("house_area"))


_SITE = ["town", "number", "repetition", "root"]


def _fits(kind: Column, building: Column) -> Column:
    named = F.when(kind == "Maison", building == "maison").when(kind == "Appartement", building.isin(*KINDS["Appartement"]))
    return F.coalesce(named, F.lit(True))


def _buckets(certs: DataFrame, tolerance: float, *columns: str) -> DataFrame:
    """Certificates with an area under its bucket and both neighbours, for joins."""
    known = certs.where(F.col("area").isNotNull())
    near = F.explode(F.array(*[_bucket(tolerance) + k for k in (-1, 0, 1)])).alias("bucket")
    return known.select(*columns, near, "numero_dpe", "building", F.col("area").alias("area_c"))


def _bucket(tolerance: float) -> Column:
    return F.floor(F.col("area") / (tolerance + _EPS)).cast("long")


def _off() -> Column:
    return F.abs(F.col("area") - F.col("area_c"))


def by_location(lots: DataFrame, certs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pass 1: same location and way type, fitting kind, area within the tolerance; the rule is graded by the difference."""
    left = lots.where(F.col("area").isNotNull() & (F.col("way") != "")).withColumn("bucket", _bucket(tolerance))
    right = _buckets(certs.where(F.col("way") != ""), tolerance, *_SITE, "way")
    met = spread_join(left, right, [*_SITE, "way", "bucket"], ["lot_id"]).where((_off() <= tolerance + _EPS) & _fits(F.col("kind"), F.col("building")))
    return met.select("lot_id", "known", "numero_dpe", F.when(_off() <= 1 + _EPS, 1).when(_off() <= 2 + _EPS, 2).otherwise(3).alias("rule"))


def by_open_way(lots: DataFrame, certs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pass 2: the same, where one side leaves the way type open."""
    left = lots.where(F.col("area").isNotNull()).withColumn("bucket", _bucket(tolerance))
    right = _buckets(certs.withColumnRenamed("way", "way_c"), tolerance, *_SITE, "way_c")
    met = spread_join(left, right, [*_SITE, "bucket"], ["lot_id"])
    return met.where(((F.col("way") == "") | (F.col("way_c") == "")) & (_off() <= tolerance + _EPS) & _fits(F.col("kind"), F.col("building"))).select("lot_id", "known", "numero_dpe", F.lit(4).alias("rule"))


def without_area(lots: DataFrame, certs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pass 3: lots or certificates that lack the area, where all certificates of the kind at the location are of one dwelling:
    their areas differ by no more than two areas of one dwelling do."""
    houses = F.when(F.col("building") == "maison", "Maison").when(F.col("building").isin(*KINDS["Appartement"]), "Appartement")
    place = [*_SITE, "way", "house"]
    typed = certs.where(F.col("way") != "").withColumn("house", houses).where(F.col("house").isNotNull())
    single = typed.groupBy(*place).agg(F.coalesce(F.max("area") - F.min("area"), F.lit(0.0)).alias("range"), F.max("area").alias("widest")).where(F.col("range") <= 2 * tolerance).drop("range")
    right = typed.join(single, place).select(*place, "numero_dpe", F.col("area").alias("area_c"), "widest")
    house = F.explode(F.when(F.col("kind").isNull(), F.array(*[F.lit(k) for k in KINDS])).otherwise(F.array("kind"))).alias("house")
    left = lots.where(F.col("way") != "").select("*", house)
    lacking = F.col("area").isNull() | F.col("area_c").isNull()
    near = F.coalesce(F.abs(F.col("area") - F.col("widest")) <= 2 * tolerance, F.lit(True))
    return spread_join(left, right, place, ["lot_id"]).where(lacking & near).select("lot_id", "known", "numero_dpe", F.lit(5).alias("rule"))


def by_place(lots: DataFrame, certs: DataFrame, tolerance: float = TOLERANCE, metres: float = METRES) -> DataFrame:
    """Pass 4: coordinates within ``metres``, fitting kind, area within the tolerance, where one side has no location. Places
    of lots of several locations say nothing of the dwelling and are left out."""
    here = F.struct(*_SITE, "way")
    mixed = lots.where(F.col("at").isNotNull() & F.col("number").isNotNull()).groupBy("at").agg(F.min(here).alias("a"), F.max(here).alias("b")).where(F.col("a") != F.col("b")).select("at")
    own = lots.where(F.col("at").isNotNull() & F.col("area").isNotNull()).join(mixed, "at", "left_anti")
    left = own.withColumns({"bucket": _bucket(tolerance), "cube": sphere_cells(F.col("at.lat"), F.col("at.lon"), 4 * metres)[0]})
    placed = certs.where(F.col("at").isNotNull()).withColumn("cube", F.explode(sphere_cells(F.col("at.lat"), F.col("at.lon"), 4 * metres, metres)))
    right = _buckets(placed.select("cube", F.col("at").alias("at_c"), "numero_dpe", "building", "area", F.col("number").alias("number_c")), tolerance, "cube", "at_c", "number_c")
    far = haversine_m(F.col("at.lat"), F.col("at.lon"), F.col("at_c.lat"), F.col("at_c.lon"))
    blind = F.col("number").isNull() | F.col("number_c").isNull()
    met = spread_join(left, right, ["cube", "bucket"], ["lot_id"]).where(blind & (_off() <= tolerance + _EPS) & (far <= metres) & _fits(F.col("kind"), F.col("building")))
    return met.select("lot_id", "known", "numero_dpe", F.lit(6).alias("rule"))


PASSES = (by_location, by_open_way, without_area, by_place)


def passes(lots: DataFrame, certs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """lot_id, known, numero_dpe, rule of all lots, each from the first pass that resolves it."""
    todo, made = lots, []
    for one in PASSES:
        pairs = cut_lineage(one(todo, certs, tolerance))
        made.append(pairs)
        todo = todo.join(pairs.select("lot_id"), "lot_id", "left_anti")
    every = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return every.groupBy("lot_id", "known", "numero_dpe").agg(F.min("rule").alias("rule"))


def precision(pairs: DataFrame, prior: float = PRIOR, weight: float = WEIGHT) -> DataFrame:
    """rule, rule_name, n_labelled (pairs of labelled lots), hits (those with the known number), confidence (their smoothed share)."""
    labelled = pairs.where(F.col("known").isNotNull())
    counted = labelled.groupBy("rule").agg(F.count_if(F.upper(trimmed(F.col("numero_dpe"))) == F.col("known")).alias("hits"), F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[x for name, k in RULES.items() for x in (F.lit(k), F.lit(name))])
    every = pairs.sparkSession.range(1, len(RULES) + 1).select(F.col("id").cast("int").alias("rule"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(counted, "rule", "left").select("rule", names[F.col("rule")].alias("rule_name"), zero("n").alias("n_labelled"), zero("hits").alias("hits"), ((zero("hits") + prior) / (zero("n") + weight)).alias("confidence"))


def rules(matched: DataFrame, certificates: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The rules with their labelled pairs, hits and confidence."""
    return precision(passes(*prepare(matched, certificates), tolerance))


def cascade(matched: DataFrame, certificates: DataFrame, tolerance: float = TOLERANCE, least: float = LEAST) -> DataFrame:
    """lot_id, numero_dpe, rule_name, confidence of every lot without a known number that a rule resolves."""
    pairs = passes(*prepare(matched, certificates), tolerance)
    sure = precision(pairs).where(F.col("confidence") > least)
    return pairs.where(F.col("known").isNull()).join(sure, "rule").select("lot_id", "numero_dpe", "rule_name", "confidence")


def found(matched: DataFrame, certificates: DataFrame) -> DataFrame:
    return cascade(matched, certificates).select(F.col("lot_id").cast("long").alias("lot_id"), "numero_dpe")
