"""Same postal address written differently.

1. Reading. A text is folded (case, accents, punctuation) and read into number, repetition (bis, ter, ...), way type and
   street name; parts that make no other location are left out: flat, building, stairs, floor, lot,
   residence, postcode and town. Abbreviations are resolved by dictionary; a way type with a typo
   keeps every type it may stand for.
2. Candidates. Street names of a town are shingled (tokens and letter bigrams of the run-together name) and MinHashed;
   names that share a band meet. In each band the best supported name, the hub, is compared with the others first, which
   settles nearly all misspelt names. Only those that could be a slip of their hub but are not close to it go on to
   meet the other names of their bands.
3. Verification. An affine-gap alignment of tokens: substitutions cost the edits between two
   tokens after the abbreviation dictionary (none for an abbreviation and its long form), two tokens may align with
   their run-together form, and leaving out a title is cheap while leaving out a name word is not. A name
   written more often than slips of the other would be (one-sided test of its count) is a street of its own, however alike.
4. Each name points to its closest verified name of higher support; following the pointers to their end gives the street. A text
   without a way type takes the one type its street has in the town, else the one type found at the same number.

Scale: texts, then names, are reduced to distinct ones before any comparing; shuffles are by (town, text), (town, name) and band. Names
that cannot be within the edits allowed are told apart in the JVM, before alignment. Hot texts and locations are split by count. Nothing is collected.

Defined results: null and blank texts, and texts without a number or a name, have no location; null towns are a
town of their own name, by the town's name, else postcode; rows repeated count once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terroir.operators.joins import spread_join
from terroir.session import cut_lineage

#: Way types and their abbreviations.
WAYS = {
    "RUE": ("R", "RU"), "AVENUE": ("AV", "AVE"), "BOULEVARD": ("BD", "BLD", "BVD", "BLVD", "BOUL"), "CHEMIN": ("CHE", "CHEM", "CH", "CHM"), "IMPASSE": ("IMP",), "ALLEE": ("ALL", "ALLEES"),
    "PLACE": ("PL",), "ROUTE": ("RTE", "RT"), "COURS": ("CRS",), "SQUARE": ("SQ",), "QUAI": ("QU",), "PASSAGE": ("PAS", "PASS"), "FAUBOURG": ("FG", "FBG"), "ESPLANADE": ("ESP",), "LOTISSEMENT": (),
    "HAMEAU": ("HAM",), "SENTIER": ("SEN",), "RUELLE": ("RLE",), "VILLA": (), "CITE": (), "COTE": (), "MONTEE": (), "TRAVERSE": ("TRA",), "VOIE": (), "PROMENADE": ("PROM",), "ROND POINT": ("RPT",),
}
#: Titles and qualifiers within names.
TITLES = {
    "SAINT": ("ST", "S"), "SAINTE": ("STE",), "GENERAL": ("GAL", "GEN"), "DOCTEUR": ("DR", "DOCT"), "COMMANDANT": ("CDT", "CMDT", "COM", "CT", "CDANT"), "CAPITAINE": ("CNE", "CAP"), "COLONEL": ("COL",),
    "MARECHAL": ("MAL", "MAR"), "PRESIDENT": ("PDT", "PRES"), "PROFESSEUR": ("PR", "PROF"), "LIEUTENANT": ("LT",), "ABBE": (), "MONSEIGNEUR": ("MGR",), "AMIRAL": ("AMAL",), "SERGENT": ("SGT",), "PORTE": ("PTE",),
}
PARTICLES = frozenset(("DE", "DU", "DES", "LA", "LE", "LES", "D", "L", "AU", "AUX", "ET", "EN", "SUR"))
REPETITIONS = {"B": "BIS", "BIS": "BIS", "T": "TER", "TER": "TER", "Q": "QUATER", "QUATER": "QUATER"}
UNITS = frozenset(("APT", "APPT", "APPART", "APPARTEMENT", "APP", "BAT", "BATIMENT", "BT", "ESC", "ESCALIER", "ETAGE", "ETG", "LOT", "PORTE", "ENTREE", "CAGE", "BOITE", "BP"))
RESIDENCES = frozenset(("RESIDENCE", "RES", "RESID", "IMMEUBLE", "IMM"))
NUMBER_MARKS = frozenset(("NO", "N", "NUM", "NUMERO"))

WAY_OF = {a: w for w, short in WAYS.items() for a in (w, *short)}
TITLE_OF = {a: t for t, short in TITLES.items() for a in (t, *short)}

#: Parameters: bands and rows of the signature; edits a street name may differ by; greatest share of one slip among the writings of a name, and
#: standard deviations by which its count may exceed that.
BANDS, ROWS, EDITS, SLIP, SIGMAS = 40, 3, 3.0, 0.2, 2.33


def fold(text: str) -> str:
    """Upper case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("œ", "oe").replace("Œ", "OE").replace("°", "o")).upper() if not unicodedata.combining(c))


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most + 1`` beyond that."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=50_000)
def ways_meant(token: str) -> tuple[str, ...]:
    """The way types a token stands for: exactly, or with one edit (two in a word of seven letters or more)."""
    if token in WAY_OF:
        return (WAY_OF[token],)
    if len(token) < 3 or token in TITLE_OF or token in PARTICLES:
        return ()
    near = sorted((edits(token, w, 2), w) for w in WAYS)
    best = near[0][0]
    if best > (2 if len(token) >= 6 else 1):
        return ()
    return tuple(w for d, w in near if d == best)


def read(text: str | None, town: str | None = None) -> tuple[str, str, str, str] | None:
    """(number, repetition, way types joined by |, name) of an address, or None. The name has long titles and no particles."""
    if not text:
        return None
    tokens = re.findall(r"[A-Z]+|\d+", fold(text))
    place = re.findall(r"[A-Z]+", fold(town)) if town else []
    kept: list[str] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        after = tokens[i + 1 : i + 3]
        if t in UNITS and after:
            skip = 1 if after[0] in NUMBER_MARKS and len(after) > 1 and after[1].isdigit() else 0
            value = tokens[i + 1 + skip]
            if value.isdigit() or len(value) == 1:
                i += 2 + skip
                continue
        if t in RESIDENCES and kept:
            i += 1
            while i < len(tokens) and not tokens[i].isdigit() and tokens[i : i + len(place)] != place:
                i += 1
            continue
        if t == "RDC" or (t.isdigit() and len(t) == 5) or (t in NUMBER_MARKS and after and (after[0].isdigit() or after[0] in NUMBER_MARKS)):
            i += 1
            continue
        if place and tokens[i : i + len(place)] == place and kept and i + len(place) >= len(tokens) - 1:
            i += len(place)
            continue
        kept.append(t)
        i += 1
    at = next((k for k, t in enumerate(kept) if t.isdigit()), None)
    if at is None:
        return None
    number, repetition, rest = kept[at].lstrip("0") or "0", "", kept[:at]
    tail = kept[at + 1 :]
    if tail and tail[0] in REPETITIONS:
        repetition, tail = REPETITIONS[tail[0]], tail[1:]
    rest = [t for t in rest + tail if not t.isdigit()]
    if not rest:
        return None
    ways = ways_meant(rest[0]) if len(rest) > 1 else ()
    if ways:
        rest = rest[1:]
    elif len(rest) > 2 and len(rest[0]) <= 2 and rest[0] not in PARTICLES and rest[0] not in TITLE_OF:
        rest = rest[1:]  # a way type too short to tell
    name = [t for t in rest if t not in PARTICLES]
    name = [TITLE_OF.get(t, t) if k < len(name) - 1 else t for k, t in enumerate(name)]
    return (number, repetition, "|".join(ways), " ".join(name)) if name else None


def alignment(a: list[str], b: list[str], most: float = EDITS) -> float:
    """Least cost of aligning two names token by token, with affine gaps."""
    inf = float("inf")

    def gap(token: str, opened: bool) -> float:
        base = 0.5 if token in TITLE_OF else 0.5 * len(token)
        return base if opened else base + 0.5

    def change(x: str, y: str) -> float:
        x, y = TITLE_OF.get(x, x), TITLE_OF.get(y, y)
        d = edits(x, y, int(most) + 1)
        return d if d <= most and d * 3 <= max(len(x), len(y)) else inf

    n, m = len(a), len(b)
    # M: aligned, X: a gap in b, Y: a gap in a
    M, X, Y = ([[inf] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    M[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                X[i][j] = min(min(M[i - 1][j], Y[i - 1][j]) + gap(a[i - 1], False), X[i - 1][j] + gap(a[i - 1], True))
            if j:
                Y[i][j] = min(min(M[i][j - 1], X[i][j - 1]) + gap(b[j - 1], False), Y[i][j - 1] + gap(b[j - 1], True))
            best = lambda p, q: min(M[p][q], X[p][q], Y[p][q])
            if i and j:
                M[i][j] = best(i - 1, j - 1) + change(a[i - 1], b[j - 1])
            if i > 1 and j:
                M[i][j] = min(M[i][j], best(i - 2, j - 1) + change(a[i - 2] + a[i - 1], b[j - 1]))
            if i and j > 1:
                M[i][j] = min(M[i][j], best(i - 1, j - 2) + change(a[i - 1], b[j - 2] + b[j - 1]))
    return min(M[n][m], X[n][m], Y[n][m])


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**61 - 1, size=(n, 2), dtype=np.uint64)


def signature(name: str, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Band hashes of a name's shingles: its tokens and the letter bigrams of its run-together words."""
    import xxhash

    words = [t for t in name.split(" ") if t not in TITLES] or name.split(" ")
    whole = "^" + "".join(words) + "$"
    shingles = {whole[k : k + 2] for k in range(len(whole) - 1)} | {" " + w for w in words}
    x = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)
    seeds = _cached_seeds(bands * rows)
    with np.errstate(over="ignore"):
        h = (x[:, None] ^ seeds[None, :, 0]) * (seeds[None, :, 1] | np.uint64(1))
        h ^= h >> np.uint64(29)
        least = h.min(axis=0).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=k) - 2**63 for k, row in enumerate(least)]


@lru_cache(maxsize=4)
def _cached_seeds(n: int) -> np.ndarray:
    return _seeds(n)


def parse_texts(texts: DataFrame) -> DataFrame:
    """town, text and number, repetition, ways, name of those that can be read; input: town, text, town_name."""

    def run(batches):
        for pdf in batches:
            got = [read(t, n) for t, n in zip(pdf["text"], pdf["town_name"])]
            keep = [k for k, g in enumerate(got) if g]
            parts = pd.DataFrame([got[k] for k in keep], columns=["number", "repetition", "ways", "name"])
            yield pd.concat([pdf[["town", "text"]].iloc[keep].reset_index(drop=True), parts], axis=1)

    return texts.select("town", "text", "town_name").mapInPandas(run, "town string, text string, number string, repetition string, ways string, name string")


def street_roots(parsed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """town, name, root: the street name that each written name stands for."""
    names = parsed.groupBy("town", "name").agg(F.count(F.lit(1)).alias("support"))

    def sign(batches):
        for pdf in batches:
            yield pdf.assign(sig=[signature(n, bands, rows) for n in pdf["name"]])

    titles = F.filter(F.split("name", " "), lambda w: w.isin(*TITLE_OF))
    plain = F.array_join(F.filter(F.split("name", " "), lambda w: ~w.isin(*TITLE_OF)), "")
    # a name's place in the order of support, ties by a hash, as one number that stands for the name until names are compared
    place = F.shiftleft("support", 31).bitwiseOR(F.pmod(F.xxhash64("town", "name"), F.lit(1 << 31)))
    signed = names.mapInPandas(sign, "town string, name string, support long, sig array<long>")
    signed = cut_lineage(signed.select(place.alias("place"), "town", "name", "support", F.replace("name", F.lit(" "), F.lit("")).alias("whole"), plain.alias("plain"), F.size(titles).alias("titles"), "sig"))
    exploded = signed.select("place", "town", F.posexplode("sig").alias("band", "h"))
    banded = exploded.select(F.xxhash64("town", "band", "h").alias("band"), "place")
    # the hub of a band: the best supported name; a map-side reduction
    hubs = banded.groupBy("band").agg(F.max("place").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    first = cut_lineage(banded.join(hubs, "band").where(_may_be_slip()))
    close = cut_lineage(_verified(first, signed))
    # the rest meets all names of its bands; a name that is no slip of the hub, whose support is highest, is none of the others
    open_ = first.join(close.select("place").distinct(), "place", "left_anti").withColumnRenamed("hub", "seen")
    rest = spread_join(open_, banded.select("band", F.col("place").alias("hub")), ["band"], ["place"]).where((F.col("hub") != F.col("seen")) & _may_be_slip())
    checked = close.unionByName(_verified(rest, signed))
    # the closest name; of equally close ones the best supported
    chain = cut_lineage(checked.groupBy("town", "name").agg(F.min(F.struct("cost", (-F.col("hub_support")).alias("s"), "hub"))["hub"].alias("hub")))
    while True:  # (support, name) grows along a chain, so there are no circles; what is left of a chain halves each time
        nxt = chain.select("town", F.col("name").alias("hub"), F.col("hub").alias("next"))
        if chain.join(nxt, ["town", "hub"], "left_semi").isEmpty():
            break
        chain = cut_lineage(chain.join(nxt, ["town", "hub"], "left").select("town", "name", F.coalesce("next", "hub").alias("hub")))
    return signed.select("town", "name").join(chain, ["town", "name"], "left").select("town", "name", F.coalesce("hub", "name").alias("root"))


def slip_limit(support: Column) -> Column:
    """The greatest count with which a slip of a name of this support may be met."""
    return SLIP * support + SIGMAS * F.sqrt(SLIP * support) + 0.5


def _may_be_slip() -> Column:
    support = lambda c: F.shiftright(c, 31)
    return (F.col("hub") > F.col("place")) & (support("place") <= slip_limit(support("hub")))


def _verified(met: DataFrame, names: DataFrame) -> DataFrame:
    """place, town, name, hub, hub_support, cost of the pairs (place, hub) within the edits allowed. Places and bands are hashed: should two names share
    one, more pairs are compared, but only within a town."""
    # an alignment of cost c takes 2c edits of letters at most once titles left out on one side are set apart
    most = int(2 * EDITS)
    side = lambda x: names.select(F.col("place").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("town", "name", "support", "whole", "plain", "titles")])
    near = lambda c: F.levenshtein(F.col(f"place_{c}"), F.col(f"hub_{c}"), most) >= 0
    both = met.select("place", "hub").distinct().join(side("place"), "place").join(side("hub"), "hub").where((F.col("place_town") == F.col("hub_town")) & (near("whole") | near("plain") | (F.col("place_titles") + F.col("hub_titles") > 1)))

    def verify(batches):
        for pdf in batches:
            pdf = pdf.assign(cost=[alignment(a.split(" "), b.split(" ")) for a, b in zip(pdf["name"], pdf["hub"])])
            yield pdf[pdf["cost"] <= EDITS]

    lean = both.select("place", F.col("place_town").alias("town"), F.col("place_name").alias("name"), F.col("hub_name").alias("hub"), "hub_support")
    return lean.mapInPandas(verify, "place long, town string, name string, hub string, hub_support long, cost double")


def locate(texts: DataFrame) -> DataFrame:
    """town, text, number, repetition, way, root: the location each text stands for; ``way`` is '' where it
    cannot be told. Input: town, text, town_name, distinct (town, text)."""
    parsed = cut_lineage(parse_texts(texts))
    rooted = parsed.join(street_roots(parsed), ["town", "name"])
    sure = (F.col("ways") != "") & ~F.col("ways").contains("|")
    known = rooted.where(sure).groupBy("town", "root", F.col("ways").alias("way")).agg(F.count(F.lit(1)).alias("n"))
    # the types of a street name in its town; a type met once beside one met ten times as often is taken for a slip
    types = known.groupBy("town", "root").agg(F.collect_set(F.struct("way", "n")).alias("known"))
    here = rooted.where(sure).groupBy("town", "root", "number", "repetition").agg(F.collect_set("ways").alias("here"))
    both = rooted.join(types, ["town", "root"], "left").join(here, ["town", "root", "number", "repetition"], "left")
    possible = F.transform("known", lambda k: k["way"])
    meant = F.split("ways", r"\|")
    fits = lambda a: F.when(F.col("ways") == "", a).otherwise(F.array_intersect(a, meant))
    a, b = fits(possible), fits(F.col("here"))
    way = F.when(sure, F.col("ways")).when(F.size(a) == 1, a[0]).when(F.size(b) == 1, b[0]).otherwise(F.lit(""))
    return both.select("town", "text", "number", "repetition", way.alias("way"), "root")


def town_texts(rows: DataFrame, town: str, text: str, town_name: str, postcode: str) -> DataFrame:
    """Distinct (town, text) of a table, with the town's name."""
    key = F.coalesce(F.nullif(F.trim(town), F.lit("")), F.nullif(F.upper(F.trim(town_name)), F.lit("")), F.nullif(F.trim(postcode), F.lit("")), F.lit(""))
    return rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key.alias("town"), F.col(text).alias("text"), F.col(town_name).alias("town_name"))


LOCATION = ["town", "number", "repetition", "way", "root"]


def _town() -> Column:
    return F.coalesce(F.nullif(F.trim("code_insee"), F.lit("")), F.nullif(F.upper(F.trim("commune")), F.lit("")), F.nullif(F.trim("code_postal"), F.lit("")), F.lit(""))


def _placed(lots: DataFrame) -> DataFrame:
    keyed = town_texts(lots, "code_insee", "adresse_brute", "commune", "code_postal")
    return locate(keyed.groupBy("town", "text").agg(F.max("town_name").alias("town_name")))


def _texts_of_lots(lots: DataFrame) -> DataFrame:
    return lots.where(F.col("lot_id").isNotNull() & (F.trim("adresse_brute") != "")).select(_town().alias("town"), F.col("adresse_brute").alias("text"), F.col("lot_id").alias("lot")).distinct()


def classes(lots: DataFrame) -> DataFrame:
    """lot_id, town, number, repetition, way, root: the location of every writing of every lot, one row each; lots whose
    addresses denote no location are left out. This is the form of the result that grows with the lots, not with their pairs."""
    rows = _texts_of_lots(lots)
    return rows.join(_placed(lots), ["town", "text"]).select(F.col("lot").alias("lot_id"), *LOCATION).distinct()


def found(lots: DataFrame) -> DataFrame:
    """lot_a < lot_b whose raw addresses are non-blank, differ and denote one location."""
    placed = cut_lineage(_placed(lots))
    # pairs of texts within a location, each once; then the lots of either
    pairs = spread_join(placed.select(*LOCATION, F.col("text").alias("text_a")), placed.select(*LOCATION, F.col("text").alias("text_b")), LOCATION, ["text_a"], hot=1_000)
    pairs = pairs.where(F.col("text_a") < F.col("text_b")).select("town", "text_a", "text_b")
    rows = cut_lineage(_texts_of_lots(lots))
    first = spread_join(rows.select("town", F.col("text").alias("text_a"), F.col("lot").alias("a")), pairs, ["town", "text_a"], ["a"]).select("town", "text_b", "a")
    both = spread_join(rows.select("town", F.col("text").alias("text_b"), F.col("lot").alias("b")), first, ["town", "text_b"], ["b"])
    return both.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lot_a"), F.greatest("a", "b").alias("lot_b")).distinct()
