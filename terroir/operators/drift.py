"""Schemas that drift between files: tagged-union inference over parallel schemas.

Each line is parsed once. A file's schema is the tagged union of what its lines hold: per path the alternatives met there, types with
their counts, along with bounded histograms of the content (shapes, hashed values, magnitudes, ways of writing a date).
Schemas of files that follow each other in a flux are fused path by path into a union whose alternatives say how often each side holds
them: paths are paired by name, then lost and new ones by content. Every change is read off the fused union: a path only one side
has, an alternative that took over, another way of writing the same one (``changes``), or an alternative that merely appeared
(``appearing``). ``fused_types`` is the union of a whole flux; ``unified`` reads all lines into one table with a column for every
canonical name, in which a field has a typed branch per alternative beside its canonical conversion.

How alike two contents are does not depend on how many lines there are: likeness is relative to that of two samples, of these sizes, of one
content, and whether values repeat is judged by the share of pairs of values that agree.

Scale: lines are reduced map-side to histograms of at most a few hundred bins per (file, field), so a file or a
flux with a third of all lines is no hot task; then only the profiles of two neighbouring files meet. All reports come from one scan. ``unified`` maps each
line by the names its file uses; nothing but the removal of repeated lines is shuffled. Only names of fields and their types reach the driver, to shape its columns.

Defined results: lines that are no JSON object have no fields but count as lines; null values count as
present without a type; nested values have the type object or array; a file without lines is skipped, as
if it had not been sent; files received at the same moment follow each other by id; a field in half of
the lines or less is not part of the file's schema. The JSON type is that of most non-null values. Integers of over 18 digits count as number. Dates
whose month and day could change places are read the way the other values of the file and field are written, day first if none tells. Of a line delivered
in two versions the greater text counts.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terroir.session import cut_lineage

VALUE_BINS, SHAPE_BINS = 256, 128
#: Shares: of lines for a field to belong to a file, of values for a field to be a date.
PRESENT, DATED = 0.5, 0.8
#: Least likeness of content for a lost and a new field to be one; number of equally frequent values up to which a field has few kinds.
SAME_CONTENT, FEW_KINDS = 0.55, 40

#: Names of the months without accents, January first.
MONTHS = (
    "janvier janv jan january", "fevrier fevr fev february feb", "mars mar march", "avril avr april apr", "mai may", "juin jun june",
    "juillet juil july jul", "aout aou august aug", "septembre sept sep september", "octobre oct october", "novembre nov november", "decembre dec december",
)

def json_type(v: Column) -> Column:
    """string, integer, number, boolean, object, array, or null."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    )


def fields_of(lines: DataFrame) -> DataFrame:
    """fichier_id, ligne, premier, champ, type, texte of every field of every line; ``premier`` is true once per line, whose champ is null
    if it is no JSON object with fields."""
    spark = lines.sparkSession
    parsed = lines.select("fichier_id", "ligne", F.try_parse_json("contenu").alias("v"))
    each = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    first = (F.coalesce("pos", F.lit(0)) == 0).alias("premier")
    return each.select("fichier_id", "ligne", first, F.col("key").alias("champ"), json_type(F.col("value")).alias("type"), F.expr("try_variant_get(value, '$', 'string')").alias("texte"))


def date_code(kind: Column, text: Column) -> Column:
    """How a value writes a date; null if it is none. Years 1990 to 2049 count as plausible. ``either`` is a date whose month and day could change places."""
    number = F.try_cast(text, "long") if hasattr(F, "try_cast") else text.try_cast("long")
    year = r"(19[9]\d|20[0-4]\d)"
    month, day = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
    written = (
        F.when(text.rlike(f"^{year}-{month}-{day}$"), "iso").when(text.rlike(f"^{year}-{month}-{day}[T ]"), "iso time").when(text.rlike(f"^{year}{month}{day}$"), "compact")
        .when(text.rlike(rf"^{month}([/.-]){month}\2{year}$"), F.concat(F.lit("either"), F.substring(text, 3, 1)))
        .when(text.rlike(rf"^{month}([/.-]){day}\2{year}$"), F.concat(F.lit("month first"), F.substring(text, 3, 1)))
        .when(text.rlike(rf"^{day}([/.-]){month}\2{year}$"), F.concat(F.lit("day first"), F.substring(text, 3, 1)))
        .when(text.rlike(rf"^{year}[/.]{month}[/.]{day}$"), F.concat(F.lit("year first"), F.substring(text, 5, 1)))
        .when(text.rlike(rf"(?i)^{day}?\d? ?\p{{L}}{{3,9}}\.? {year}$"), "month name")
    )
    counted = (
        F.when(text.rlike(f"^{year}{month}{day}$"), "compact").when(number.between(7305, 29219), "days")
        .when(number.between(631152000, 2524607999), "seconds").when(number.between(631152000000, 2524607999999), "milliseconds")
    )
    # most texts are no dates: one look for a year spares them the patterns
    dated = (F.length(text).between(8, 40)) & text.rlike(year)
    return F.when((kind == "string") & dated, written).when(kind == "integer", counted)


def _month(name: Column) -> Column:
    """01 to 12 of the French or English name, or abbreviation, of a month; null for other words."""
    plain = F.translate(F.lower(name), "éèêûùôäç", "eeeuuoac")
    out = None
    for k, names in enumerate(MONTHS, 1):
        out = (F if out is None else out).when(plain.isin(*names.split()), f"{k:02d}")
    return out


def date_value(kind: Column, text: Column, month_first: Column | None = None) -> Column:
    """The date a value stands for, whatever its writing; null if none, or if a written month comes without a day. ``month_first``: how to
    read a date whose month and day could change places."""
    code, n = date_code(kind, text), text.try_cast("long")
    turned = code.startswith("month first") | (code.startswith("either") & (F.lit(False) if month_first is None else F.coalesce(month_first, F.lit(False))))
    read = lambda t, f: F.try_to_date(t, f)
    from_epoch = lambda days: F.date_add(F.to_date(F.lit("1970-01-01")), days.cast("int"))
    digits = F.regexp_replace(text, "[/.-]", "")
    return (
        F.when(code.isin("iso", "iso time"), read(F.substring(text, 1, 10), "yyyy-MM-dd")).when(code == "compact", read(text, "yyyyMMdd"))
        .when(turned, read(digits, "MMddyyyy")).when(code.startswith("day first") | code.startswith("either"), read(digits, "ddMMyyyy"))
        .when(code.startswith("year first"), read(digits, "yyyyMMdd"))
        .when(code == "month name", read(F.concat(F.right(text, F.lit(4)), _month(F.regexp_extract(text, r"\p{L}+", 0)), F.lpad(F.regexp_extract(text, r"^(\d{1,2}) ?\p{L}", 1), 2, "0")), "yyyyMMdd"))
        .when(code == "days", from_epoch(n)).when(code == "seconds", from_epoch(F.floor(n / 86400))).when(code == "milliseconds", from_epoch(F.floor(n / 86400000)))
    )


def profiles(lines: DataFrame) -> DataFrame:
    """fichier_id, champ, sorte, case, n: histograms of each field of each file, and (champ null, sorte ``l``) its number of lines."""
    fields = fields_of(lines)
    kind, text, champ = F.col("type"), F.col("texte"), F.col("champ")
    shape = F.regexp_replace(F.translate(text, "012345678", "9" * 9), r"\p{L}+", "A")
    size = F.translate(text, ",", ".").try_cast("double")
    bins = [
        ("l", F.when(F.col("premier"), "")),
        ("t", F.when(champ.isNotNull(), F.coalesce(kind, F.lit("")))),  # '' is a null value
        ("d", date_code(kind, text)),
        ("s", F.when(kind.isNotNull(), F.pmod(F.xxhash64(shape), F.lit(SHAPE_BINS)).cast("string"))),
        ("v", F.when(kind.isNotNull(), F.pmod(F.xxhash64(text), F.lit(VALUE_BINS)).cast("string"))),
        ("m", F.when(kind.isNotNull() & (size > 0), F.floor(F.log2(size) * 2)).cast("string")),
    ]
    tagged = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(s).alias("sorte"), c.alias("case"), (F.lit(None).cast("string") if s == "l" else champ).alias("champ"))) for s, c in bins])
    return fields.select("fichier_id", F.explode(F.array_compact(tagged)).alias("b")).groupBy("fichier_id", "b.champ", "b.sorte", "b.case").agg(F.count(F.lit(1)).alias("n"))


def neighbours(files: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fichier_id, n_lignes) of files with lines; (fichier_id, avant) of each file and the one before it in its flux."""
    sizes = profile.where("sorte = 'l'").select("fichier_id", F.col("n").alias("n_lignes"))
    w = Window.partitionBy("flux").orderBy("recu_le", "fichier_id")
    sent = files.select("fichier_id", "flux", "recu_le").dropDuplicates(["fichier_id"]).join(sizes, "fichier_id", "left_semi")
    return sizes, sent.select("fichier_id", F.lag("fichier_id").over(w).alias("avant")).where(F.col("avant").isNotNull())


def _overlap(a: dict, b: dict) -> float:
    """0 to 1: the overlap of two histograms relative to that expected of two samples of these sizes of one distribution. The expected
    loss is half the sum of the mean absolute differences of the shares, each about 0.8 standard deviations."""
    x, y = sum(a.values()), sum(b.values())
    if not x or not y:
        return 0.0
    shared = sum(min(a[k] / x, b[k] / y) for k in a.keys() & b.keys())
    pooled = ((a.get(k, 0) + b.get(k, 0)) / (x + y) for k in a.keys() | b.keys())
    loss = 0.4 * sum((p * (1 - p) * (1 / x + 1 / y)) ** 0.5 for p in pooled)
    return min(1.0, shared / max(1 - loss, 0.2))


def _agreeing(a: dict) -> float:
    """The share of pairs of values that fall into one bin, whatever the number of values: 1 / k for k equally frequent ones."""
    total = sum(a.values())
    return sum(n * (n - 1) for n in a.values()) / (total * (total - 1)) if total > 1 else 0.0


class Path:
    """One path of a file's schema: its tagged alternatives and histograms of its content."""

    def __init__(self):
        self.hist: dict[str, dict[str, int]] = defaultdict(dict)

    @property
    def tags(self) -> dict[str, int]:
        return {t: n for t, n in self.hist["t"].items() if t}

    @property
    def lines(self) -> int:
        """Lines that have it, nulls among them."""
        return sum(self.hist["t"].values())

    @property
    def kind(self) -> str | None:
        """The alternative of most values."""
        return max(sorted(self.tags), key=self.tags.get) if self.tags else None

    @property
    def date(self) -> str | None:
        """How most values write a date; those whose month and day could change places count as the others tell."""
        d, typed = dict(self.hist["d"]), sum(self.tags.values())
        if not typed or sum(d.values()) < DATED * typed:
            return None
        for code in [c for c in d if c.startswith("either")]:
            month, day = f"month first{code[-1]}", f"day first{code[-1]}"
            meant = month if d.get(month, 0) > d.get(day, 0) else day
            d[meant] = d.get(meant, 0) + d.pop(code)
        return max(sorted(d), key=d.get)


def likeness(a: Path, b: Path) -> float:
    """0 to 1: how alike the content of two paths of one type is. Values of few kinds are compared as values,
    numbers by magnitude, dates as dates, other texts by shape alone."""
    if a.kind is None or a.kind != b.kind:
        return 0.0
    if a.date and b.date:
        return 0.9 + 0.1 * (a.date == b.date)
    if bool(a.date) != bool(b.date):
        return 0.0
    shape = _overlap(a.hist["s"], b.hist["s"])
    if min(_agreeing(a.hist["v"]), _agreeing(b.hist["v"])) > 1 / FEW_KINDS:
        inner = _overlap(a.hist["v"], b.hist["v"])
    elif sum(a.hist["m"].values()) >= 0.5 * sum(a.tags.values()):
        inner = _overlap(a.hist["m"], b.hist["m"])
        shape = inner if a.kind != "string" else shape
    else:
        inner = shape
    return min(inner, (inner + shape) / 2 if a.kind == "string" else inner)


class Union:
    """A path of two schemas fused: the name it has on either side and every alternative with its count before and now."""

    def __init__(self, old: str | None, new: str | None, before: Path | None, now: Path | None):
        self.old, self.new, self.before, self.now = old, new, before, now
        sides = [p.tags if p else {} for p in (before, now)]
        self.alternatives = {t: (sides[0].get(t, 0), sides[1].get(t, 0)) for t in sorted(sides[0].keys() | sides[1].keys())}

    @property
    def dominant(self) -> tuple[str | None, str | None]:
        """The alternative of most values, before and now."""
        most = lambda side: max(((t, n[side]) for t, n in self.alternatives.items() if n[side]), key=lambda x: x[1], default=(None, 0))[0]
        return most(0), most(1)

    def changes(self) -> list[tuple[str, str, str]]:
        if self.before is None:
            return [("ajout", self.new, "")]
        if self.now is None:
            return [("retrait", self.old, "")]
        out = [] if self.old == self.new else [("renommage", self.old, self.new)]
        was, is_ = self.dominant
        if was and is_ and was != is_:
            out.append(("type", self.new, is_))
        elif was and is_ and self.before.date and self.now.date and self.before.date != self.now.date:
            out.append(("format", self.new, ""))
        return out

    def appeared(self) -> list[tuple[str, int]]:
        return [(t, n) for t, (m, n) in self.alternatives.items() if n and not m] if self.before else []


def fuse(before: dict[str, Path], now: dict[str, Path]) -> list[Union]:
    """The schemas of two files as one: paths of one name, lost and new ones alike in content, and those left over."""
    lost, new = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
    fused = [Union(f, f, before[f], now[f]) for f in sorted(before.keys() & now.keys())]
    for score, a, b in sorted(((likeness(before[a], now[b]), a, b) for a in lost for b in new), key=lambda x: (-x[0], x[1], x[2])):
        if score >= SAME_CONTENT and a in lost and b in new:
            lost.remove(a)
            new.remove(b)
            fused.append(Union(a, b, before[a], now[b]))
    return fused + [Union(a, None, before[a], None) for a in lost] + [Union(None, b, None, now[b]) for b in new]


def _fused(profile: DataFrame, files: DataFrame, report, schema: str) -> DataFrame:
    """fichier_id and the rows ``report`` makes of the fused union of each file and the one before it in its flux."""
    sizes, pairs = neighbours(files, profile)
    lean = profile.where("sorte <> 'l'").join(sizes, "fichier_id").withColumnRenamed("fichier_id", "de")
    now = pairs.select("fichier_id", F.col("fichier_id").alias("de"), F.lit(True).alias("present"))
    before = pairs.select("fichier_id", F.col("avant").alias("de"), F.lit(False).alias("present"))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        side: dict[bool, dict[str, Path]] = {True: {}, False: {}}
        for present, rows in pdf.groupby("present"):
            for name, r in rows.groupby("champ"):
                f = Path()
                for s, c, n in zip(r["sorte"], r["case"], r["n"]):
                    f.hist[s][c] = int(n)
                if f.lines > PRESENT * int(r["n_lignes"].iloc[0]):
                    side[bool(present)][name] = f
        found = [x for u in fuse(side[False], side[True]) for x in report(u)] if side[True] and side[False] else []
        return pd.DataFrame([(pdf["fichier_id"].iloc[0], *x) for x in found], columns=["fichier_id", *names])

    return now.unionByName(before).join(lean, "de").drop("de").groupBy("fichier_id").applyInPandas(one, f"fichier_id long, {schema}")


def changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """fichier_id, changement, champ, nouveau: each change of a file against the one before it in its flux."""
    return _changes(cut_lineage(profiles(lines)), files)


def _changes(profile: DataFrame, files: DataFrame) -> DataFrame:
    return _fused(profile, files, lambda u: u.changes(), "changement string, champ string, nouveau string")


def appearing(lines: DataFrame, files: DataFrame) -> DataFrame:
    """fichier_id, champ, type, n: alternatives of a field, by its new name, that the file before in the flux did not hold; minorities too."""
    return _fused(cut_lineage(profiles(lines)), files, lambda u: [(u.new, *x) for x in u.appeared()] if u.now else [], "champ string, type string, n long")


def fused_types(lines: DataFrame, files: DataFrame) -> DataFrame:
    """flux, champ, type, n, premier_fichier: every alternative of every path of a flux and the file (by time, then id) that brought it."""
    f = fields_of(lines).where(F.col("type").isNotNull()).groupBy("fichier_id", "champ", "type").agg(F.count(F.lit(1)).alias("n"))
    known = files.select("fichier_id", "flux", "recu_le").dropDuplicates(["fichier_id"])
    return f.join(known, "fichier_id").groupBy("flux", "champ", "type").agg(F.sum("n").alias("n"), F.min(F.struct("recu_le", "fichier_id"))["fichier_id"].alias("premier_fichier"))


def _order(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("flux").orderBy("recu_le", "fichier_id")
    return files.select("fichier_id", "flux", "recu_le").dropDuplicates(["fichier_id"]).select("fichier_id", "flux", F.row_number().over(w).alias("rang"))


def lineage(found: DataFrame, files: DataFrame) -> DataFrame:
    """flux, champ, canonique, depuis, jusque: names a field bore between two places (inclusive) in the order of its
    flux. A field never renamed has no row."""
    renames = found.where(F.col("changement") == "renommage").join(_order(files), "fichier_id").select("flux", "rang", "champ", "nouveau")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, tuple[str, int]] = {}
        out = []
        for rang, step in pdf.sort_values(["rang", "champ"]).groupby("rang", sort=True):
            moved = {}
            for old, new in zip(step["champ"], step["nouveau"]):
                canonical, since = root.pop(old, (old, None))
                if since is not None:
                    out.append((old, canonical, since, int(rang) - 1))
                moved[new] = (canonical, int(rang))
            root |= moved
        out += [(name, canonical, since, 2**31 - 1) for name, (canonical, since) in root.items()]
        return pd.DataFrame([(pdf["flux"].iloc[0], *x) for x in out if x[0] != x[1]], columns=["flux", "champ", "canonique", "depuis", "jusque"])

    return renames.groupBy("flux").applyInPandas(follow, "flux string, champ string, canonique string, depuis int, jusque int")


#: The canonical types of the delivered sale lot.
CANONICAL = {
    "identifiant_document": "string", "no_disposition": "string", "date_mutation": "date", "nature_mutation": "string", "code_insee": "string", "commune": "string",
    "code_postal": "string", "type_local": "string", "nombre_pieces_principales": "string", "surface": "double", "prix": "double",
}
#: Codes of five characters: one delivered as a number lost its leading zeros.
CODES = ("code_insee", "code_postal")


def convert(name: str, target: str, kind: Column, text: Column, month_first: Column | None = None) -> Column:
    """Canonical conversion of a value of any branch; null where it cannot be read as the target type."""
    if target == "date":
        return date_value(kind, text, month_first)
    if target == "double":
        return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    if name in CODES:
        return F.when(kind == "integer", F.lpad(text, 5, "0")).otherwise(text)
    return text


#: Type of a branch in the table; the content of nested values is kept as JSON.
BRANCHES = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean", "object": "string", "array": "string"}


def _free(name: str, taken: set[str]) -> str:
    """The name, numbered if a column is already called so; names of columns do not tell cases apart."""
    k, out = 1, name
    while out.lower() in taken:
        k, out = k + 1, f"{name}_{k + 1}"
    taken.add(out.lower())
    return out


def guides(profile: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """fichier_id, champ, canonique, type, mois_avant of every field of every file and every type met of it: its canonical name, and whether its dates
    whose month and day could change places have the month first."""
    spans = _order(files).join(lineage(found, files), "flux").where(F.col("rang").between(F.col("depuis"), F.col("jusque"))).select("fichier_id", "champ", "canonique")
    of = lambda code: F.coalesce(F.sum(F.when((F.col("sorte") == "d") & F.col("case").startswith(code), F.col("n"))), F.lit(0))
    each = profile.where("sorte IN ('t', 'd')").groupBy("fichier_id", "champ").agg(F.collect_set(F.when(F.col("sorte") == "t", F.nullif("case", F.lit("")))).alias("types"), (of("month first") > of("day first")).alias("mois_avant"))
    return each.join(spans, ["fichier_id", "champ"], "left").select("fichier_id", "champ", F.coalesce("canonique", "champ").alias("canonique"), "types", "mois_avant")


def unified(lines: DataFrame, files: DataFrame, targets: dict[str, str] = CANONICAL, branches: bool = True) -> DataFrame:
    """One row per line: fichier_id, ligne, one column per canonical name of any file, in its canonical type if it is
    a target and else as text, and, with ``branches``, ``<field>_<type>`` for every type met of it. Targets come first, then
    the other names in order; a name already taken is numbered (``<name>_2``)."""
    profile = cut_lineage(profiles(lines))
    known = cut_lineage(guides(profile, cut_lineage(_changes(profile, files)), files))
    met: dict[str, set[str]] = defaultdict(set)
    for r in known.select("canonique", F.explode_outer("types").alias("type")).distinct().collect():
        met[r["canonique"]].add(r["type"])
    # by file: canonical name -> the names it has there, and the names with the month first; files that use canonical names alone need no row
    odd = (F.col("champ") != F.col("canonique")) | F.col("mois_avant")
    named = known.groupBy("fichier_id", "canonique").agg(F.sort_array(F.collect_set("champ")).alias("champs"), F.max(odd).alias("odd"), F.max("mois_avant").alias("mois_avant"))
    guide = named.groupBy("fichier_id").agg(F.map_from_entries(F.collect_list(F.struct("canonique", F.struct("champs", "mois_avant")))).alias("guide"), F.max("odd").alias("odd")).where("odd").drop("odd")
    held = F.expr("try_variant_get(try_parse_json(contenu), '$', 'map<string, variant>')")
    rows = lines.groupBy("fichier_id", "ligne").agg(F.max("contenu").alias("contenu")).join(guide, "fichier_id", "left").select("fichier_id", "ligne", "guide", held.alias("held"))
    names = [*targets, *sorted(met.keys() - targets.keys())]
    taken = {"fichier_id", "ligne"}
    main = {name: _free(name, taken) for name in names}

    def value(name: str) -> Column:
        own = F.when(F.col("guide").isNull(), F.array(F.lit(name))).otherwise(F.col("guide")[name]["champs"])
        return F.get(F.filter(F.transform(own, lambda n: F.col("held")[n]), lambda v: v.isNotNull()), F.lit(0))

    picked = rows.select("fichier_id", "ligne", "guide", *[value(name).alias(f"v{i}") for i, name in enumerate(names)])
    text = lambda v: F.expr(f"try_variant_get({v}, '$', 'string')")
    told = picked.select("fichier_id", "ligne", "guide", *[x for i in range(len(names)) for x in (json_type(F.col(f"v{i}")).alias(f"k{i}"), text(f"v{i}").alias(f"t{i}"))])
    columns = []
    for i, name in enumerate(names):
        kind, said = F.col(f"k{i}"), F.col(f"t{i}")
        columns.append(convert(name, targets.get(name, "string"), kind, said, F.col("guide")[name]["mois_avant"]).alias(main[name]))
        if branches:
            columns += [F.when(kind == t, said.try_cast(c)).alias(_free(f"{name}_{t}", taken)) for t, c in BRANCHES.items() if t in met[name]]
    return told.select("fichier_id", "ligne", *columns)
