"""Text functions of the cleaning steps, as Columns: accents, addresses, decimals, keys and labels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole words that are spelled out in a normalised address.
ABBREVIATIONS = {
    "ALL": "ALLEE", "AV": "AVENUE", "AVE": "AVENUE", "BD": "BOULEVARD", "BLVD": "BOULEVARD", "CHE": "CHEMIN", "CHEM": "CHEMIN", "CRS": "COURS", "ESP": "ESPLANADE",
    "FBG": "FAUBOURG", "FG": "FAUBOURG", "GAL": "GENERAL", "HAM": "HAMEAU", "IMP": "IMPASSE", "LOT": "LOTISSEMENT", "PAS": "PASSAGE", "PL": "PLACE", "PTE": "PORTE",
    "QU": "QUAI", "R": "RUE", "RES": "RESIDENCE", "RTE": "ROUTE", "SQ": "SQUARE", "ST": "SAINT", "STE": "SAINTE",
}
#: Groups of energy labels.
LABEL_GROUPS = {"A": "A-C", "B": "A-C", "C": "A-C", "D": "D", "E": "E", "F": "F-G", "G": "F-G"}

_SPACES = r"(?U)\s+"
_MARK = "\u0001"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their replacements, characters with longer replacements): compatibility forms and letters with
    marks become what they are built on; marks alone vanish."""
    one, to, gone, longer = [], [], [], []
    for cp in (*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(cp)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base == c or c.isspace():
            continue
        if len(base) == 1:
            one.append(c)
            to.append(base)
        elif base.isascii() and base.isalpha():
            longer.append((c, base))
    return "".join(one + gone), "".join(to), tuple(longer)


def fold_accents(c: Column) -> Column:
    """Letters without marks and compatibility characters in their plain form; ligatures Œ and Æ stay."""
    source, target, longer = _fold_table()
    plain = F.translate(c, source, target)
    # ligatures and other forms of several letters are rare: they are only looked for where one occurs
    several = "[" + "".join(x for x, _ in longer) + "]"
    spelled = reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), longer, plain)
    return F.when(plain.rlike(several), spelled).otherwise(plain)


def collapse(c: Column) -> Column:
    """Runs of any white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def normalize_address(c: Column) -> Column:
    """Upper case, no accents, single spaces, abbreviations spelled out as whole words; null gives ''. Control characters U+0001 vanish.

    Abbreviations are marked in one pass and looked up in a map, however many there are."""
    text = collapse(F.upper(fold_accents(F.replace(F.coalesce(c, F.lit("")), F.lit("’"), F.lit("'")))))
    any_of = "|".join(sorted(ABBREVIATIONS, key=lambda s: (-len(s), s)))
    marked = F.regexp_replace(F.translate(text, _MARK, ""), rf"(?U)\b({any_of})\b\.?", f"{_MARK}$1{_MARK}")
    long = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(marked, _MARK), lambda part, k: F.when(k % 2 == 1, long[part]).otherwise(part)), "")
    return collapse(F.when(marked.contains(_MARK), spelled).otherwise(marked))


def parse_french_decimal(c: Column) -> Column:
    """'273400,00' to 273400.0; blank and unreadable texts to null."""
    text = F.replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(","), F.lit("."))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def _part(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def compose_address(number: Column, repetition: Column, way: Column, name: Column) -> Column:
    """Trimmed, non-blank parts joined by one space; '' without any."""
    return F.concat_ws(" ", *[_part(p) for p in (number, repetition, way, name)])


def geocoding_query(street: Column, postcode: Column, town: Column, trim_postcode: bool = True) -> Column:
    """Street, postcode and town in one line, blanks skipped; null without a street."""
    s = F.nullif(collapse(F.coalesce(street, F.lit(""))), F.lit(""))
    p = _part(postcode) if trim_postcode else F.nullif(postcode.cast("string"), F.lit(""))
    return F.when(s.isNotNull(), F.concat_ws(" ", s, p, _part(town)))


def geocode_key(c: Column) -> Column:
    """Cache key of an address: single spaces, lower case."""
    return F.lower(collapse(c))


def label_group(c: Column) -> Column:
    """A-C, D, E or F-G of a label, whatever its case and blanks; else null."""
    label = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), list(LABEL_GROUPS.items())[1:], F.when(label == "A", "A-C"))


def registry_town(c: Column) -> Column:
    """The town as the sales registry spells it: ASCII capitals, apostrophes as spaces."""
    return F.replace(F.upper(F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")), F.lit("'"), F.lit(" "))


def sale_year(c: Column) -> Column:
    """First four characters of an ISO date; '' is null."""
    return F.nullif(F.substring(c, 1, 4), F.lit(""))


def signed_percent(c: Column, digits: int = 1) -> Column:
    """+3.1 % or, with the true minus sign, −3.1 %; null of null."""
    return F.when(c.isNotNull(), F.concat(F.when(c >= 0, "+").otherwise("−"), F.format_string(f"%.{digits}f", F.abs(c)), F.lit(" %")))


def window_label(years: Column, start: Column, oldest: Column) -> Column:
    """'1 an', '5 ans', or 'depuis' and the start year for the window that reaches the oldest year."""
    return F.when(years == 1, "1 an").when(years == 5, "5 ans").otherwise(F.concat(F.lit("depuis "), F.coalesce(start, oldest).cast("string")))


def resource_year(c: Column) -> Column:
    """The first year 20xx in a title as a number, else null."""
    return F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).cast("int")
