"""Garbled text from wrong character encoding: find it and undo it, by minimum description length.

A chain is a way text goes wrong: bytes of a true encoding read with a wrong one, once or twice. Undone, a word
is encoded with the wrong codec and decoded with the true one. Every chain that can be undone on a document's suspicious
words gives a candidate text; all candidates and the text as it stands are compressed with zstandard
dictionaries, one per language, trained here on what the whole corpus counts. The shortest description,
including what it costs to name the chain, wins; if that is the text as it stands, it is left unchanged.

Words are suspicious if a model of letter trigrams (the documents that have each, counted over all of them) finds the undone form far
likelier than the written one, however frequent that is; this only spares compressing every chain for every clean text. A replacement character is
a decoding that failed: such a document is affected but cannot be restored there.

A sequence quoted on purpose is no case: quotes right around a garbled sequence that stands for at most ``EXAMPLE`` characters, or a quoted piece whose
undone form is quoted in the same line. Lines end at line feeds, written out or escaped.

The model is fitted on every whole text. zstandard trains in one process, so it is given a text of about ``TRAINING`` phrases (a word beyond ASCII with up to
two words of its line on either side) in which each stands as often as its share of all phrases of the corpus asks; a phrase too rare for that counts for its word alone.

Scale: three passes over the whole texts: two count, one judges. Counts are added up in each task, then by a shuffle of the distinct trigrams and phrases; a dictionary is
trained in a task, on at most ``2 * TRAINING`` phrases and as many words; to the driver come the distinct trigrams and the dictionaries. Words are judged once per worker and model.

Defined results: null, empty and ASCII texts are not affected. Languages with little text share a common dictionary.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import filterfalse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.session import cut_lineage

#: Parameters: phrases a dictionary is trained on; characters a task counts before it hands on its sums; characters a document has in a sample, where a caller asks for one; nats by which an undone word must be likelier; bytes it costs to name a chain of one or two steps;
#: (less where the true encoding is UTF-8, whose sequences hardly come about by chance); bytes a description must save beyond that;
#: size of a dictionary; words a worker remembers; characters that a quoted garbled sequence may stand for to be an example.
TRAINING, HELD, SAMPLE_CHARS, LIKELIER, STEP_COST, UTF8_COST, LEAST_SAVING, DICTIONARY, MEMO, EXAMPLE = 1 << 17, 1 << 24, 20_000, 4.0, 0.5, 0.5, 0.5, 32_768, 300_000, 4

#: Codecs a text may have been read with by mistake, and those it may really be in.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "cp1253", "iso8859_15")
TRUE = ("utf-8", "cp1252", "cp1251", "cp1253", "koi8_r", "mac_roman", "cp850", "cp866")
CHAINS = tuple((w, t) for t in TRUE for w in WRONG if w != t)

#: Letters a text really in one of these codecs must show somewhere.
SCRIPT_OF = {"cp1251": re.compile("[а-яё]", re.I), "koi8_r": re.compile("[а-яё]", re.I), "cp866": re.compile("[а-яё]", re.I), "cp1253": re.compile("[α-ωά-ώ]", re.I)}

_EXAMPLE = re.compile(r"""["'`“‘«]\s?([^\x00-\x7f][^\x00-\x1f!-\x7f]*?)\\?["'`”’»]""")
_QUOTE = re.compile(r"""(\\?["'`])""")
_LINE = re.compile(r"(\n|\\n)")
_BEYOND = re.compile(r"[^\x00-\x7f][^ ]*")


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte codec; bytes it leaves undefined stand for the control character of that number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    if codec == "cp1252":  # readers of Latin-1 keep the control characters
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _characters_of(codec: str) -> str:
    """The characters of a single-byte codec by their bytes, as ``codecs.charmap_decode`` takes them."""
    return "".join(bytes([b]).decode(codec, "replace").replace("\ufffd", "\ufffe") for b in range(256))


def _written(text: str, wrong: str) -> bytes | None:
    """The bytes of a text read with a codec; None if it has other characters."""
    table = _bytes_of(wrong)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _read(raw: bytes, true: str) -> str | None:
    try:
        return raw.decode() if true == "utf-8" else codecs.charmap_decode(raw, "strict", _characters_of(true))[0]
    except UnicodeDecodeError:
        return None


def undo(text: str, wrong: str, true: str) -> str | None:
    """The text with one step undone; None if it cannot have come about that way."""
    raw = _written(text, wrong)
    out = None if raw is None else _read(raw, true)
    return out if out != text else None


def _misread(wrong: str) -> re.Pattern:
    """The first two bytes of a character in UTF-8 as a codec reads them: a text without them is no UTF-8 read so."""
    first, next_ = ("".join(re.escape(c) for c, b in _bytes_of(wrong).items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"[{first}][{next_}]")


_MISREAD = tuple(_misread(w) for w in WRONG[:2])


def split_words(text: str) -> list[str]:
    """Words between plain blanks; other spaces may be garbled characters themselves."""
    return text.replace("\n", " ").replace("\t", " ").replace("\\n", " ").split(" ")


def non_ascii_pieces(text: str) -> list[list[str]]:
    """The words of each line, written out or escaped, that is not ASCII; most lines are, and are not split."""
    return [piece.replace("\t", " ").split(" ") for piece in text.replace("\\n", "\n").split("\n") if not piece.isascii()]


def non_ascii_words(text: str) -> list[str]:
    flat = text.replace("\\n", " ").replace("\n", " ").replace("\t", " ")
    return [flat[flat.rfind(" ", 0, m.start()) + 1 : m.end()] for m in _BEYOND.finditer(flat)]


def surroundings(every: list[str], marked: set[str], reach: int = 2) -> list[str]:
    """The first place of each marked word with the words around it, in the order of the text."""
    keep, seen = set(), set()
    for k, w in enumerate(every):
        if w in marked and w not in seen:
            seen.add(w)
            keep.update(range(max(0, k - reach), min(len(every), k + reach + 1)))
    return [every[k] for k in sorted(keep)]


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [t for k in range(len(padded) - 2) if not (t := padded[k : k + 3]).isascii()]


@lru_cache(maxsize=1 << 15)
def _kept_trigrams(word: str) -> list[str]:
    return trigrams(word)


def trigrams_of(word: str) -> list[str]:
    """``trigrams`` of a word of a text; short ones come again and again and are kept."""
    return _kept_trigrams(word) if len(word) <= 24 else trigrams(word)


def _phrases(lang: str, text: str) -> tuple[list[tuple[str, str, str]], set[str]]:
    """(lang, phrase, word) of every word beyond ASCII, and those words."""
    out = []
    for words in non_ascii_pieces(text):
        out += [(lang, " ".join(words[max(0, k - 2) : k + 3]), words[k]) for k, plain in enumerate(map(str.isascii, words)) if not plain]
    return out, {w for _, _, w in out}


class Counts:
    """What a model is made of, added up over whole texts: lines and, by trigram, documents with characters beyond ASCII; phrases by language."""

    def __init__(self, rows: Iterable[tuple[str | None, str]] = (), judge: Judge | None = None):
        self.judge, self.lines, self.held = judge, 0, 0
        self.df: Counter = Counter()
        self.phrases: Counter = Counter()
        for lang, text in rows:
            self.add(lang, text)

    def add(self, lang: str | None, text: str) -> None:
        """Count a text; with a judge, only its lines that are not suspicious, and their phrases."""
        phrases, distinct = _phrases(lang or "", text) if self.judge else ([], set(non_ascii_words(text)))
        if self.judge and ("\ufffd" in text or self.judge.suspicious(distinct)):
            text = self.judge.clean(text)
            phrases, distinct = _phrases(lang or "", text)
        self.lines += sum(1 for _ in filterfalse(str.isascii, text.split("\n")))
        self.phrases.update(phrases)
        self.held += sum([len(phrase) for _, phrase, _ in phrases])
        self.df.update(set().union(*map(trigrams_of, distinct)))

    def rows(self) -> list[tuple[str | None, str | None, str | None, int]]:
        """(lang, phrase, word, n) of phrases, (None, trigram, None, n) of trigrams, (None, None, None, n) of lines."""
        return [(None, None, None, self.lines), *((None, t, None, n) for t, n in self.df.items()), *((*key, n) for key, n in self.phrases.items())]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lang", "phrase", "word", "n"), zip(*self.rows()))))

    def shares(self) -> dict[str, tuple[int, Counter]]:
        """By language, and for all together, how many phrases there are and the phrases and words a dictionary is trained on; ``_dictionaries`` does the same in Spark."""
        by_lang: dict[str, Counter] = {"all": Counter()}
        for (lang, phrase, word), n in self.phrases.items():
            for key in {lang, "all"}:
                by_lang.setdefault(key, Counter())[phrase, word] += n
        out = {}
        for lang, phrases in by_lang.items():
            total = sum(phrases.values())
            if lang != "all" and sum(n * len(p.encode()) for (p, _), n in phrases.items()) < 2 * DICTIONARY:
                continue
            kept, rest = Counter(), Counter()
            for (phrase, word), n in phrases.items():
                if 2 * TRAINING * n >= total:
                    kept[phrase] += n
                else:
                    rest[word] += n
            kept.update({w: n for w, n in rest.items() if 2 * TRAINING * n >= total})
            out[lang] = total, kept
        return out


def train(total: int, phrases: Counter, size: int) -> bytes:
    """A dictionary from a text of about ``size`` phrases in which each stands as often as its share of ``total`` asks."""
    import zstandard

    text = [p for p, n in sorted(phrases.items()) for _ in range(n if total <= size else (2 * n * size + total) // (2 * total))]
    random.Random(0).shuffle(text)
    samples = [" ".join(text[k : k + 12]).encode() for k in range(0, len(text), 12)]  # about as long as lines
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return b"\n".join(samples)[:DICTIONARY]


class Model:
    """Frequencies of trigrams and one dictionary per language, fitted on (lang, text) rows.

    Some of the corpus is garbled. It is fitted twice: lines that the first, raw model finds suspicious are
    left out of the second, from which frequencies and dictionaries come.
    """

    def __init__(self, rows: list[tuple[str | None, str]]):
        raw = Counts(rows)
        second = Counts(rows, Judge(Model.of(raw.lines, raw.df)))
        self._set(second.lines, second.df, {lang: train(*share, TRAINING) for lang, share in sorted(second.shares().items())})

    @classmethod
    def of(cls, lines: int, df: dict[str, int], dictionaries: dict[str, bytes] | None = None) -> Model:
        """The model of counts made elsewhere."""
        model = cls.__new__(cls)
        model._set(lines, df, dictionaries or {})
        return model

    def _set(self, lines: int, df: dict[str, int], dictionaries: dict[str, bytes]) -> None:
        self.n, self.df, self.dictionaries = max(1, lines), dict(df), dictionaries

    def digest(self) -> str:
        """A hash of the model's content."""
        h = hashlib.sha256(repr((self.n, sorted(self.df.items()))).encode())
        for lang, d in sorted(self.dictionaries.items()):
            h.update(lang.encode() + d)
        return h.hexdigest()


class Judge:
    """The model at work in one process."""

    def __init__(self, model: Model):
        import zstandard

        self.model = model
        self.floor = math.log(0.3 / model.n)
        self.logs = {t: math.log((n + 0.3) / model.n) for t, n in model.df.items()}
        self.bounded = max(self.logs.values(), default=0.0) <= 0
        self.memo: dict[str, tuple] = {}
        self.plain: set[str] = set()  # words of which no chain makes a far likelier one
        self.coders = []
        for d in model.dictionaries.values():
            data = zstandard.ZstdCompressionDict(d) if d else None
            self.coders.append(zstandard.ZstdCompressor(level=9, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def score(self, word: str) -> float:
        logs, floor = self.logs, self.floor
        return sum([logs.get(t, floor) for t in trigrams(word)])

    def gain(self, word: str, base: float) -> float:
        """The score beyond ``base``; of a word that can no longer reach ``LIKELIER``, any value below it."""
        if self.bounded:  # no trigram adds to a score
            logs, floor, so_far, enough, padded = self.logs, self.floor, 0.0, base + LIKELIER - 1e-6, f" {word} "
            for k in range(len(padded) - 2):
                if not (t := padded[k : k + 3]).isascii():
                    so_far += logs.get(t, floor)
                    if so_far < enough:
                        return -math.inf
        return self.score(word) - base

    def undone(self, word: str) -> tuple[tuple[tuple, str, float], ...]:
        """(chain, undone word, gain) of every chain that makes the word far likelier."""
        if word in self.plain:
            return ()
        if (seen := self.memo.get(word)) is not None:
            return seen
        found = []
        base = self.score(word)
        written = {w: raw for w in WRONG if (raw := _written(word, w)) is not None}
        for step in CHAINS:
            raw = written.get(step[0])
            if raw is None or (once := _read(raw, step[1])) is None or once == word:
                continue
            gain = self.gain(once, base)
            if gain > LIKELIER:
                found.append(((step,), once, gain))
            if step[1] == "utf-8" and not once.isascii():
                for again in CHAINS[: len(WRONG)]:
                    twice = undo(once, *again)
                    if twice is not None and (g := self.gain(twice, base)) > LIKELIER:
                        found.append(((step, again), twice, g))
        if len(self.memo) + len(self.plain) >= MEMO:
            self.memo.clear()
            self.plain.clear()
        if not found:
            self.plain.add(word)
            return ()
        self.memo[word] = out = tuple(found)
        return out

    def suspicious(self, words: set[str]) -> bool:
        return any(self.undone(w) for w in words - self.plain)

    def clean(self, text: str) -> str:
        """The text without its suspicious lines."""
        if "\ufffd" not in text and not self.suspicious(set(non_ascii_words(text))):
            return text
        return "\n".join(line for line in text.split("\n") if "\ufffd" not in line and (line.isascii() or not self.suspicious(set(non_ascii_words(line)))))

    def length(self, text: str) -> int:
        """Bytes of the shortest description over all languages."""
        data = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(data)) for c in self.coders)

    def chains(self, text: str) -> list[tuple[tuple, dict[str, str], int]]:
        """The chains the text went through, strongest first: (chain, words undone, bytes saved)."""
        text = unquoted(text)
        words = non_ascii_words(text)
        if self.plain.issuperset(words):
            return []
        options: dict[tuple, dict[str, str]] = {}
        for w in dict.fromkeys(words):
            for chain, r, _ in self.undone(w):
                options.setdefault(chain, {})[w] = r
        options = {c: m for c, m in options.items() if (letters := SCRIPT_OF.get(c[-1][1])) is None or any(letters.search(r) for r in m.values())}
        out = []
        every = split_words(text) if options else []
        while options:
            union = surroundings(every, {w for m in options.values() for w in m})
            base = self.length(" ".join(union))
            best = None
            ranked = sorted(options.items(), key=lambda kv: (-len(kv[1]), len(kv[0])))
            for chain, m in ranked:
                cost = self.length(" ".join(m.get(w, w) for w in union)) + sum(UTF8_COST if t == "utf-8" else STEP_COST for _, t in chain)
                key = (cost, len(chain), CHAINS.index(chain[0]))
                if best is None or key < best[0]:
                    best = key, chain, m
            (cost, *_), chain, m = best
            if base - cost < LEAST_SAVING:
                break
            out.append((chain, m, int(base - cost)))
            options = {c: rest for c, n in options.items() if c != chain and (rest := {w: r for w, r in n.items() if w not in m})}
        return out


@lru_cache(maxsize=50_000)
def is_example(quoted: str) -> bool:
    """Whether a sequence of characters beyond ASCII stands for a few characters only, as it is or with a UTF-8 reading undone once or twice."""
    forms = {quoted.strip()}
    for _ in range(2):
        if any(len(f) <= EXAMPLE for f in forms):
            return True
        forms = {u.strip() for f in forms for w in WRONG if (u := undo(f, w, "utf-8")) is not None}
    return any(len(f) <= EXAMPLE for f in forms)


def unquoted(text: str) -> str:
    """The text without garbled sequences quoted as examples."""
    text = _EXAMPLE.sub(lambda m: " " if is_example(m.group(1)) else m.group(0), text)
    if not any(p.search(text) for p in _MISREAD):
        return text  # nothing in it can be undone below
    lines = _LINE.split(text)
    for k, line in enumerate(lines):
        if line.isascii() or not any(p.search(line) for p in _MISREAD):
            continue
        parts = _QUOTE.split(line)  # text, quote, text, quote, ...: pieces between two quotes are at 2, 4, ...
        quoted = set(parts[2:-1:2])
        if len(quoted) < 2:
            continue
        for j in range(2, len(parts) - 1, 2):
            q = parts[j]
            if not q.isascii() and any((u := undo(q, w, "utf-8")) is not None and u in quoted for w in WRONG[:2]):
                parts[j] = " "
        lines[k] = "".join(parts)
    return "".join(lines)


def restore(text: str, found: list[tuple[tuple, dict[str, str], int]]) -> str:
    """The text with every word of the chosen chains undone where it stands."""
    swap = {w: r for _, m, _ in found for w, r in m.items()}
    parts = re.split(r"( |\n|\t|\\n)", text)
    return "".join(swap.get(p, p) for p in parts)


def _suspects(documents: DataFrame) -> DataFrame:
    """ASCII texts cannot be garbled and count for nothing: they do not leave the JVM."""
    return documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))


def _counts(documents: DataFrame, first: Model | None = None) -> DataFrame:
    """``Counts.rows`` of all documents, of their lines that ``first`` does not find suspicious if it is given."""
    model, digest = (documents.sparkSession.sparkContext.broadcast(first), first.digest()) if first else (None, "")
    held = HELD

    def run(batches):
        judge = judge_of(digest, lambda: model.value) if model else None
        counts = Counts(judge=judge)
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                counts.add(lang, text)
                if counts.held > held:
                    yield counts.frame()
                    counts = Counts(judge=judge)
        yield counts.frame()

    rows = _suspects(documents).select(F.col("lang").cast("string"), "text").mapInPandas(run, "lang string, phrase string, word string, n long")
    return rows.groupBy("lang", "phrase", "word").agg(F.sum("n").alias("n"))


def _lines_and_trigrams(counts: DataFrame) -> tuple[int, dict[str, int]]:
    df = {r["phrase"]: r["n"] for r in counts.where(F.col("lang").isNull()).select("phrase", "n").collect()}
    return df.pop(None, 0), df


def _dictionaries(counts: DataFrame) -> dict[str, bytes]:
    """A dictionary per language, and for all together, from ``Counts.shares`` of all documents; each is trained in a task, on a group of bounded size."""
    phrases = counts.where(F.col("lang").isNotNull())
    both = phrases.where(F.col("lang") != "all").unionByName(phrases.groupBy("phrase", "word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("all")))
    totals = both.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.octet_length("phrase")).alias("size"))
    totals = totals.where((F.col("lang") == "all") | (F.col("size") >= 2 * DICTIONARY)).select("lang", "total")
    both = both.join(F.broadcast(totals), "lang")
    often = 2 * TRAINING * F.col("n") >= F.col("total")
    rest = both.where(~often).groupBy("lang", "total", "word").agg(F.sum("n").alias("n")).where(often)
    kept = both.where(often).select("lang", "total", "phrase", "n").unionByName(rest.withColumnRenamed("word", "phrase"))

    training = TRAINING

    def run(pdf):
        phrases: Counter = Counter()
        for phrase, n in zip(pdf["phrase"], pdf["n"]):
            phrases[phrase] += int(n)
        return pd.DataFrame({"lang": pdf["lang"][:1], "dictionary": [train(int(pdf["total"].iloc[0]), phrases, training)]})

    trained = kept.groupBy("lang").applyInPandas(run, "lang string, dictionary binary").collect()
    return {"all": train(0, Counter(), TRAINING)} | {r["lang"]: bytes(r["dictionary"]) for r in sorted(trained)}


def fit(documents: DataFrame, sample: int | None = None) -> Model:
    """The model of all documents; of so many with the smallest hashes, cut to ``SAMPLE_CHARS``, only for a caller who asks for a sample."""
    if sample is None:
        first = Model.of(*_lines_and_trigrams(_counts(documents)))
        counts = cut_lineage(_counts(documents, first))
        return Model.of(*_lines_and_trigrams(counts), _dictionaries(counts))
    known = documents.where(F.col("text").isNotNull() & (F.col("text") != ""))
    lean = known.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    total = documents.count()  # from the tables' footers
    # hashes are even, so half as many again as wanted lie below this share of them but for freak chance: few texts leave their tasks
    share = min(1.0, 1.5 * (sample + 50) / max(total, 1))
    while True:
        below = F.col("h") <= min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1)
        rows = lean.where(below).orderBy("h", "doc_id").limit(sample).collect()
        if len(rows) == sample or share == 1:
            break
        share = min(1.0, 8 * share)  # many null or empty texts
    return Model([(r["lang"], r["text"]) for r in rows])


_JUDGES: dict[str, Judge] = {}


def judge_of(digest: str, model: Callable[[], Model]) -> Judge:
    """One judge per worker process and content of a model."""
    if digest not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[digest] = Judge(model())
    return _JUDGES[digest]


def detect(documents: DataFrame, sample: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, chain, saved, restored of affected documents; chain '' and the text unchanged where only
    replacement characters tell. ``texts``: whether to build the restored texts."""
    fitted = fit(documents, sample)
    model, digest = documents.sparkSession.sparkContext.broadcast(fitted), fitted.digest()
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        judge = judge_of(digest, lambda: model.value)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                found = judge.chains(text)
                if found or "�" in text and "�" in unquoted(text):
                    name = " + ".join(" < ".join(f"{t} as {w}" for w, t in chain) for chain, _, _ in found)
                    out.append((doc, name, sum(s for _, _, s in found), (restore(text, found) if found else text) if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "chain", "saved", "restored"])

    return _suspects(documents).select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, chain string, saved long, restored string")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every document of which a part was decoded with the wrong encoding."""
    return detect(documents, texts=False).select("doc_id").distinct()
