"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

A document holds an item if at least half of the item's words occur in it as one unbroken run, once case, accents,
punctuation, white space, markup and escapes are disregarded. A short passage is a vanishing part of a long
document, so whole documents cannot be compared with items. Instead items are partitioned by the length of the run to
be found, and for each partition documents are read through a sliding window as long as the partition's shortest run: window and
run are then of one size, and containment in the document becomes equality of sets of shingles in a window.
A window is represented by the minima of ``HASHES`` hash functions over its shingles of five words; any leaked run
contains a window whose minima equal those of a window of the item, so no leak is missed. What the signatures find is verified exactly: a
run of the item's words must stand in the document, word for word.

Scale: while items are of a checked size, their signatures travel with the task and the search is one map-only
pass over whole texts; what travels is linear in the words of the items. Beyond it, signatures of documents and items are joined by (partition, key), those of
documents after a Bloom filter of the items' keys of a fixed size, hot keys split by count, and only candidates are verified.
No document is ever compared with another.

Defined results: null and empty texts and passages match nothing; a passage of n words needs ceil(n/2) of them, at least one; shorter
shingles are used for runs under five words; rows repeated count once; equal passages under different ids are all reported.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.operators.joins import spread_join
from terroir.session import cut_lineage

#: Parameters: words of a shingle, hash functions, ratio between the window lengths of partitions, bytes of passages that may travel (about 20 bytes do for each);
#: bits of the Bloom filter and of its hashes.
SHINGLE, HASHES, RATIO, ITEM_BYTES, BLOOM_BITS, BLOOM_HASHES = 5, 2, 1.3, 4 << 20, 26, 4

_ESCAPE = re.compile(r"\\+(?:u([0-9a-f]{4})|x([0-9a-f]{2})|([nrtfv\"'/]))")
_ANSI = re.compile(r"\x1b\[[0-9;]*[a-z]")
#: What makes a tag of any length, as against a comparison in code: nothing after the name, an attribute with a value, or bare words after the name of an
#: element that takes such attributes.
_REST = r"(?:\s*/?|\s+[^\s<>=/]+\s*=[^<>]*)>"
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|code|a|mark|sub|sup|font|small|s|tt|del|ins)" + _REST)
_TAG = re.compile(r"<(?:![^<>]*>|/?(?:input|option|select|button|textarea|script|video|audio|details|dialog|ol|td|th|table|img|iframe|form|link|a)\s[^<>]*>|/?[a-z][^\s<>/]*" + _REST + ")")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def words(text: str | None) -> list[str]:
    """The words of a text without case, accents, markup and escapes."""
    if not text:
        return []
    t = text.lower()
    if "\\" in t:
        t = _ESCAPE.sub(_unescape, t)
    if "\x1b" in t:
        t = _ANSI.sub("", t)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return _WORD.findall(t)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))


def window_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """One key per window of ``length`` words: its minima under every hash function, combined."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    k = min(SHINGLE, length)
    with np.errstate(over="ignore"):
        shingles = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for j in range(k):
            shingles = shingles * np.uint64(0x100000001B3) + hashes[j : j + len(shingles)]
    span = length - k + 1
    key = np.zeros(n, dtype=np.uint64)
    for s in range(HASHES):
        # the minimum over a window, by doubling: ranges of a power of two, two of which cover it
        low, size = _mix(shingles, 1_000_003 * (s + 1)), 1
        while size * 2 <= span:
            low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
        low = np.minimum(low[:n], low[span - size : span - size + n])
        key = _mix(key ^ low, 77 + s)
    return key


def partitions_of(runs: list[int], ratio: float = RATIO) -> dict[int, int]:
    """Run length -> window length of its partition, the shortest run in it."""
    out, start = {}, None
    for r in sorted(set(runs)):
        if start is None or r > start * ratio:
            start = r
        out[r] = start
    return out


class Items:
    """All items ready for the search."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.passages = {i: w for i, p in rows if (w := words(p))}
        self.run = {i: max(1, -(-len(w) // 2)) for i, w in self.passages.items()}
        self.windows = partitions_of(list(self.run.values()))
        self.shortest = min(self.windows.values(), default=1)
        vocabulary = sorted({x for w in self.passages.values() for x in w})
        self.hash_of = dict(zip(vocabulary, (int(h) for h in word_hashes(vocabulary))))
        self.hashed = {i: self._hashes(w) for i, w in self.passages.items()}
        #: per window length the keys of all windows in order, and the item each is of
        self.known: dict[int, np.ndarray] = {}
        self.owner: dict[int, np.ndarray] = {}
        by_length = defaultdict(list)
        for i, h in self.hashed.items():
            by_length[self.windows[self.run[i]]].append((i, np.unique(window_keys(h, self.windows[self.run[i]]))))
        for length, found in by_length.items():
            keys, own = np.concatenate([k for _, k in found]), np.repeat(np.array([i for i, _ in found], dtype=np.int64), [len(k) for _, k in found])
            order = np.argsort(keys, kind="stable")
            self.known[length], self.owner[length] = keys[order], own[order]

    def _hashes(self, tokens: list[str]) -> np.ndarray:
        """Hashes of the words; 0 of words no item has."""
        get = self.hash_of.get
        return np.fromiter((get(t, 0) for t in tokens), dtype=np.uint64, count=len(tokens))

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items with a window whose signature is met in the document. A window with a word no item has cannot be
        one, so only stretches of known words are read."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (h != 0).astype(np.int8), [0]])))
        out: set[int] = set()
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start < self.shortest:
                continue
            part = h[start:end]
            for length, known in self.known.items():
                met = np.unique(window_keys(part, length))
                lo, hi = np.searchsorted(known, met, "left"), np.searchsorted(known, met, "right")
                for x, y in zip(lo[hi > lo], hi[hi > lo]):
                    out.update(self.owner[length][x:y].tolist())
        return out

    def search(self, tokens: list[str]) -> list[int]:
        """The items of which the words hold a run."""
        h = self._hashes(tokens)
        return [i for i in sorted(self.candidates(h)) if holds(tokens, self.passages[i], self.run[i], h, self.hashed[i])]


def run_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash per run of ``length`` words, in their order: pieces whose lengths are powers of two, put together."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    piece, size, at = _mix(hashes, 5), 1, 0
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + piece[at : at + n], 11)
                at += size
            if at == length:
                return out
            piece = _mix(piece[: len(piece) - size] * np.uint64(0x9E3779B97F4A7C15) + piece[size:], 13)
            size *= 2


def holds(tokens: list[str], passage: list[str], run: int, h: np.ndarray | None = None, own: np.ndarray | None = None) -> bool:
    """Whether a run of so many words of the passage stands in the words, exactly. Time and space are linear in both, but for a logarithm of the run."""
    h, own = word_hashes(tokens) if h is None else h, word_hashes(passage) if own is None else own
    _, here, there = np.intersect1d(run_keys(h, run), run_keys(own, run), return_indices=True)
    return any(tokens[p : p + run] == passage[q : q + run] for p, q in zip(here.tolist(), there.tolist()))


def found(documents: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id of every document that holds at least half of an item's passage as one run."""
    known = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct()
    size = known.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    if size > item_bytes:
        return _found_by_join(documents, known)
    held = documents.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["passage"]) for r in known.collect()]))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def search(batches):
        e = held.value
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                tokens = words(text)
                if len(tokens) >= e.shortest:
                    out += [(doc, i) for i in e.search(tokens)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    texts = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    return texts.mapInPandas(search, f"doc_id {id_type}, item_id long").distinct()


def _found_by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same with items too large to travel: signatures meet by join, then candidates meet the texts."""

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"r": [max(1, -(-len(words(p)) // 2)) for p in pdf["passage"]]})

    runs = [r["r"] for r in items.select("passage").mapInPandas(count, "r int").distinct().collect()]  # lengths, not items
    windows = partitions_of(runs)
    lengths = sorted(set(windows.values()))

    def item_keys(batches):
        for pdf in batches:
            rows = []
            for i, p in zip(pdf["item_id"], pdf["passage"]):
                w = words(p)
                if w:
                    length = windows[max(1, -(-len(w) // 2))]
                    rows += [(i, length, k) for k in np.unique(window_keys(word_hashes(w), length)).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["item_id", "length", "k"])

    b = cut_lineage(items.mapInPandas(item_keys, "item_id long, length int, k long"))
    bloom = items.sparkSession.sparkContext.broadcast(bloom_of(b))

    def doc_keys(batches):
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h = word_hashes(words(text))
                rows = [(doc, n, k) for n in lengths for k in in_bloom(np.unique(window_keys(h, n)), bloom.value).view(np.int64).tolist()]
                yield pd.DataFrame(rows, columns=["doc_id", "length", "k"])

    def verify(batches):
        for pdf in batches:
            keep = []
            for text, p in zip(pdf["text"], pdf["passage"]):
                w = words(p)
                keep.append(holds(words(text), w, max(1, -(-len(w) // 2))))
            yield pdf[keep][["doc_id", "item_id"]]

    texts = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    a = cut_lineage(texts.mapInPandas(doc_keys, f"doc_id {id_type}, length int, k long"))
    pairs = spread_join(a, b, ["length", "k"], ["doc_id"]).select("doc_id", "item_id").distinct()
    return pairs.join(items, "item_id").join(texts, "doc_id").mapInPandas(verify, f"doc_id {id_type}, item_id long").distinct()


def _bloom_places(keys: np.ndarray, bits: int = BLOOM_BITS) -> list[np.ndarray]:
    return [_mix(keys, 900 + j) >> np.uint64(64 - bits) for j in range(BLOOM_HASHES)]


def bloom_of(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of column ``k``, as 64-bit words; its size is fixed, with more keys it only lets more pass."""

    def places(batches):
        for pdf in batches:
            at = np.unique(np.concatenate(_bloom_places(pdf["k"].to_numpy(np.int64).view(np.uint64), bits))) if len(pdf) else np.empty(0, dtype=np.uint64)
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    words_ = keys.select("k").mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bloom(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """The keys that may be in the filter."""
    keep = np.ones(len(keys), dtype=bool)
    for at in _bloom_places(keys, int(np.log2(len(bloom))) + 6):
        keep &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return keys[keep]
