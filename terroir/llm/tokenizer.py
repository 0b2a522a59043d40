"""Encoding of a corpus by a public byte-level BPE vocabulary, with a backtracking encoder.

Pieces of text (the vocabulary's own split pattern) are encoded without running merges. An
Aho-Corasick automaton over the vocabulary reports every token that ends at every byte of a piece; from
them the encoder takes the longest token at each position and steps back to a shorter one when a pair
of neighbours could not stand next to each other after real merging. Whether a pair can is read off the
merge table: undoing the later merge on the border of the two tokens, step by step, must never meet a
merge that would have come earlier. Positions from which no valid continuation exists are marked once,
so the work is linear in the piece. Ids equal those of exact merging.

Decoding uses an offset table: the bytes of all tokens in one buffer, and an array of their borders.

Scale: a map-only stage over Arrow batches; no shuffle, nothing collected. Whole texts are encoded. The vocabulary file is read where the plan is
made and its bytes are broadcast (a fixed size, a few MB), so it need not lie on the executors.
Piece ids are memoised per Python worker; the memo is emptied at MEMO entries, so memory is bounded.

Defined results: null and empty texts give an empty list; names of special tokens are plain text;
lone surrogates cannot occur in Arrow strings. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of the vocabulary. White space is written as the Unicode property,
#: since the regex engine's own class also counts the separators U+001C to U+001F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO, MEMO_PIECE = 500_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file: the setting TERROIR_TOKENIZERS, else the installed package."""
    if folder := os.environ.get("TERROIR_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> dict[str, int]:
    """The one-character name of each byte in the vocabulary file, by its rule: printable Latin-1 bytes
    name themselves, the others take code points from 256 on, in order."""
    names, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            names[chr(b)] = b
        else:
            names[chr(free)] = b
            free += 1
    return names


class BacktrackingEncoder:
    """Exact byte-level BPE of one vocabulary file."""

    def __init__(self, source: str | bytes):
        """source: the place of the vocabulary file, or its content."""
        import ahocorasick
        import regex

        spec = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())
        names = printable_bytes()
        raw = lambda s: bytes(names[c] for c in s)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.tokens: dict[int, bytes] = {v: k for k, v in vocab.items()}
        self.pair: dict[tuple[int, int], int] = {}
        #: rank of the merge that makes a token; tokens of one byte come before all merges
        self.rank: dict[int, int] = {v: -1 for k, v in vocab.items() if len(k) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pair[(a, b)] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (a, b)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.rank:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.known: dict[tuple[int, int], bool] = {}
        order = sorted(self.tokens)
        self.buffer = b"".join(self.tokens[i] for i in order)
        self.border = np.zeros((order[-1] if order else 0) + 2, dtype=np.int64)
        for i in order:
            self.border[i + 1] = len(self.tokens[i])
        self.border = np.cumsum(self.border)
        self.memo = _Memo(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens from scratch would leave exactly these two.

        Undo, of the two border tokens, the merge that was made later; before each undoing, a merge
        across the border must not have come first. ``open_until`` is the rank from which on the
        border existed as it stands.
        """
        key = (left, right)
        if (seen := self.known.get(key)) is not None:
            return seen
        rank, parts = self.rank, self.parts
        a, b, open_until, fine = left, right, 1 << 60, True
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < open_until:
                fine = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # of equal merges the left one is made first, so the right one is undone first
            if ra > rb:
                open_until, a = ra, parts[a][1]
            else:
                # a merge across the border wins over one of the same rank to its right
                open_until, b = rb + 1, parts[b][0]
        if len(self.known) > MEMO:
            self.known.clear()
        self.known[key] = fine
        return fine

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            starts[end - size + 1].append((size, i))
        for found in starts:
            found.sort()  # longest last
        dead = bytearray(n + 1)
        out: list[int] = []
        sizes: list[int] = []
        at, choice = 0, len(starts[0]) - 1 if n else -1
        while at < n:
            last, placed = out[-1] if out else None, False
            while choice >= 0:
                size, i = starts[at][choice]
                if not dead[at + size] and (last is None or self.compatible(last, i)):
                    out.append(i)
                    sizes.append(size)
                    at += size
                    choice = len(starts[at]) - 1 if at < n else -1
                    placed = True
                    break
                choice -= 1
            if not placed:
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at] = 1
                size, i = sizes.pop(), out.pop()
                at -= size
                choice = starts[at].index((size, i)) - 1
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids as consecutive 32-bit integers: pieces are joined without touching single ids."""
        return b"".join(map(self.memo.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.buffer[self.border[i] : self.border[i + 1]] for i in ids).decode("utf-8", errors="replace")


class _Memo(dict):
    def __init__(self, encoder: BacktrackingEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.piece(piece.encode("utf-8")), dtype=np.int32).tobytes()
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str) -> BacktrackingEncoder:
    """The encoder of a vocabulary file that can be read here."""
    content = Path(path).read_bytes()
    return shared_encoder(hashlib.sha256(content).hexdigest(), lambda: content)


_ENCODERS: dict[str, BacktrackingEncoder] = {}


def shared_encoder(digest: str, content: Callable[[], bytes]) -> BacktrackingEncoder:
    """One encoder per worker process and content of a vocabulary."""
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = BacktrackingEncoder(content())
    return _ENCODERS[digest]


def encode_corpus(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """id and ids (array<int>) of every row."""
    content = Path(path or vocabulary_path()).read_bytes()
    digest, held = hashlib.sha256(content).hexdigest(), documents.sparkSession.sparkContext.broadcast(zlib.compress(content))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        e = shared_encoder(digest, lambda: zlib.decompress(held.value))
        for batch in batches:
            packed = [e.packed(text) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, ids_col])

    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, {ids_col} array<int>")
