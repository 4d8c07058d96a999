"""Best-fit packing by sum of squares: a piece goes where the squared counts of open sequences per residual gap become
smallest; of equal choices, where the smallest gap is left.

Tokenizing reads each document once and keeps a few numbers per piece; these are dealt into groups of bounded size by
row, so neither a hot source nor repeated rows meet in one task, and each group is packed by itself, longer pieces
first. A group of ``GROUP`` pieces leaves only its last few sequences unfilled.

Edge cases: null and empty texts are the end token alone. A document of exactly the capacity isn't cut. Repeated rows
and null ids are packed like any other row. An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm.batches import Columns, map_columns
from lumenframe.plans.scratch import cut

CAPACITY, END_ID, GROUP = 4096, 1, 100_000
#: Words that a worker remembers before it starts anew.
REMEMBERED = 800_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# The vocabulary's pattern of pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def unassigned() -> str:
    """A character class of the code points that this Python's tables don't know."""
    out, first = [], None
    for c in range(0x80, sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if new and first is None:
            first = c
        elif not new and first is not None:
            out.append(f"{chr(first)}-{chr(c - 1)}")
            first = None
    return "".join(out)


#: Texts with these go through the tokenizer as a whole: special tokens, and controls that Python takes for white space.
#: So do texts with code points that Python, the pattern library and the tokenizer may know by different versions of
#: Unicode: each new word is looked at for them.
WHOLE = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")


@cache
def unknown() -> re.Pattern:
    return re.compile(f"[{unassigned()}]")


#: Where a mark's first character isn't a mark too, a mark before a white space may be set apart.
MARKS = re.compile(r"[^\w\s][.,]|_[.,]")


def byte_letters() -> str:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class WordTokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes. White space never lies within a piece, so a text's
    ids are those of its words in order; words met before are looked up."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.find = regex.compile(PATTERN).findall
        self.unknown = unknown().search
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes | None] = {}  # none: only the whole text tells

    def _word(self, word: str) -> bytes | None:
        if not word.isascii() and self.unknown(word):
            return None
        ids: list[int] = []
        for piece in (word,) if word.isalpha() else self.find(word):
            ids += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return np.array(ids, "<u4").tobytes()

    def _ready(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if not MARKS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ")
        return text

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if WHOLE.search(text):
            return self._whole(text)
        words, known = self._ready(text).split(), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
        except TypeError:  # a word says none
            return self._whole(text)
        try:
            return b"".join(map(known.__getitem__, words))
        except TypeError:
            return self._whole(text)


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One a worker process."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECES of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        tokens = word_tokens(path)
        for b in batches:
            out: Columns = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                ids = tokens.encode(t) + end
                for k, x in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[x : x + 4 * capacity]
                    for name, v in zip(out, (d, k, x // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
            yield out

    return map_columns(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each size in order: the number of its sequence and its place there."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets = [], []
    for s in sizes:
        gaps = np.flatnonzero(count[s:capacity])
        best, change = -1, 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if len(gaps):
            held = count[gaps + s]
            left = np.where(gaps > 0, 2 * count[gaps] + 1, 0)  # gap 0 closes a sequence
            by = left - 2 * held + 1
            at = int(by.argmin())
            if by[at] <= change:
                best = int(gaps[at]) + s
        if best < 0:
            b, gap = len(used), capacity
            used.append(0)
        else:
            b, gap = open_by[best].pop(), best
            count[best] -= 1
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if gap > s:
            count[gap - s] += 1
            open_by.setdefault(gap - s, []).append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (PIECES, a stored table) with sequence_id and offset."""
    n = pieces.count()
    groups = max(1, -(-n // group))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        g = t.column("g")[0].as_py()
        bins, offsets = sum_of_squares(t.column("length").to_pylist(), capacity)
        return t.drop(["g"]).append_column("sequence_id", pa.array([g << 32 | b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    return pack(cut(cut_pieces(docs, path, capacity, end_id), "pieces"), capacity, group)
