"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's neighbours that can merge wait in buckets, one per merge rank, as positions of a linked list. Which
buckets hold something is kept in a two-level bitmap; find-first-set gives the lowest rank. A merge leaves its
neighbours' old entries behind; they no longer match the list and are skipped when met. Each step costs a few
operations however long the pre-token is, so a pre-token of n bytes takes O(n) of them.

Edge cases: null and empty texts encode to no ids and decode to no bytes. Texts are taken whole, of any length.
Repeated rows are encoded one by one (repeated pre-tokens once a worker). Lone surrogates can't occur in Spark.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from lumenframe.llm.batches import append_columns

#: Ranks in a word of the lower bitmap, as a power of two.
SHIFT = 8
MASK = (1 << SHIFT) - 1
#: Pre-tokens, and parts of texts, that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: From so many new pre-tokens on, one queue takes them together.
JOINT = 3_000
BESIDE = re.compile(r"\s | \s|^\s|\s$")
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """A vocabulary file: one base64 token and its rank a line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.shown = {r: str(r) for r in self.token}
        self.byte = [self.rank[bytes([b])] for b in range(256)]


def merge(piece: bytes, v: Ranks) -> list[int]:
    """The ids of one pre-token."""
    get = v.rank.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [v.byte[b] for b in piece]
    end = list(range(1, n + 1))  # a live position's token is piece[i:end[i]]
    prev = list(range(-1, n - 1))
    wants = [-1] * n  # the rank at which a position would merge with its right neighbour now
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    high = 0
    new = [(i, r) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    while True:
        for i, r in new:
            wants[i] = r
            if r in buckets:
                heappush(buckets[r], i)
            else:
                buckets[r] = [i]
                w = r >> SHIFT
                low[w] = low.get(w, 0) | 1 << (r & MASK)
                high |= 1 << w
        new = []
        if not high:
            break
        w = (high & -high).bit_length() - 1
        word = low[w]
        rank = (w << SHIFT) + (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            low[w] = word = word & (word - 1)
            if not word:
                high &= high - 1
        if wants[i] != rank:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        wants[i] = wants[j] = -1
        if k < n:
            prev[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                new.append((i, r))
        p = prev[i]
        if p >= 0:
            r = get(piece[p:k])
            if r is None:
                wants[p] = -1
            else:
                new.append((p, r))
    ids, i = [], 0
    while i < n:
        ids.append(get(piece[i : end[i]]))
        i = end[i]
    return ids


class JointQueue:
    """``merge`` over many pre-tokens at once: one linked list holds them all, one bucket a rank holds positions of
    all of them, and what a rank's bucket holds is merged as arrays. Of a pre-token only its first place in a bucket
    merges at a time; the others wait in it, as a new pair may rank lower."""

    def __init__(self, v: Ranks):
        self.v = v
        pairs = [(v.rank[t[:c]] << 32 | v.rank[t[c:]], r) for t, r in v.rank.items() for c in range(1, len(t)) if t[:c] in v.rank and t[c:] in v.rank]
        pairs.sort()
        self.key = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.made = np.array([r for _, r in pairs] + [-1], np.int32)
        self.byte = np.array(v.byte, np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left << 32 | right
        at = self.key.searchsorted(k)
        return np.where(self.key[at] == k, self.made[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        stops = np.cumsum(sizes)
        nxt[stops - 1] = n
        prv[stops - sizes] = -1
        live = np.ones(n, bool)
        inner = np.flatnonzero(nxt < n)
        wants = np.full(n + 1, -1, np.int32)
        wants[inner] = self.look_up(sym[inner], sym[nxt[inner]])
        buckets: dict[int, list[np.ndarray]] = {}
        low: dict[int, int] = {}
        high = 0
        at = inner[wants[inner] >= 0]
        ranks = wants[at]
        while True:
            order = ranks.argsort(kind="stable")
            ranks, at = ranks[order], at[order]
            begins = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for r, x, y in zip(ranks[begins].tolist(), begins, [*begins[1:], len(at)], strict=False):
                if r in buckets:
                    buckets[r].append(at[x:y])
                else:
                    buckets[r] = [at[x:y]]
                    w = r >> SHIFT
                    low[w] = low.get(w, 0) | 1 << (r & MASK)
                    high |= 1 << w
            if not high:
                break
            w = (high & -high).bit_length() - 1
            word = low[w]
            rank = (w << SHIFT) + (word & -word).bit_length() - 1
            waiting = buckets.pop(rank)
            i = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            i = i[wants[i] == rank]  # the rest is stale
            i.sort()
            own = owner[i]
            first = np.ones(len(i), bool)
            first[1:] = own[1:] != own[:-1]
            later = i[~first]
            if len(later):
                buckets[rank] = [later]
                i = i[first]
            else:
                low[w] = word = word & (word - 1)
                if not word:
                    high &= high - 1
            j = nxt[i]
            k = nxt[j]
            live[j] = False
            wants[i] = wants[j] = -1
            sym[i], nxt[i] = rank, k
            has = k < n
            a, k = i[has], k[has]
            prv[k] = a
            p = prv[i]
            p = p[p >= 0]
            at = np.concatenate((a, p))
            ranks = self.look_up(sym[at], sym[nxt[at]])
            wants[at] = ranks
            held = ranks >= 0
            at, ranks = at[held], ranks[held]
        counts = np.bincount(owner[live], minlength=len(pieces))
        ids, out, x = sym[live].tolist(), [], 0
        for c in counts.tolist():
            out.append(ids[x : x + c])
            x += c
        return out


class Codec:
    """Encodes and decodes whole texts.

    A space between two characters that aren't white space always begins a match of a pattern of this family, so a
    text may be cut there, and the parts' ids are remembered. A text with white space beside a space isn't cut.
    """

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.ranks = Ranks(path)
        self.find = regex.compile(pattern).findall
        self.cuts = " ?" in pattern and r"\s+(?!\S)" in pattern
        self.pieces: dict[str, list[int]] = {}
        self.parts: dict[str, dict] = {}  # what is kept of a space and the part
        self.remembered = remembered
        self.joint: JointQueue | None = None

    def _learn(self, words: list[str]) -> None:
        """Pre-tokens; many short ones go through one queue, others have their own."""
        short = [w for w in words if len(w) <= 64]
        if len(short) < JOINT:
            short = []
        else:
            self.joint = self.joint or JointQueue(self.ranks)
            self.pieces.update(zip(short, self.joint.merge([w.encode() for w in short]), strict=True))
        for w in words:
            if w not in self.pieces:
                self.pieces[w] = merge(w.encode(), self.ranks)

    def _whole(self, text: str) -> list[int]:
        found = self.find(text)
        self._learn([w for w in dict.fromkeys(found) if w not in self.pieces])
        return [x for w in found for x in self.pieces[w]]

    def _view(self, ids) -> tuple[int, str, bytes]:
        """Of a run of ids: how many, written in decimal, decoded."""
        return len(ids), " ".join(map(self.ranks.shown.__getitem__, ids)), self.decode(ids)

    def _over_parts(self, texts: list[str | None], keep, join) -> Iterator:
        """``join`` of what ``keep`` makes of the ids of each part of a text."""
        for x in range(0, len(texts), 4_000):
            yield from self._over([t or "" for t in texts[x : x + 4_000]], keep, join)

    def _over(self, texts: list[str], keep, join) -> Iterator:
        if len(self.pieces) > self.remembered:
            self.pieces = {}
        parts = self.parts.setdefault(keep.__name__, {})
        if len(parts) > self.remembered:
            parts.clear()
        cut = [self.cuts and not BESIDE.search(t) for t in texts]
        new: set[str] = set()
        for t, c in zip(texts, cut, strict=True):
            if c:
                new.update(t.split(" ")[1:])
        find, known = self.find, self.pieces
        found = {w: find(" " + w) for w in new if w not in parts}
        self._learn(list({p for f in found.values() for p in f if p not in known}))
        for w, f in found.items():
            parts[w] = keep(known[f[0]] if len(f) == 1 else [x for p in f for x in known[p]])
        del found, new
        for t, c in zip(texts, cut, strict=True):
            if c:
                first, *rest = t.split(" ")
                yield join([keep(self._whole(first)), *map(parts.__getitem__, rest)])
            else:
                yield join([keep(self._whole(t))])

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        return self._over_parts(texts, tuple, lambda parts: list(chain.from_iterable(parts)))

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def digest_all(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """SCHEMA's values: of each text's ids, and of what they decode to."""

        def join(parts: list[tuple[int, str, bytes]]) -> tuple[int, str, str]:
            n, shown, decoded = zip(*parts, strict=True)
            return sum(n), sha256(" ".join(filter(None, shown)).encode()).hexdigest(), sha256(b"".join(decoded)).hexdigest()

        return self._over_parts(texts, self._view, join)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text."""
    return append_columns(df, lambda xs: ((i,) for i in codec(path, pattern).encode_all(xs)), text, f"{ids} array<int>")


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null ids give none."""
    return append_columns(df, lambda xs: ((codec(path, pattern).decode(x or []),) for x in xs), ids, f"{out} binary")


def bpe_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: SCHEMA's columns."""
    return append_columns(df, lambda texts: codec(path, pattern).digest_all(texts), text, SCHEMA)
