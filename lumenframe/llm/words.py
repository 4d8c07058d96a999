"""64-bit hashes of words, the same in every process, for whole Arrow columns at once.

Words are split at ASCII white space. A word of at most ``LONG`` bytes hashes to a polynomial of its bytes modulo 2^64,
read off running sums over the column's buffer, so no list or dictionary of words is ever held; a longer word hashes by
xxh3. Columns go in slices of whole texts, of about ``SLICE`` bytes: what a task holds is bounded by that or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a slice, bytes hashed in one running sum, longest word of the polynomial.
SLICE, RUN, LONG = 1 << 21, 1 << 18, 1 << 12
BASE = 0xD6E8FEB86659FD93
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads close values."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h ^= h >> np.uint64(29)
    h = h * MIX
    return h ^ (h >> np.uint64(32))


BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * MIX)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = powers(BASE, RUN), powers(pow(BASE, -1, 1 << 64), RUN)


@dataclass
class Slice:
    """Texts ``first`` on of a column: their bytes, where each begins, their words' hashes and where each text's begin."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    inside: np.ndarray  # bytes of words
    words: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def hashes(self, k: int) -> np.ndarray:
        return self.words[self.at[k] : self.at[k + 1]]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which follow each other without overlap."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        low = int(starts[w])
        stop = max(int(np.searchsorted(ends, low + RUN, "right")), w + 1)
        high = min(int(ends[stop - 1]), low + RUN)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE[data[low:high]] * UP[: high - low], out=sums[1:])
        x, y = starts[w:stop] - low, np.minimum(ends[w:stop], high) - low
        out[w:stop] = (sums[y] - sums[x]) * DOWN[x]
        w = stop
    out = scramble(out + sizes.astype(np.uint64) * MIX)
    for k in np.flatnonzero(sizes > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins; null: empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), places


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """``column``'s texts in order; ``lower``: ASCII letters in lower case."""
    data, places = buffers(column)
    first = 0
    while first < len(places) - 1:
        stop = max(int(np.searchsorted(places, places[first] + SLICE, "right")) - 1, first + 1)
        part, offsets = data[places[first] : places[stop]], places[first : stop + 1] - places[first]
        if lower:
            part = np.frombuffer(part.tobytes().translate(LOWER), np.uint8)
        inside = ~SPACE[part]
        begins = np.zeros(len(part) + 1, bool)
        begins[offsets] = True  # a word ends with its text
        new = inside.copy()
        new[1:] &= ~inside[:-1] | begins[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[1:-1]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        yield Slice(first, part, offsets, inside, hash_spans(part, starts, ends), np.searchsorted(starts, offsets))
        first = stop


def word_hashes(text: str | bytes) -> np.ndarray:
    """Of one text."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return next(slices(pa.array([raw], pa.binary()))).words
