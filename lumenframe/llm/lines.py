"""Line dedup over the whole corpus by a segment-partition edit join.

Lines with a word (anything but ASCII white space) take part, whatever their length; lines without one always stay.
Equal lines are one. Two lines of at least ``MIN_CHARS`` code points also link when their edit distance is at most
``THRESHOLD``: below that a segment is too short to tell lines apart. Of each component of links the line that comes
first (by doc_id, then row, then line number) stays, all others go. With ``short=False`` lines under ``MIN_CHARS`` all stay.

A line of n code points is cut into THRESHOLD + 1 segments, so whatever lies within the threshold keeps one of them
whole. Keys are hashes of (length, segment's number, its text): a line writes those of its own segments, and those of
every substring that may stand for a segment of a line up to THRESHOLD shorter, only at the starts that the edits left
on either side allow. Lines that share a key are compared by a banded bit-parallel edit distance, after a bound on
character counts. ``linking`` says how hot keys are dealt with.

Every row has a number of its own, given in a written table: lines are dropped from a row, never from all rows of a
doc_id.

Edge cases: null texts stay null and have no lines; an empty text has one empty line. Rows without doc_id come first.
Repeated rows: the lines of all but one go. A document that loses lines and has no word left goes with
``drop_empty``. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.batches import fresh
from lumenframe.llm.jaccard import SEEN
from lumenframe.llm.linking import KEYS, components, filter_of, find_links, first_bytes, id_longs, key_arrays, map_arrow
from lumenframe.plans.scratch import cut, discard, numbered

THRESHOLD, MIN_CHARS = 2, 40
BLANK = " \t\r\x0b\x0c"
#: Counters of the bound on character counts.
COUNTS = 48


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def segments(n: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(start, length) of the even cut of n code points; the last ones are longer."""
    k = threshold + 1
    short, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def windows(n: int, m: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(segment's number, start, length) of the substrings of a line of n code points that may stand for a segment of a
    line of m <= n: at most i edits lie left of segment i, and at most threshold - i right of it."""
    out, d = [], n - m
    for i, (p, size) in enumerate(segments(m, threshold)):
        low = max(p - i, p + d - (threshold - i), 0)
        high = min(p + i, p + d + (threshold - i), n - size)
        out += [(i, x, size) for x in range(low, high + 1)]
    return out


_windows: dict[int, list[tuple[int, int, int, int]]] = {}


def line_keys(line: str, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> list[int]:
    n = len(line)
    plan = _windows.get(n)
    if plan is None:
        # the line's own segments are among the windows of its own length
        plan = [(m * 8 + i, x, x + size) for m in range(max(n - threshold, min_chars), n + 1) for i, x, size in windows(n, m, threshold)]
        if len(_windows) < 100_000:
            _windows[n] = plan
    digest = xxhash.xxh3_64_intdigest
    return [digest(line[x:y].encode("utf-8", "surrogatepass"), seed) for seed, x, y in plan]


def edit_distance_within(a: str, b: str, k: int) -> bool:
    """Whether at most k edits lie between them: bit-parallel, over a band of 2k + 1 diagonals.

    Bit d of level e says that the diagonal d - k is reached with e edits as far as row i; equal characters keep a
    bit on its diagonal, an edit moves it to the next level."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    x = 0
    while x < min(n, m) and a[x] == b[x]:
        x += 1
    while n > x and m > x and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[x:n], b[x:m]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j + k
    # level e before row 0: diagonals 0..e by insertion
    levels = [((1 << e + 1) - 1) << k & full for e in range(k + 1)]
    for i, c in enumerate(a):
        match = at.get(c, 0) >> i & full
        before, levels = levels, []
        for e in range(k + 1):
            now = before[e] & match
            if e:
                now |= before[e - 1] | before[e - 1] >> 1  # replaced; dropped
                now |= levels[e - 1] << 1 & full  # inserted
            levels.append(now)
        if not levels[k]:
            return False
    return bool(levels[k] >> m - n + k & 1)


def character_counts(line: str) -> bytes:
    h = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") % COUNTS
    return np.minimum(np.bincount(h, minlength=COUNTS), 255).astype(np.uint8).tobytes()


def near(one: bytes, others: list[bytes], threshold: int = THRESHOLD) -> np.ndarray:
    """False only where character counts rule a link out: an edit changes two of them by one at most."""
    b = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1).astype(np.int16)
    return np.abs(b - np.frombuffer(one, np.uint8).astype(np.int16)).sum(axis=1) <= 2 * threshold


def new_lines(texts: list[str | None], seen: set[bytes], min_chars: int) -> Iterator[tuple[bytes, str]]:
    for t in texts:
        for line in (t or "").split("\n"):
            if len(line) >= min_chars:
                i = line_id(line)
                if i not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(i)
                    yield i, line


def key_rows(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        seen: set[bytes] = set()
        for b in batches:
            keys, ids, counts = [], [], []

            def out() -> list[pa.Array]:
                return key_arrays(np.array(keys, np.uint64), ids, counts)

            for i, line in new_lines(b.column(0).to_pylist(), seen, min_chars):
                mine = line_keys(line, threshold, min_chars)
                keys += mine
                ids.append(i)
                counts.append(len(mine))
                if len(keys) > 500_000:
                    yield out()
                    keys, ids, counts = [], [], []
            if keys:
                yield out()

    return map_arrow(docs.select("text"), run, KEYS)


def lines_of(docs: DataFrame, wanted: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, p): each line, as UTF-8, of a stored table of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(first_bytes())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        seen: set[bytes] = set()
        for b in batches:
            found = list(new_lines(b.column(0).to_pylist(), seen, min_chars))
            if not found:
                continue
            held = [found[k] for k in np.flatnonzero(shared.value.may_hold(id_longs([i for i, _ in found])[:, 0].view(np.uint64) >> np.uint64(8)))]
            yield [pa.array([i for i, _ in held], pa.binary()), pa.array([line.encode("utf-8", "surrogatepass") for _, line in held], pa.binary())]

    rows = map_arrow(docs.select("text"), run, "id binary, p binary")
    return rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def counted(lines: DataFrame) -> DataFrame:
    """(id, f): the character counts of (id, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            yield [b.column(0), pa.array([character_counts(p.decode("utf-8", "surrogatepass")) for p in b.column(1).to_pylist()], pa.binary())]

    return map_arrow(lines, run, "id binary, f binary")


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """doc_id, row, line (number from 0), id of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            docs_out, rows, numbers, ids = [], [], [], []
            for d, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, line in enumerate((t or "").split("\n")):
                    if (short or len(line) >= min_chars) and line.strip(BLANK):
                        docs_out.append(d)
                        rows.append(r)
                        numbers.append(k)
                        ids.append(line_id(line))
            yield [pa.array(docs_out, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ids, pa.binary())]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "_row", "text"), run, "doc_id long, row long, line int, id binary")


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """row, line, source_doc, source_line (the line of its component that stays) of every line of ``docs`` (doc_id,
    text, _row) that goes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_row")

    held: list[DataFrame] = []  # tables that the search alone reads: ids that share a key, and their lines

    def features(wanted: DataFrame) -> DataFrame:
        held.append(cut(wanted, "wanted-lines"))
        held.append(cut(lines_of(docs, held[0], min_chars), "shared-lines"))
        return counted(held[1])

    def payloads(wanted: DataFrame) -> DataFrame:
        return held[1].join(wanted, "id")

    def test(a: bytes, b: bytes) -> bool:
        return edit_distance_within(a.decode("utf-8", "surrogatepass"), b.decode("utf-8", "surrogatepass"), threshold)

    found = find_links(key_rows(docs, threshold, min_chars), features, lambda x, y: near(x, y, threshold), payloads, test)
    comps = components(found)
    discard(found, *held)
    places = cut(occurrences(docs, min_chars, short), "lines")
    first = places.groupBy("id").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n"))
    first = first.join(comps, "id", "left")
    linked = first.where("comp is not null")
    lead = linked.groupBy("comp").agg(F.min("first").alias("lead"))
    stays = linked.join(lead, "comp").select("id", F.col("lead").alias("first")).unionByName(first.where("comp is null and n > 1").select("id", "first"))
    gone = places.join(stays, "id").where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    return gone.select("row", "line", F.col("first.doc_id").alias("source_doc"), F.col("first.line").alias("source_line"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """Of every row: doc_id, n_lines, n_dropped, dropped (line numbers), source_docs (where their firsts stand)."""
    docs = numbered(docs.select("doc_id", "text"))
    gone = dropped_lines(docs, threshold, min_chars, short).groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("line")).alias("dropped"), F.array_sort(F.collect_set("source_doc")).alias("source_docs"))
    rows = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    out = rows.join(gone, "_row", "left")
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none[0]).alias("dropped"), F.coalesce("source_docs", none[1]).alias("source_docs"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, drop_empty: bool = True, short: bool = True) -> DataFrame:
    """``docs`` with the texts that are left, n_chars in step; with ``drop_empty`` documents left without a word go."""
    row, gone = fresh(docs, "_row", "_gone")
    rows = numbered(docs, row)
    dropped = dropped_lines(rows.select("doc_id", "text", F.col(row).alias("_row")), threshold, min_chars, short)
    dropped = dropped.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(gone))
    rows = rows.join(dropped, row, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text")))
    if drop_empty:
        rows = rows.where(F.col(gone).isNull() | F.col("text").rlike(r"[^ \t\n\r\x0B\f]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
