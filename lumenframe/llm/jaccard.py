"""N-gram Jaccard join, size-aware: documents with few shingles meet in enumerated subsets of fixed size, the others in
inverted lists.

A document's set holds its distinct shingles of ``WIDTH`` words (ASCII letters in lower case, words split at ASCII
white space); with fewer words, the whole sequence as one. Two sets link when ``100 * both >= PERCENT * either``.

Small sets: sets of a and b elements link only if they share c(a, b) of them, so each set enumerates, for every size
that a partner can have, its subsets of c elements; those are its keys. Large sets: of each set only the elements
that come first in one global order are in the lists, as many as a link can't all miss. The order puts elements
of long lists last: a counting table of a fixed size, filled over all documents, says which those are. The boundary is
the largest size whose subsets cost no more than its lists, at the mean list length measured. Sets close above and
below the boundary are in the lists too, so no link across it is missed.

Exact copies have one set and are one id. Short sketches travel with list entries and long ones with the pairs that
these let through; both rule out only what can't link. Links are tested on whole sets. ``linking`` says how hot lists are dealt with.

Edge cases: null and empty texts, and such without words, have the empty set, which links with nothing. Rows with the
same doc_id and different texts are judged each by its own text. Rows without doc_id are returned with the component
of their set. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.batches import fresh
from lumenframe.llm.linking import KEYS, components, filter_of, find_links, first_bytes, id_firsts, key_arrays, map_arrow, merge_chunks
from lumenframe.llm.words import MIX, scramble, slices
from lumenframe.plans.scratch import cut, discard, numbered

WIDTH, PERCENT = 5, 80
#: Counters of the table of list lengths (a power of two); a list is long from HOT, or MEANS times the mean, on.
TABLE_BITS, HOT, MEANS = 22, 24, 8
CHUNK = 1 << 16
#: Largest boundary, and bytes of the parity sketch.
MOST_SMALL, SKETCH = 12, 128
#: Ids that a task remembers to write copies once.
SEEN = 100_000


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Of every text the sorted 64-bit hashes of its set."""
    for s in slices(column, lower=True):
        h = s.words
        n = len(h) - WIDTH + 1
        if n > 0:
            w = h[:n].copy()
            for k in range(1, WIDTH):
                w *= MIX
                w ^= w >> np.uint64(31)
                w += h[k : n + k]
            w = scramble(w)
        for x, y in zip(s.at[:-1].tolist(), s.at[1:].tolist(), strict=True):
            if y - x >= WIDTH:
                one = np.sort(w[x : y - WIDTH + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            elif y > x:
                one = np.array([y - x], np.uint64)
                for k in range(x, y):
                    one = scramble(one) + h[k]
                yield scramble(one)
            else:
                yield np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Elements that sets of these sizes share if they link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


@cache
def partners(n: int, percent: int = PERCENT) -> tuple[tuple[int, int], ...]:
    """(size of a partner, elements to share)."""
    return tuple((m, needed(n, m, percent)) for m in range(-(-percent * n // 100), 100 * n // percent + 1) if m)


def n_subsets(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, c) for _, c in partners(n, percent))


def boundary(mean_list: float, percent: int = PERCENT, most: int = MOST_SMALL) -> int:
    """The largest size, up to ``most``, at which subsets cost no more rows than lists cost tests."""
    b = 0
    for n in range(1, most + 1):
        if n_subsets(n, percent) > prefix_length(n, percent) * max(1.0, mean_list):
            break
        b = n
    return b


def subset_keys(s: np.ndarray, percent: int = PERCENT) -> list[int]:
    out = []
    n = len(s)
    for m, c in partners(n, percent):
        low, high = min(n, m), max(n, m)
        for part in combinations(s.tolist(), c):
            out.append(xxhash.xxh3_64_intdigest(np.array((low, high, *part), np.uint64).tobytes()))
    return out


def sketch(s: np.ndarray, size: int = SKETCH) -> bytes:
    """Size of the set, then the parity of the elements at each of 8 * ``size`` places: sets that differ in d elements
    differ in d places at most."""
    places = (s >> np.uint64(20)) % np.uint64(8 * size)
    parity = np.bincount(places.astype(np.int64), minlength=8 * size) & 1
    return len(s).to_bytes(4, "little") + np.packbits(parity.astype(np.uint8)).tobytes()


def long_sketch(s: np.ndarray) -> bytes | None:
    """A sketch of two places an element or more; None where ``sketch`` has as many. Pairs get it, list entries don't."""
    size = (1 << (2 * len(s) - 1).bit_length()) // 8
    return sketch(s, size) if size > SKETCH else None


def near_by_long(p: bytes, q: bytes, percent: int = PERCENT) -> bool:
    """As ``near``, for sketches of any two lengths: the longer one is folded to the places of the shorter."""
    if len(p) > len(q):
        p, q = q, p
    places = len(p) - 4
    folded = np.bitwise_xor.reduce(np.frombuffer(q, np.uint8, offset=4).reshape(-1, places), axis=0).tobytes()
    return bool(near(p, [q[:4] + folded], percent)[0])


def near(one: bytes, others: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """False only where sizes or sketches rule a link out."""
    a = int.from_bytes(one[:4], "little")
    joined = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1)
    b = joined[:, :4].copy().view("<u4").ravel().astype(np.int64)
    need = -(-percent * (a + b) // (100 + percent))
    apart = np.bitwise_count(joined[:, 4:] ^ np.frombuffer(one, np.uint8)[4:]).sum(axis=1, dtype=np.int64)
    return (need <= np.minimum(a, b)) & (apart <= a + b - 2 * need)


def links(p: bytes, q: bytes, percent: int = PERCENT) -> bool:
    a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b) and 100 * both >= percent * (len(a) + len(b) - both))


def scan_sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, np.ndarray]:
    """A stored table of doc_id, n, id, f (sketch) and g (long sketch) of every document (rows whose chunk is null), and
    the table of list lengths in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        counts, seen = np.zeros(1 << TABLE_BITS, np.uint32), set()
        for b in batches:
            ids, sizes, features, long_ones = [], [], [], []
            for s in shingle_sets(b.column(1)):
                i = set_id(s) if len(s) else None
                if i is not None and i not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(i)
                    np.add.at(counts, (s[: prefix_length(len(s), percent)] >> np.uint64(3)) & np.uint64((1 << TABLE_BITS) - 1), 1)
                ids.append(i)
                sizes.append(len(s))
                features.append(sketch(s) if len(s) else None)
                long_ones.append(long_sketch(s) if len(s) else None)
            none = pa.nulls(len(ids), pa.int32())
            yield [b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(features, pa.binary()), pa.array(long_ones, pa.binary()), none]
        for c in range(0, len(counts), CHUNK):
            part = counts[c : c + CHUNK]
            if part.any():
                yield [pa.nulls(1, pa.int64()), pa.array([TaskContext.get().partitionId()]), pa.nulls(1, pa.binary()), pa.array([zlib.compress(part.astype("<u8").tobytes(), 1)], pa.binary()), pa.nulls(1, pa.binary()), pa.array([c // CHUNK], pa.int32())]

    both = cut(map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, id binary, f binary, g binary, chunk int"), "sets")

    table = np.zeros((1 << TABLE_BITS) // CHUNK * CHUNK, np.uint64).reshape(-1, CHUNK)
    for chunk, x in merge_chunks(both.where("chunk is not null").select("chunk", F.col("n").cast("int").alias("part"), "f"), "<u8", np.add).items():
        table[chunk] = x
    return both, table.ravel()


def key_rows(docs: DataFrame, hot: np.ndarray, small: int, percent: int = PERCENT) -> DataFrame:
    """KEYS: subsets of sets up to ``small``, first elements of the others and of those close below."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))  # 2 ** TABLE_BITS bits
    mask = np.uint64((1 << TABLE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        late, seen = np.unpackbits(shared.value).view(bool), set()
        for b in batches:
            keys, ids, counts = [], [], []
            for s in shingle_sets(b.column(0)):
                n = len(s)
                if not n:
                    continue
                i = set_id(s)
                if i in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(i)
                mine = []
                if n <= small:
                    mine.append(np.array(subset_keys(s, percent), np.uint64))
                if n > small or 100 * n >= percent * (small + 1):
                    p = prefix_length(n, percent)
                    is_late = late[(s >> np.uint64(3)) & mask]
                    early = s[~is_late]
                    mine.append(early[:p] if len(early) >= p else np.concatenate((early, s[is_late][: p - len(early)])))
                mine = np.concatenate(mine)
                keys.append(mine)
                ids.append(i)
                counts.append(len(mine))
            if keys:
                yield key_arrays(np.concatenate(keys), ids, counts)

    return map_arrow(docs.select("text"), run, KEYS)


def similar_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned, table = scan_sets(rows, percent)
    held = table[table > 0].astype(float)
    mean = held.sum() / len(table)
    mean_list = (held**2).sum() / held.sum() if len(held) else 1.0
    hot = table >= max(HOT, MEANS * mean)
    small = boundary(mean_list, percent)
    known = scanned.where("chunk is null and id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("f").alias("f"), F.first("g").alias("g"))
    known = cut(known, "known-sets")
    sets = cut(scanned.where("chunk is null").select("doc_id", "n", "id"), "set-ids")
    discard(scanned)
    held = [known]  # tables that the search alone reads

    def payloads(wanted: DataFrame) -> DataFrame:
        reps = cut(known.join(wanted, "id").select("doc_id", "id"), "wanted")
        held.append(reps)
        shared = docs.sparkSession.sparkContext.broadcast(filter_of(reps.select("doc_id")))  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            seen: set[bytes] = set()
            for b in batches:
                mask = shared.value.may_hold(b.column(0).fill_null(0).to_numpy()) | b.column(0).is_null().to_numpy(zero_copy_only=False)
                ids, sets_out = [], []
                for s in shingle_sets(b.column(1).filter(pa.array(mask))):
                    if len(s) and (i := set_id(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(i)
                        ids.append(i)
                        sets_out.append(s.tobytes())
                if ids:
                    yield [pa.array(ids, pa.binary()), pa.array(sets_out, pa.binary())]

        return map_arrow(rows, run, "id binary, p binary").join(reps.select("id"), "id", "left_semi").dropDuplicates(["id"])

    def features(wanted: DataFrame) -> DataFrame:
        return known.join(wanted, "id").select("id", "f")

    def long_features(wanted: DataFrame) -> DataFrame:
        # a filter of bounded size spares most sketches the shuffle; the join decides
        wanted = cut(wanted, "wanted-sketches")
        held.append(wanted)
        shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(first_bytes())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            for b in batches:
                mask = pa.array(shared.value.may_hold(id_firsts(b.column(0))))
                yield [b.column(0).filter(mask), b.column(1).filter(mask)]

        return map_arrow(known.select("id", F.coalesce("g", "f").alias("p")), run, "id binary, p binary").join(wanted, "id")

    found = find_links(
        key_rows(rows, hot, small, percent),
        features,
        lambda x, y: near(x, y, percent),
        payloads,
        lambda x, y: links(x, y, percent),
        (long_features, lambda x, y: near_by_long(x, y, percent)),
    )
    linked = components(found)
    comps = known.select("id", "doc_id").join(linked, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    comps = cut(comps, "placed-sets")
    discard(found, linked, *held)
    names = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = comps.join(names, "comp").select("id", "component_id")
    return sets.select("doc_id", "n", "id").join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each component of rows the one with the smallest doc_id, the first of several; rows without doc_id come last.
    Of rows without words, those that repeat another's doc_id and text go."""
    (row,) = fresh(docs, "_row")
    rows = numbered(docs, row)
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("doc"))
    places = similar_sets(rows.select(F.col(row).alias("doc_id"), "text"), percent).where("n_shingles > 0")
    places = cut(places.select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp")).join(ids, "row"), "placed-rows")
    place = F.struct(F.col("doc").isNull(), "doc", "row")
    stays = places.groupBy("comp").agg(F.min(place)["row"].alias("stays"), F.count("*").alias("n")).where("n > 1")
    out = places.join(stays, "comp").where("row <> stays").select("row")
    empty = rows.where(F.col("doc_id").isNotNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\r\x0B\f]")).select(F.col(row).alias("row"), F.col("doc_id").alias("doc"), "text")
    stays = empty.groupBy("doc", "text").agg(F.min("row").alias("stays"), F.count("*").alias("n")).where("n > 1")
    same = (F.col("e.doc") == F.col("s.doc")) & F.col("e.text").eqNullSafe(F.col("s.text"))
    out = out.unionByName(empty.alias("e").join(stays.alias("s"), same).where("row <> stays").select("row"))
    return rows.join(out.withColumnRenamed("row", row), row, "left_anti").select(docs.columns)
