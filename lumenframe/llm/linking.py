"""What the similarity joins share: from rows (KEYS: a key and an id in two words) of an inverted index to the connected components of all links.

No step lists all pairs of a group. Round 1 tests, for each row of a key with several ids, the key's smallest id and
the id before it: pairs grow with the rows. Components of the links found so far come next. Round 2 takes only keys
of more than ``FEW`` ids (of the others round 1 tests all pairs) that still lie in different components, in blocks of
bounded size, and tests every pair across components that an exact bound on features lets through. Every link thus lies
within a component that the links returned also span.

Ids are 16 bytes. Rows of equal key and id count once. Keys are read in order as a stream, so a hot key needs no memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe.llm.batches import whole
from lumenframe.plans.scratch import cut, discard

#: Ids in a block of round 2.
BLOCK = 512
#: Of a key with so many ids or fewer, round 1 tests every pair: each id against the smallest and the one before.
FEW = 3
#: Rows of one key that a task holds at once.
HELD = 100_000
#: Links that a task contracts at once.
EDGES = 1 << 17
LINK, KEYS = "a binary, b binary", "key long, hi long, lo long"
#: Parts that meet at once on the way to one; bits of the largest filter.
FAN, FILTER_BITS = 256, 27


def id_words(column: pa.Array) -> np.ndarray:
    """16-byte ids as rows of two words."""
    at = column.offset
    starts = np.frombuffer(column.buffers()[1], np.int32)[at : at + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<u8", 2 * len(column), int(starts[0])).reshape(-1, 2)


def id_bytes(words: np.ndarray) -> pa.Array:
    words = np.ascontiguousarray(words, "<u8")
    offsets = np.arange(0, 16 * len(words) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(words.tobytes())])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    kind = T._parse_datatype_string(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for columns in run(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(whole(go), kind)


def id_longs(ids: list[bytes]) -> np.ndarray:
    """16-byte ids as rows of two signed words, high bytes first."""
    return np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)


def key_arrays(keys: np.ndarray, ids: list[bytes], counts: list[int]) -> list[pa.Array]:
    """KEYS' columns: ``counts`` keys of each id in order."""
    words = np.repeat(id_longs(ids), counts, axis=0)
    return [pa.array(keys.view(np.int64)), pa.array(np.ascontiguousarray(words[:, 0])), pa.array(np.ascontiguousarray(words[:, 1]))]


def shared_rows(rows: DataFrame) -> DataFrame:
    """Of rows (KEYS): key, id, leader (the key's smallest id), before (the id before; null for the leader), many (more
    than ``FEW`` ids have the key) and block (its place among the key's ids by ``BLOCK``), for keys that several ids have.

    Rows come sorted by key alone, which is one number; ids are sorted here, a key at a time. A key of more than
    ``HELD`` rows goes on in parts: its ids are sorted within each, its leader is the first part's, and one that two
    parts hold has a row in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        hot: tuple[int, np.ndarray, np.ndarray, int] | None = None  # key, leader, last id and rows of a key that goes on
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]

        def emit(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, goes_on: bool) -> Iterator[list[pa.Array]]:
            """Whole keys; the first may continue ``hot``, the last may go on."""
            nonlocal hot
            same = key[1:] == key[:-1]
            several = np.zeros(len(key), bool)
            several[1:] |= same
            several[:-1] |= same
            if hot:
                several |= key == hot[0]
            if goes_on:
                several |= key == key[-1]
            at = np.flatnonzero(several)
            order = at[np.lexsort((lo[at], hi[at], key[at]))]
            key, ids = key[order], np.stack((hi[order], lo[order]), axis=1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
            key, ids = key[new], ids[new]
            if not len(key):
                return
            begins = np.ones(len(key), bool)
            begins[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(key)))
            of = np.repeat(np.arange(len(first)), size)
            rank = np.arange(len(key)) - first[of]
            lead, before, has_before = ids[first][of], np.roll(ids, 1, axis=0), rank > 0
            total = size[of]
            if hot and key[0] == hot[0]:
                mine = of == 0
                rank[mine] += hot[3]
                total = np.where(mine, total + hot[3], total)
                lead[mine], before[0], has_before[0] = hot[1], hot[2], True
            if goes_on:
                total = np.where(of == of[-1], FEW + 1, total)
                hot = int(key[-1]), lead[-1].copy(), ids[-1].copy(), int(rank[-1]) + 1
            else:
                hot = None
            take = np.flatnonzero(total > 1)
            befores = pc.if_else(pa.array(has_before[take]), id_bytes(before[take].byteswap()), pa.scalar(None, pa.binary()))
            yield [pa.array(key[take]), id_bytes(ids[take].byteswap()), id_bytes(lead[take].byteswap()), befores, pa.array(total[take] > FEW), pa.array((rank[take] // BLOCK).astype(np.int32))]

        for b in batches:
            held = [np.concatenate((h, b.column(i).to_numpy().view(h.dtype))) for i, h in enumerate(held)]
            key = held[0]
            last = int(np.searchsorted(key, key[-1]))  # rows from here on may have successors
            if last:
                yield from emit(*(h[:last] for h in held), goes_on=False)
                held = [h[last:] for h in held]
            if len(held[0]) > HELD:
                yield from emit(*held, goes_on=True)
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from emit(*held, goes_on=False)

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, run, "key long, id binary, leader binary, before binary, many boolean, block int")


def merge_chunks(rows: DataFrame, kind: str, add: np.ufunc) -> dict[int, np.ndarray]:
    """Of a stored table (chunk int, part int, f binary: a compressed array of ``kind``), what ``add`` makes of all
    arrays of each chunk. Parts meet in a tree, ``FAN`` at a time and as a stream, so no task holds more than an array or two
    and none reads every part; what comes back is of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        now, total = None, np.empty(0)

        def out() -> list[pa.Array]:
            return [pa.array([now[0]]), pa.array([now[1]]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())]

        for b in batches:
            for chunk, part, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(zlib.decompress(f), kind)
                if (chunk, part) == now:
                    add(total, x, out=total)
                else:
                    if now:
                        yield out()
                    now, total = (chunk, part), x.copy()
        if now:
            yield out()

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        rows = rows.select("chunk", F.floor(F.col("part") / FAN).cast("int").alias("part"), "f").repartition("chunk", "part").sortWithinPartitions("chunk", "part")
        rows = map_arrow(rows, run, "chunk int, part int, f binary")
        if parts == 1:
            return {r["chunk"]: np.frombuffer(zlib.decompress(bytes(r["f"])), kind) for r in rows.collect()}


@dataclass(frozen=True)
class Filter:
    """A set of places, one for each number given; takes others by chance."""

    words: np.ndarray
    size: int

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        """False only for numbers that weren't given."""
        at = np.mod(ids.astype(np.int64), self.size)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def filter_of(ids: DataFrame) -> Filter:
    """Of a stored table (column 1, long): 64 places a number, 2 ** ``FILTER_BITS`` at most, an odd number of them."""
    size = min(1 << FILTER_BITS, max(1 << 16, 64 * ids.count())) | 1
    at = ids.select(F.pmod(F.col(ids.columns[0]), F.lit(size)).alias("at")).where("at is not null")
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()  # at most 2 ** FILTER_BITS / 64 rows
    words = np.zeros((size >> 6) + 1, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(words, size)


def first_bytes(column: str = "id") -> Column:
    """56 bits of an id, as ``id_firsts`` gives them."""
    return F.conv(F.hex(F.substring(column, 1, 7)), 16, 10).cast("long")


def id_firsts(column: pa.Array) -> np.ndarray:
    return id_words(column)[:, 0].byteswap() >> np.uint64(8)


def stars_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (rows of four words, two for each end, high bytes first) every id once and the smallest id of its
    component. Roots hook to smaller neighbours, so their number halves in two rounds at most."""
    ids = ends.reshape(-1, 2)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ids = ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    ids = ids[new]
    a, b = place.reshape(-1, 2).T
    root = np.arange(len(ids))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return ids, ids[root]


def contracted(links: DataFrame, parts: int, most: int) -> DataFrame:
    """id, comp: the links (a, b), each task's own components as stars, found over ``most`` links at a time. A task of
    so many links or fewer gives each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        def out(ids: np.ndarray, roots: np.ndarray) -> list[pa.Array]:
            return [id_bytes(ids.byteswap()), id_bytes(roots.byteswap())]

        held = np.empty((0, 4), np.uint64)
        for b in batches:
            held = np.concatenate((held, np.hstack((id_words(b.column(0)), id_words(b.column(1)))).byteswap()))
            if len(held) > most:
                ids, roots = stars_of(held)
                held = np.hstack((ids, roots))[(ids != roots).any(axis=1)]
                if 2 * len(held) > most:
                    yield out(ids, roots)
                    held = held[:0]
        if len(held):
            yield out(*stars_of(held))

    return map_arrow(links.select("a", "b").coalesce(max(1, parts)), run, "id binary, comp binary")


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id of its component) of every id in ``links`` (a, b; a stored table). Tasks contract what
    they read, ``EDGES`` links at a time; where that takes several tasks, alternating large and small stars follow until
    nothing changes."""
    links, most = links.where("a <> b"), EDGES
    parts = -(-links.count() // most)
    forest = cut(contracted(links, parts, most), "forest")
    if parts <= 1:
        return forest
    e = forest.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
    mark = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, forest = forest, cut(rest.unionByName(low.withColumnRenamed("m", "b")).distinct(), "small-star")
        discard(before, large)
        e = forest
    out = cut(e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()), "components")
    discard(forest)
    return out


def test_pairs(pairs: DataFrame, payload: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose payloads (id, p) pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            mask = pa.array([test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield [b.column(0).filter(mask), b.column(1).filter(mask)]

    one = pairs.join(payload.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
    two = one.join(payload.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b").select("a", "b", "pa", "pb")
    return map_arrow(two, run, LINK)


def cross_pairs(rows: DataFrame, near: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """Of rows (key, x, y, id, comp, f; x <= y: a pair of blocks), the pairs of ids in different components, and of
    different blocks where x < y, whose features are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        held: list[tuple] = []
        now = None

        def tested() -> Iterator[list[pa.Array]]:
            _, x, y = now
            features, comps, blocks = [h[3] for h in held], np.array([h[1] for h in held], object), np.array([h[2] for h in held])
            out_a, out_b = [], []
            for i in range(len(held) - 1):
                may = comps[i + 1 :] != comps[i]
                if x != y:
                    may &= blocks[i + 1 :] != blocks[i]
                at = np.flatnonzero(may)
                if len(at):
                    at = at[near(features[i], [features[i + 1 + j] for j in at])]
                    out_a += [held[i][0]] * len(at)
                    out_b += [held[i + 1 + j][0] for j in at]
            if out_a:
                yield [pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())]

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != now:
                    if len(held) > 1:
                        yield from tested()
                    held, now = [], r[:3]
                held.append(r[3:])
        if len(held) > 1:
            yield from tested()

    dealt = rows.select("key", "x", "y", "id", "comp", "block", "f").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    return map_arrow(dealt, run, LINK)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def find_links(rows: DataFrame, features: Callable[[DataFrame], DataFrame], near: Callable[[bytes, list[bytes]], np.ndarray], payloads: Callable[[DataFrame], DataFrame], test: Callable[[bytes, bytes], bool], finer: tuple[Callable[[DataFrame], DataFrame], Callable[[bytes, bytes], bool]] | None = None) -> DataFrame:
    """Links (a, b) that span the same components as all links between ids that share a key.

    ``features`` gives (id, f) and ``payloads`` (id, p) for a table of ids. ``near`` must let every link through,
    ``test`` decides. ``finer``, if given, has larger features (id, p) and a test on them that lets every link through:
    payloads are then shuffled only for pairs that pass it."""
    shared = cut(shared_rows(rows), "shared")
    stars = shared.where("before is not null").select("id", F.explode(F.array_distinct(F.array("leader", "before"))).alias("to")).select(F.col("id").alias("a"), F.col("to").alias("b"))
    f = cut(features(shared.select("id").distinct()), "features")

    def close(pairs: DataFrame) -> DataFrame:
        return test_pairs(pairs, f.withColumnRenamed("f", "p"), lambda x, y: bool(near(x, [y])[0]))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        asked = cut(pairs, tag)
        if finer:
            asked, before = cut(test_pairs(asked, finer[0](ends(asked)), finer[1]), tag + "-finer"), asked
            discard(before)
        out = cut(test_pairs(asked, payloads(ends(asked)), test), tag + "-links")
        discard(asked)
        return out

    first = verified(close(ordered(stars)), "stars")
    comps = components(first)
    # a hot key's rows meet by block, never in one task
    placed = cut(shared.where("many").select("key", "block", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
    blocks = placed.groupBy("key", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = blocks.groupBy("key").agg((F.max("block") + 1).alias("blocks"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key", "blocks")
    mixed = cut(mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "mixed")
    left = placed.join(mixed, ["key", "block"])
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).join(f, "id")
    second = verified(ordered(cross_pairs(left, near)), "crosses")
    out = cut(first.unionByName(second), "links")
    discard(shared, f, comps, placed, mixed, first, second)
    return out
