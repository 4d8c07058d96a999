"""Weighted-neighbour classification over feature spaces, for one split or many at once.

Column statistics and weights are two-level aggregates. Both sides' selected columns then meet in an equi-join of blocks:
the train set is packed, ``BLOCK_ROWS`` rows to a row, and goes to each block of test rows of its split, whose task reads
it as a stream and reduces what it keeps of a pair on the spot: class sums, extremes, nearest rows. So a task holds a
block of test rows, what is kept of it and a batch of packed rows; the driver gets one count a split. There are about two
blocks a core, of at most ``CHUNK_ROWS`` rows. Only ids travel; labels are joined last.

Distances come from one product of matrices a tile that fits the cache, about the middle of the packed rows; where two
rows are so near that the product loses digits, they are summed from direct differences again.

A missing, null or non-real feature scales to 0. Pairs at a squared distance of ``EPS`` or less collide and don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe.plans.relations import EPS, long_form, run_plan

#: Rows of a packed block and, if they are wide, its numbers; rows of a test block, at most and (for parallel work) at least.
BLOCK_ROWS, BLOCK_NUMBERS, CHUNK_ROWS, LEAST_ROWS = 8_192, 1 << 17, 1 << 16, 64
#: Pairs of a tile and its train rows; sums by class that a task holds at most.
TILE, TILE_COLUMNS, HELD = 1 << 16, 1_024, 1 << 22
#: Squared distances of at most this share of both rows' squares (or this much) are summed from direct differences.
NEAR, LEAST = 1e-3, 1e-12
NONE = np.empty(0, np.int64)


def fisher_weights(samples: DataFrame) -> DataFrame:
    """fidx, w of min-max scaled columns."""
    return run_plan("SELECT fidx, w FROM fisher", long=long_form(samples))


@dataclass(frozen=True)
class Model:
    """The selected columns of a split: their index, minimum, maximum and weight."""

    idx: np.ndarray
    mn: np.ndarray
    mx: np.ndarray
    w: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Of the selected columns: clipped to the range, scaled to 0 .. 100, weighted."""
        wide = np.where(self.mx == self.mn, 1.0, self.mx - self.mn)
        v = 100.0 * (np.clip(x, self.mn, self.mx) - self.mn) / wide
        return np.where((self.mx == self.mn) | np.isnan(v), 0.0, v) * self.w

    def rooted(self) -> Model:
        """With weights that count once in a squared distance."""
        return Model(self.idx, self.mn, self.mx, np.sqrt(self.w))


Models = dict[int, Model]


def models(rows, order: str = "fidx") -> Models:
    """By split, of a small table (split, fidx, mn, mx, w); columns in the order of one of these or of another."""
    return {int(s): Model(*(g.sort_values(order)[c].to_numpy() for c in ("fidx", "mn", "mx", "w"))) for s, g in rows.groupby("split")}


def model(train: DataFrame, top: int) -> Models:
    """The ``top`` heaviest columns, as the one split 0."""
    return models(run_plan(f"SELECT 0 AS split, fidx, mn, mx, w FROM ranked JOIN mm USING (fidx) WHERE r <= {int(top)}", long=long_form(train)).toPandas())  # a row per selected column


@dataclass(frozen=True)
class Known:
    """Packed train rows, in the order of their classes: ids, and the classes' names and first places (one more at the end)."""

    ids: np.ndarray
    names: list[str]
    first: np.ndarray


class Reduction:
    """What is kept of the distances of a block of test rows; one for each number of columns.

    ``tile`` takes distances between the rows from ``at`` on and the train rows from ``to`` on; it may overwrite them.
    ``i`` and ``j`` are the tile's pairs so near that they may collide, with distances from direct differences."""

    schema = ""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def tile(self, at: int, to: int, d: np.ndarray, i: np.ndarray, j: np.ndarray, known: Known, exact: Exact) -> Iterator[list]:
        raise NotImplementedError

    def ready(self) -> Iterator[list]:
        """After each block of train rows: columns that need not be held any longer."""
        return iter(())

    def done(self) -> Iterator[list]:
        return iter(())


#: The distances, from direct differences, of pairs of a tile.
Exact = Callable[[np.ndarray, np.ndarray], np.ndarray]


class ClassSums(Reduction):
    """t, rl, n, s: of each test row and class, pairs that don't collide and their sum of d ** -5."""

    schema = "t long, rl string, n long, s double"

    def __init__(self, ids: np.ndarray):
        super().__init__(ids)
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.room = None

    def tile(self, at, to, d, i, j, known, exact):
        gone = d[i, j] <= EPS
        i, j = i[gone], j[gone]
        d[i, j] = np.inf
        np.divide(1.0, d, out=d)
        if self.room is None or self.room.shape != d.shape:
            self.room = np.empty(d.shape)
        s = np.multiply(d, d, out=self.room)
        s *= s
        s *= d
        rows, width = d.shape
        k = int(np.searchsorted(known.first, to, "right")) - 1
        last = int(np.searchsorted(known.first, to + width, "left"))
        bounds = np.clip(known.first[k : last + 1] - to, 0, width)
        sums = np.add.reduceat(s, bounds[:-1], axis=1)
        lost = np.zeros(sums.shape, np.int64)
        if len(i):
            np.add.at(lost, (i, np.searchsorted(bounds, j, "right") - 1), 1)
        for c in range(last - k):
            if known.names[k + c] not in self.held:
                self.held[known.names[k + c]] = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
            n, total = self.held[known.names[k + c]]
            n[at : at + rows] += bounds[c + 1] - bounds[c] - lost[:, c]
            total[at : at + rows] += sums[:, c]
        return iter(())

    def ready(self):
        return self.done() if len(self.held) * len(self.ids) > HELD else iter(())

    def done(self):
        for name, (n, s) in self.held.items():
            yield [self.ids, np.full(len(n), name, object), n, s]
        self.held = {}


class Extremes(Reduction):
    """t, pairs, lo, hi over pairs that don't collide."""

    schema = "t long, pairs long, lo double, hi double"

    def __init__(self, ids: np.ndarray):
        super().__init__(ids)
        self.pairs, self.lo, self.hi = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), np.full(len(ids), -np.inf)

    def tile(self, at, to, d, i, j, known, exact):
        mine = slice(at, at + len(d))
        np.maximum(self.hi[mine], d.max(axis=1), out=self.hi[mine])  # of collisions only where there is nothing else
        gone = d[i, j] <= EPS
        d[i[gone], j[gone]] = np.inf
        np.minimum(self.lo[mine], d.min(axis=1), out=self.lo[mine])
        self.pairs[mine] += d.shape[1] - np.bincount(i[gone], minlength=len(d))
        return iter(())

    def done(self):
        some = self.pairs > 0
        yield [self.ids[some], self.pairs[some], self.lo[some], self.hi[some]]


class AllPairs(Reduction):
    """t, r, d of every pair that doesn't collide; nothing is held."""

    schema = "t long, r long, d double"

    def tile(self, at, to, d, i, j, known, exact):
        rows, width = d.shape
        kept = np.ones(d.shape, bool)
        kept[i, j] = d[i, j] > EPS
        kept = kept.ravel()
        yield [np.repeat(self.ids[at : at + rows], width)[kept], np.tile(known.ids[to : to + width], rows)[kept], d.ravel()[kept]]


def nearest_rows(k: int, least: float = EPS, apart: bool = False) -> type[Reduction]:
    """t, r, d of the k nearest at more than ``least``; ties to the smaller id; ``apart``: never the row itself."""

    class Nearest(Reduction):
        schema = AllPairs.schema

        def __init__(self, ids: np.ndarray):
            super().__init__(ids)
            self.r, self.d = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)

        def tile(self, at, to, d, i, j, known, exact):
            rows, width = d.shape
            t, r = self.ids[at : at + rows], known.ids[to : to + width]
            gone = d[i, j] <= least
            d[i[gone], j[gone]] = np.inf
            if apart:
                d[t[:, None] == r[None, :]] = np.inf
            best, ids = self.d[at : at + rows], self.r[at : at + rows]
            most = best[:, -1]
            if width > k and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            # a product's distances may be off in their last digits: who comes near is measured directly
            i, j = places(d <= np.minimum(most * (1 + 1e-9), np.finfo(float).max)[:, None])
            if len(i):
                new = exact(i, j)
                i, j, new = (x[new > least] for x in (i, j, new))
                touched, back = np.unique(i, return_inverse=True)
                row = np.concatenate((np.repeat(np.arange(len(touched)), k), back))
                far = np.concatenate((best[touched].ravel(), new))
                who = np.concatenate((ids[touched].ravel(), r[j]))
                order = np.lexsort((who, far, row))
                row, far, who = row[order], far[order], who[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < k
                best[touched] = far[kept].reshape(-1, k)
                ids[touched] = who[kept].reshape(-1, k)
            return iter(())

        def done(self):
            i, j = np.nonzero(np.isfinite(self.d))
            yield [self.ids[i], self.r[i, j], self.d[i, j]]

    return Nearest


def selected(samples: DataFrame, by: Models) -> DataFrame:
    """split, sample_id, label, x (the split's selected columns) of samples with a column ``split``."""
    rows = [(s, [int(i) for i in m.idx]) for s, m in by.items()]
    chosen = F.broadcast(samples.sparkSession.createDataFrame(rows, "split int, idx array<int>"))  # the columns of a model a split
    x = F.transform("idx", lambda i: F.get("features", i))
    return samples.join(chosen, "split").select("split", "sample_id", "label", x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; null: not a number."""
    flat = column.flatten()
    return flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(column), width)


def packed(known: DataFrame, by: Models) -> DataFrame:
    """split, ids, names, first, z: rows of a split in blocks, in the order of their classes; z in single precision where
    that says the same. A task holds a block a split that it meets."""
    kind = T._parse_datatype_string("split int, ids binary, names array<string>, first array<int>, z binary")
    out = to_arrow_schema(kind)
    block_rows, block_numbers = BLOCK_ROWS, BLOCK_NUMBERS

    def block(split: int, parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        x = matrix(t.column("x").combine_chunks(), len(by[split].idx))
        label = t.column("label").cast(pa.string()).fill_null("").combine_chunks().dictionary_encode()
        of = label.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(label.dictionary) + 1))
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        z = short if np.array_equal(short, x, equal_nan=True) else x
        cols = [[split], [t.column("sample_id").to_numpy()[order].astype(np.int64).tobytes()], [label.dictionary.to_pylist()], [first.tolist()], [z[order].tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for b in batches:
            splits = b.column(0).to_numpy()
            for split in np.unique(splits).tolist():
                most = max(1, min(block_rows, block_numbers // max(1, len(by[split].idx))))
                rest = pa.Table.from_batches([b.filter(pa.array(splits == split))])
                while rest.num_rows:
                    parts = held.setdefault(split, [])
                    room = most - sum(p.num_rows for p in parts)
                    parts.append(rest.slice(0, room))
                    rest = rest.slice(room)
                    if parts[-1].num_rows == room:
                        yield block(split, held.pop(split))
        for split, parts in held.items():
            yield block(split, parts)

    return known.mapInArrow(run, kind)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set, which is mostly nothing."""
    return np.nonzero(mask) if mask.any() else (NONE, NONE)


def tiles(reductions: list[Reduction], steps: list[int], x: np.ndarray, z: np.ndarray, known: Known) -> Iterator[tuple[int, list]]:
    """Runs all pairs of ``x`` and ``z`` through the reductions, each of which sees the first columns, as many as its step."""
    middle, sides = z.mean(axis=0), []
    for low, high in zip([0, *steps], steps, strict=False):  # columns, squares and ones, whose product is squared distances
        a, b = (v[:, low:high] - middle[low:high] for v in (x, z))
        own, other = ((v * v).sum(axis=1)[:, None] for v in (a, b))
        sides.append((np.concatenate((a * -2.0, own, np.ones_like(own)), axis=1), np.concatenate((b, np.ones_like(other), other), axis=1).T, own * NEAR, other.T * NEAR + LEAST))
    size = min(TILE_COLUMNS, len(z))
    height = max(1, min(TILE // size, len(x)))
    rooms = [np.empty((height, size), kind) for kind in (float, float, bool)]
    for to in range(0, len(z), TILE_COLUMNS):
        right = z[to : to + TILE_COLUMNS]
        here = [(a, np.ascontiguousarray(b[:, to : to + TILE_COLUMNS]), own, other[:, to : to + TILE_COLUMNS]) for a, b, own, other in sides]
        for at in range(0, len(x), height):
            left = x[at : at + height]
            for which, (r, step, (a, b, own, other)) in enumerate(zip(reductions, steps, here, strict=True)):

                def exact(i: np.ndarray, j: np.ndarray, step: int = step, left: np.ndarray = left, right: np.ndarray = right) -> np.ndarray:
                    d = np.zeros(len(i))
                    for f in range(min(step, right.shape[1])):  # direct differences: no cancellation near zero
                        d += (left[i, f] - right[j, f]) ** 2
                    return d

                d, limit = (room[: len(left), : len(right)] for room in rooms[:2])
                np.matmul(a[at : at + height], b, out=d)
                np.add(own[at : at + height], other, out=limit)
                if which:
                    d += whole
                    limit += near
                if which + 1 < len(steps):
                    whole, near = d.copy(), limit.copy()
                i, j = places(np.less_equal(d, limit, out=rooms[2][: len(left), : len(right)]))
                if len(i):
                    d[i, j] = exact(i, j)
                for cols in r.tile(at, to, d, i, j, known, exact):
                    yield which, cols
    for which, r in enumerate(reductions):
        for cols in r.ready():
            yield which, cols


def meet(test: DataFrame, train: DataFrame, by: Models, reduce: type[Reduction], steps: list[int] | None = None) -> DataFrame:
    """split and the columns of ``reduce``: what it makes of the distances between rows of ``test`` and of ``train`` (both
    with a column ``split``) in each split. With ``steps``, also a column ``step``: the same for the models' first columns,
    as many as each step says (in ascending order)."""
    spark = test.sparkSession
    kind = T._parse_datatype_string("split int, step int, " + reduce.schema)
    out_schema = to_arrow_schema(kind)
    rows_of = {int(r["split"]): r["count"] for r in test.groupBy("split").count().collect() if r["split"] in by}  # a row a split
    wanted, first, start = -(-2 * spark.sparkContext.defaultParallelism // max(1, len(rows_of))), {}, 0
    for split, n in sorted(rows_of.items()):
        first[split] = start, max(-(-n // CHUNK_ROWS), min(wanted, -(-n // LEAST_ROWS)))
        start += first[split][1]
    dealt = F.broadcast(spark.createDataFrame([(s, a, n) for s, (a, n) in first.items()], "split int, _from int, _n int"))  # a row a split
    asked = selected(test, by).join(dealt, "split").select((F.col("_from") + F.pmod(F.xxhash64("sample_id"), F.col("_n"))).cast("int").alias("block"), "split", F.lit(-1).cast("long").alias("at"), "sample_id", "x", *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("names", "array<string>"), ("first", "array<int>"), ("z", "binary"))])
    known = packed(selected(train, by), by).withColumn("at", F.monotonically_increasing_id()).join(dealt, "split")
    known = known.select(F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("block"), "split", "at", F.lit(None).cast("long").alias("sample_id"), F.lit(None).cast("array<double>").alias("x"), "ids", "names", "first", "z")
    together = asked.withColumn("x", F.col("x").cast("array<double>")).unionByName(known).repartitionById(max(1, start), "block").sortWithinPartitions("block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(split: int, found: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            for which, cols in found:
                n = len(cols[0])
                given = [np.full(n, split, np.int32), np.full(n, marks[which], np.int32), *cols]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(given, out_schema, strict=True)], schema=out_schema)

        block, split, parts, x, reductions, marks = None, None, [], None, None, []
        for b in batches:
            blocks, ats = b.column("block").to_numpy(), b.column("at").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (ats[1:] >= 0) | (ats[:-1] >= 0), [True])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blocks[lo] != block:
                    if reductions is not None:
                        for which, r in enumerate(reductions):
                            yield from made(split, ((which, cols) for cols in r.done()))
                    block, split, parts, reductions = blocks[lo], b.column("split")[lo].as_py(), [], None
                if ats[lo] < 0:
                    part = b.slice(lo, hi - lo)
                    parts.append((part.column("sample_id").to_numpy(), by[split].scaled(matrix(part.column("x"), len(by[split].idx)))))
                    continue
                if not parts:
                    continue
                width = len(by[split].idx)
                if reductions is None:
                    ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    marks = steps or [width]
                    reductions = [reduce(ids) for _ in marks]
                r = np.frombuffer(b.column("ids")[lo].as_buffer(), np.int64)
                z = b.column("z")[lo].as_buffer()
                z = np.frombuffer(z, np.float32 if z.size == 4 * len(r) * width else np.float64).reshape(len(r), width)
                of = Known(r, b.column("names")[lo].as_py(), np.array(b.column("first")[lo].as_py()))
                yield from made(split, tiles(reductions, marks, x, by[split].scaled(z.astype(float)), of))
        if reductions is not None:
            for which, r in enumerate(reductions):
                yield from made(split, ((which, cols) for cols in r.done()))

    found = together.mapInArrow(run, kind)
    return found if steps else found.drop("step")


def similarities(test: DataFrame, train: DataFrame, by: Models) -> DataFrame:
    """split, t, rl, s: mean of d ** -5 over the pairs of a test row and a class that don't collide. Classes whose
    pairs all collide give no row."""
    return mean_similarities(meet(test, train, by, ClassSums), "split")


def similarities_by_step(test: DataFrame, train: DataFrame, by: Models, steps: list[int]) -> DataFrame:
    """split, step, t, rl, s: the same with the first ``step`` columns of the models, which list them by rank."""
    return mean_similarities(meet(test, train, by, ClassSums, steps), "split", "step")


def mean_similarities(sums: DataFrame, *by: str) -> DataFrame:
    met = sums.groupBy(*by, "t", "rl").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return met.where("n > 0").select(*by, "t", "rl", (F.col("s") / F.col("n")).alias("s"))


def nearest(test: DataFrame, train: DataFrame, by: Models, k: int, least: float = EPS, apart: bool = False) -> DataFrame:
    """split, t, r, d, k (from 1) of each test row's nearest train rows."""
    met = meet(test, train, by, nearest_rows(k, least, apart))
    order = W.partitionBy("split", "t").orderBy("d", "r")
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def distance_ranges(test: DataFrame, train: DataFrame, by: Models) -> DataFrame:
    """split, t, pairs, lo, hi."""
    return meet(test, train, by, Extremes).groupBy("split", "t").agg(F.sum("pairs").alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def one_split(samples: DataFrame) -> DataFrame:
    return samples.withColumn("split", F.lit(0))


def wnd5(test: DataFrame, train: DataFrame, top: int) -> DataFrame:
    """t, rl, p (marginal probability), log_norm, pl (predicted): samples are sample_id, label, value, grp, seq,
    features. Classes whose pairs all collide give no row; any number of test rows will do, one included."""
    sims = similarities(one_split(test), one_split(train), model(train, top))
    w = W.partitionBy("t")
    p = sims.withColumns({"nf": F.sum("s").over(w), "pl": F.max_by("rl", "s").over(w)})
    return p.select("t", "rl", F.round(F.col("s") / F.col("nf"), 6).alias("p"), F.round(F.log("nf"), 5).alias("log_norm"), "pl")


def same_result(a: DataFrame, b: DataFrame, within: float = 0.005) -> DataFrame:
    """t, same: whether two results (t, rl, p) agree in every class of a row; a class that only one has doesn't."""
    both = a.select("t", "rl", F.col("p").alias("pa")).join(b.select("t", "rl", F.col("p").alias("pb")), ["t", "rl"], "full")
    return both.groupBy("t").agg(F.bool_and(F.coalesce(F.abs(F.col("pa") - F.col("pb")) <= within, F.lit(False))).alias("same"))
