"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue over all
trees, then exact reranking of the leaves' rows.

The forest is fitted on a bounded sample (``SAMPLE`` distinct vectors, the smallest by hash); every row is indexed.
A node splits its vectors at the median of their projection on the line between two of them. A query's queue gives
the leaf whose worst margin on the way is best, over all trees, until leaves with ``SEARCH`` rows, or ``SHARE`` of all,
are met; rows of a leaf are counted over the whole index. The share suits vectors whose neighbours are hardly nearer
than the rest, as measured in the README; where neighbours stand out, 0 keeps a search's work constant. Rows and queries of a leaf then meet in one group and are compared in double
precision on the original vectors. A leaf is cut into blocks of ``BLOCK`` rows, so a hot one is no large group.

Equal vectors are one index row, which keeps as many of its smallest ids as can be asked for (k + 1), so a
vector that many rows share neither crowds a leaf nor hides others.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; likewise rows without
id. Fewer candidates than k: all that are found. Ties go to the smaller id. Rows that repeat an id with one vector
count once. An empty table gives no rows. Vectors of different lengths have no cosine: each length has an index of its
own, and a query meets candidates of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.linking import map_arrow
from lumenframe.plans.scratch import cut

#: Queries whose nearest a task gathers before it passes them on.
HELD = 50_000
TREES, LEAF, SAMPLE, SEARCH, SHARE, BLOCK = 16, 96, 65_536, 8_000, 0.4, 2_048


@dataclass
class Tree:
    """Inner nodes: normal, offset, two children; a child below 0 is leaf ~child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children = [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(3):
                i, j = rng.choice(rows, 2, replace=False)
                normal = x[i] - x[j]
                p = x[rows] @ normal
                at = float(np.median(p))
                right = p > at
                if 0 < right.sum() < len(rows):
                    split = normal, at, right
                    break
        if split is None:
            me, leaves = ~leaves, leaves + 1
        else:
            me = len(normals)
            normals.append(split[0] / np.linalg.norm(split[0]))
            offsets.append(split[1] / np.linalg.norm(split[0]))
            children.append([0, 0])
            todo += [(rows[split[2]], me, 1), (rows[~split[2]], me, 0)]
        if parent >= 0:
            children[parent][side] = me
    dim = x.shape[1]
    return Tree(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def fit_forest(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [fit_tree(x, leaf, rng) for _ in range(trees)] if len(x) else []


def assign(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """The leaf of every row in every tree: rows by trees."""
    out = np.zeros((len(x), len(forest)), np.int64)
    for t, tree in enumerate(forest):
        node = np.zeros(len(x), np.int64)
        if not len(tree.children):
            continue
        live = np.arange(len(x))
        while len(live):
            at = node[live]
            right = np.einsum("ij,ij->i", x[live], tree.normals[at]) > tree.offsets[at]
            node[live] = tree.children[at, right.astype(np.int64)]
            live = live[node[live] >= 0]
        out[:, t] = ~node
    return out


def search(forest: list[Tree], sizes: list[np.ndarray], margins: list[np.ndarray], enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until their rows are enough. ``margins``: by tree, the
    query's distance from every node's plane."""
    heap = [(-np.inf, t, 0 if len(tree.children) else -1) for t, tree in enumerate(forest)]
    out, met = [], 0
    while heap and met < enough:
        d, t, node = heapq.heappop(heap)
        if node < 0:
            out.append((t, ~node))
            met += int(sizes[t][~node])
            continue
        m = float(margins[t][node])
        left, right = forest[t].children[node]
        heapq.heappush(heap, (max(d, m), t, int(left)))
        heapq.heappush(heap, (max(d, -m), t, int(right)))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Of vectors of one length, without nulls."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, enough: int = SEARCH, share: float = SHARE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): of every row whose id ``every`` divides, its nearest others."""
    spark = vectors.sparkSession
    e = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0))
    rows = rows.dropDuplicates(["id", "v"])
    # equal vectors: the k + 1 smallest ids
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    index = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "vectors")
    lengths = [r[0] for r in index.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # nearly always one
    found = [nearest_of_length(index.where(F.size("v") == n), rows.where(F.size("v") == n), n, k, every, trees, leaf, sample, enough, share) for n in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def nearest_of_length(index: DataFrame, rows: DataFrame, dim: int, k: int, every: int, trees: int, leaf: int, sample: int, enough: int, share: float) -> DataFrame:
    """``nearest`` among vectors of ``dim`` components: ``index`` (v, ids, h: distinct vectors) and ``rows`` (id, v)."""
    spark = index.sparkSession
    drawn = index.orderBy("h", "v").limit(sample).select("v").toArrow()  # bounded by ``sample``
    x = np.array(drawn.column("v").to_pylist(), float)
    forest = fit_forest(unit(x), trees, leaf)
    kind = index.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(forest)  # 2 * sample / leaf nodes a tree

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            at = assign(shared.value, unit(matrix(b.column(0))))
            n, t = at.shape
            take = pa.array(np.repeat(np.arange(n), t))
            yield [pa.array(np.tile(np.arange(t), n)), pa.array(at.ravel()), b.column(0).take(take), b.column(1).take(take)]

    placed = map_arrow(index.select("v", "ids"), leaves_of, f"tree int, leaf int, v {kind}, ids array<bigint>")
    placed = cut(placed, "leaves")
    counts = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in counts.collect():  # leaves of the forest: bounded by the sample
        sizes[r["tree"]][r["leaf"]] = r["n"]
    enough = max(enough, int(share * sizes[0].sum()))
    counted = spark.sparkContext.broadcast(sizes)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        f = shared.value
        for b in batches:
            q = unit(matrix(b.column(1)))
            margins = [q @ t.normals.T - t.offsets if len(t.children) else np.zeros((len(q), 0)) for t in f]
            found = [search(f, counted.value, [m[i] for m in margins], enough) for i in range(len(q))]
            take = pa.array(np.repeat(np.arange(len(q)), [len(x) for x in found]), pa.int64())
            flat = [x for y in found for x in y]
            yield [pa.array([t for t, _ in flat], pa.int32()), pa.array([x for _, x in flat], pa.int32()), b.column(0).take(take), b.column(1).take(take)]

    asked = rows.where(F.col("id") % every == 0)
    probe = map_arrow(asked.select("id", "v"), probes, f"tree int, leaf int, query_id long, v {kind}")
    # a leaf's blocks hold BLOCK rows; every probe of the leaf goes to each of them
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    held = placed.join(counts, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("v"), blocks).cast("int")).select("tree", "leaf", "block", "v", "ids")
    probe = probe.join(counts, ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("tree", "leaf", "block", "query_id", "v")
    both = held.select("tree", "leaf", "block", F.lit(None).cast("long").alias("query_id"), "v", "ids").unionByName(probe.withColumn("ids", F.lit(None).cast("array<bigint>")))
    dealt = both.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "query_id")  # index rows first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        now, ids, vs, least, norms = None, [], np.empty((0, dim)), np.empty(0, np.int64), np.empty(0)
        best: dict[int, dict[int, float]] = {}  # of each query, what the task has met so far

        def nearest_of(met: dict[int, float]) -> list[tuple[int, float]]:
            return sorted(met.items(), key=lambda x: (-x[1], x[0]))[:k]

        def flush() -> Iterator[list[pa.Array]]:
            out = [(q, i, s) for q, met in best.items() for i, s in nearest_of(met)]
            best.clear()
            if out:
                yield [pa.array(c) for c in zip(*out, strict=True)]

        for b in batches:
            v = matrix(b.column(4))
            queries, owned = b.column(3).to_pylist(), b.column(5).to_pylist()
            marks = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                key = tuple(marks[x])
                if key != now:
                    now, ids, vs = key, [], vs[:0]
                n = next((i for i in range(x, y) if queries[i] is not None), y)
                if n > x:  # index rows, which come first
                    ids, vs = ids + owned[x:n], np.concatenate((vs, v[x:n]))
                    least, norms = np.array([i[0] for i in ids]), np.linalg.norm(vs, axis=1)
                for i in range(n, y) if ids else ():
                    q = v[i]
                    score = (vs * q).sum(axis=1) / (norms * np.sqrt((q * q).sum()))
                    top = range(len(ids)) if len(ids) <= k + 1 else np.argpartition(-score, k)[: k + 1]
                    if len(ids) > k + 1:  # all that tie with the last
                        top = np.flatnonzero(score >= score[top].min())
                        top = top[np.lexsort((least[top], -score[top]))][: k + 1]
                    mine = sorted((-float(score[t]), j) for t in top for j in ids[t] if j != queries[i])[:k]
                    met = best.setdefault(queries[i], {})
                    for s, j in mine:
                        if -s > met.get(j, -2.0):
                            met[j] = -s
                    if len(met) > 8 * k:
                        best[queries[i]] = dict(nearest_of(met))
            if len(best) > HELD:
                yield from flush()
        yield from flush()

    found = map_arrow(dealt, compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
