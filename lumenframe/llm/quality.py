"""Quality rules: the log-likelihood ratio of hashed word n-grams (one and two words) between a trusted-target and a
raw-corpus multinomial, divided by the number of n-grams, against one fixed threshold for every document.

The target is fitted on at most ``TARGET`` documents whose label is good (the smallest ids by hash, so the same ones
every time; the ids alone travel to the tasks), the raw corpus is all documents. Counts are summed per task into arrays
of a fixed size (``BUCKETS``), so what the driver holds doesn't grow with the corpus, and texts are never shuffled. The threshold is read off the
scores of all labelled documents, counted into fixed steps (a good one's own n-grams left out of the target, so that it is scored as an
unlabelled one would be): the one with the fewest errors, where losing a good
document weighs ``LOSS`` times as much as keeping a bad one; of equal ones the middle of the lowest gap.

Edge cases: null and empty texts have no words and fail the base rules. Words are split at ASCII white space only.
Labels that contradict each other count as bad; labels of unknown documents and rows without id don't count; repeated
documents count each time. Without any good label all scores are 0 and the base rules alone decide. Extra columns
pass through; clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.batches import append_arrays
from lumenframe.llm.linking import map_arrow
from lumenframe.llm.words import MIX, Slice, scramble, slices
from lumenframe.plans.scratch import cut

BUCKETS = 1 << 16
#: Most labelled documents that the target multinomial is fitted on.
TARGET = 200_000
LOSS = 20
MIN_WORDS, MOST_REPEATED = 50, 50
#: Scores are counted in steps of 1 / STEPS between -SPAN and SPAN.
STEPS, SPAN = 256, 16
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

#: Bytes that are symbols, and those that begin a code point.
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
BEGINS = (np.arange(256) & 0xC0) != 0x80


def grams(h: np.ndarray) -> np.ndarray:
    """The bucket of every word and of every two words in a row."""
    two = (h[:-1] * MIX) ^ (h[1:] + (h[:-1] >> np.uint64(7)))
    two ^= two >> np.uint64(29)
    return (np.concatenate((h, two * MIX)) >> np.uint64(64 - 16)).astype(np.int64)


def n_repeated(h: np.ndarray) -> int:
    """Words within three-word windows found twice or more."""
    n = len(h)
    if n < 4:
        return 0
    three = scramble(scramble(scramble(h[:-2]) + h[1:-1]) + h[2:])
    s = np.sort(three)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.isin(three, s[1:][same])
    covered = np.zeros(n, bool)
    covered[: n - 2] |= twice
    covered[1 : n - 1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def n_repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    worded = [line for line in lines if line.strip()]
    return len(worded) - len(set(worded))


def base_values(s: Slice, k: int) -> tuple:
    """BASE's values of a slice's text."""
    x, y = s.offsets[k], s.offsets[k + 1]
    h, data = s.hashes(k), s.data[x:y]
    chars = int(np.count_nonzero(s.inside[x:y] & BEGINS[data]))
    repeated = n_repeated(h)
    failed = len(h) < MIN_WORDS or 100 * repeated > MOST_REPEATED * len(h)
    return len(h), chars, int(np.count_nonzero(IS_SYMBOL[data])), n_repeated_lines(data.tobytes()), repeated, failed


@dataclass(frozen=True)
class Model:
    """Counts by bucket of target and raw corpus, and the score below which a document goes."""

    target: np.ndarray
    raw: np.ndarray
    threshold: float

    @cached_property
    def weights(self) -> np.ndarray:
        """Log of target over raw frequency, one added to each count."""
        if not self.target.any():
            return np.zeros(BUCKETS)
        target, raw = ((c + 1) / (c.sum() + BUCKETS) for c in (self.target, self.raw))
        return np.log(target) - np.log(raw)

    def score(self, g: np.ndarray) -> float:
        """Of a document's ``grams``."""
        return float(self.weights[g].mean()) if len(g) else 0.0

    def held_out(self, g: np.ndarray) -> float:
        """The score of a document of the target, were it not in it."""
        if not len(g) or not self.target.any():
            return 0.0
        _, of, counts = np.unique(g, return_inverse=True, return_counts=True)
        total = self.target.sum() + BUCKETS
        with_it = self.target[g] + 1
        return self.score(g) + float(np.log(np.maximum(with_it - counts[of], 1) / with_it).mean()) + float(np.log(total / max(total - len(g), 1)))


def with_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``docs`` with ``_good``: 1, 0, or null without label."""
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).cast("int").alias("_good"))
    return docs.join(marks, F.col(doc_id) == F.col("_id"), "left").drop("_id")


def trusted_ids(labels: DataFrame, most: int = TARGET, doc_id: str = "doc_id", quality: str = "quality") -> np.ndarray:
    """Of the documents whose labels are good, at most ``most`` ids, sorted."""
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(quality).alias("good"))
    drawn = marks.where("good = 1").orderBy(F.xxhash64("id"), "id").limit(most).select("id").toArrow()
    return np.sort(drawn.column("id").to_numpy())


def fit_counts(docs: DataFrame, trusted: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """How often each bucket occurs in the target, and in the raw corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(trusted)  # at most TARGET ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            mine = np.isin(b.column(0).fill_null(-1).to_numpy(), shared.value) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for s in slices(b.column(1)):
                g = grams(s.words)
                n = len(s.words)
                across = s.at[(s.at > 0) & (s.at < n)] - 1 + n  # two words of two texts
                raw += np.bincount(g, minlength=BUCKETS) - np.bincount(g[np.unique(across)], minlength=BUCKETS)
                for k in np.flatnonzero(mine[s.first : s.first + len(s)]):
                    np.add.at(target, grams(s.hashes(k)), 1)
        at = np.flatnonzero(raw)
        yield [pa.array(at), pa.array(raw[at]), pa.array(target[at])]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sums = map_arrow(rows, run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, sums["bucket"]], counts[1, sums["bucket"]] = sums["target"], sums["raw"]
    return counts


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(b: pa.RecordBatch) -> tuple[list[pa.Array], pa.Array | None]:
        m, stay = shared.value, []
        for s in slices(b.column(b.schema.get_field_index(text))):
            for k in range(len(s)):
                h = s.hashes(k)
                failed = len(h) < MIN_WORDS or 100 * n_repeated(h) > MOST_REPEATED * len(h)
                stay.append(not failed and m.score(grams(h)) >= m.threshold)
        return [], pa.array(stay, pa.bool_())

    return append_arrays(docs, run, T.StructType())


def score(docs: DataFrame, model: Model, trusted: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, BASE's columns, score and held_out (the score without the document's own
    share of the target)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, trusted))  # BUCKETS numbers and at most TARGET ids
    names = [f.name for f in T._parse_datatype_string(BASE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        m, known = shared.value
        for b in batches:
            mine = np.isin(b.column(0).cast(pa.int64()).fill_null(-1).to_numpy(), known) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows = []
            for s in slices(b.column(1)):
                for k in range(len(s)):
                    g = grams(s.hashes(k))
                    scored = m.score(g)
                    rows.append((*base_values(s, k), scored, m.held_out(g) if mine[s.first + k] else scored))
            yield [b.column(0), *(pa.array([r[i] for r in rows]) for i in range(len(names) + 2))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, {BASE}, score double, held_out double")


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """From doc_id, score, held_out and base_failed of all documents; what fails the base rules doesn't count."""
    marked = with_labels(scored.where("not base_failed"), labels).where("_good is not null")
    score = F.when(F.col("_good") == 1, F.col("held_out")).otherwise(F.col("score"))
    step = F.floor(F.least(F.greatest(score, F.lit(-SPAN)), F.lit(SPAN)) * STEPS).cast("int")
    seen = marked.groupBy(step.alias("step")).agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")).toPandas().sort_values("step")
    if not len(seen) or not seen["good"].sum():
        return -np.inf
    # keeping from step k on loses the good ones below and keeps the bad ones from there
    lost = np.concatenate(([0], seen["good"].cumsum())) * LOSS
    left = seen["bad"].sum() - np.concatenate(([0], seen["bad"].cumsum()))
    k = int(np.argmin(lost + left))
    if k == 0:
        return -np.inf
    low = int(seen["step"].iloc[k - 1]) + 1
    return (low + (int(seen["step"].iloc[k]) if k < len(seen) else low)) / 2 / STEPS


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[Model, DataFrame]:
    """The model, and every document's id, BASE's columns and score."""
    trusted = trusted_ids(labels, TARGET)
    target, raw = fit_counts(docs, trusted, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = cut(score(rows, Model(target, raw, -np.inf), trusted), "quality")
    return Model(target, raw, threshold(scored, labels)), scored


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of every document: doc_id, BASE's columns, score, held_out, kept."""
    model, scored = fit(docs, labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return judge(docs, fit(docs, labels)[0])
