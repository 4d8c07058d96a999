"""The corpus pipeline: quality rules, line dedup, near duplicates, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents. ``run`` writes what
each returns to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import jaccard, lines, packing, quality
from lumenframe.plans.scratch import cut, discard
from lumenframe.plans.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, row by row.

    Null and empty texts go, as they have fewer than 50 words; texts of any length are judged whole. Repeated rows are
    judged alike and all stay or all go; rows without doc_id are judged like others. Equal scores share one threshold.
    Without good labels the base rules alone decide. An empty table stays empty. All columns pass through."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents that lose lines and have no word left.

    Null texts stay; empty ones have no line that repeats and stay. Of lines that tie, that of the smallest doc_id (none
    first), then of the first row, stays. Of repeated rows one keeps its lines, the others go. An empty table stays
    empty. All columns pass through, n_chars in step with the text."""
    return lines.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, of several the first.

    Rows without doc_id come last. Null texts, and such without words, resemble nothing; of those with one doc_id and
    one text one row stays. Texts of any length are compared whole. An empty table stays empty. All columns pass through."""
    return jaccard.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are the end token alone; only documents of more than a sequence are cut. Repeated rows and such
    without doc_id are packed like any other. Equal pieces may change places. An empty table gives no rows. Other
    columns of documents don't pass."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_duplicate_stage), ("best_fit_packing", packing_stage)]

#: Hashed scores, edit distances and token ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = cut(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return docs
