"""Positions of rows in a total order, without one task that holds them all.

Rows are dealt by range and sorted within partitions; a partition's rows are numbered on the spot, and the number of rows
in the partitions before it (one number a partition) is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.scratch import cut, fresh


def with_positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with its rows' places (long, from 1) in ``order``."""
    part, at = fresh(df, "_part", "_at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "positions")
    counts = held.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect()  # a row per partition
    before, seen = [], 0
    for r in counts:
        before.append((r[part], seen))
        seen += r["n"]
    if not before:
        return held.select(*df.columns, F.lit(None).cast("long").alias(name))
    start = F.create_map(*[F.lit(x) for pair in before for x in pair])[F.col(part)]
    # the low 33 bits number the rows of a partition
    return held.select(*df.columns, (start + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long").alias(name))


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """``df`` with the mean of the places that equal values share."""
    placed = with_positions(df.select(value).where(F.col(value).isNotNull()), value, name="_place")
    ranks = placed.groupBy(value).agg(F.avg("_place").alias(name))
    return df.join(ranks, value, "left")
