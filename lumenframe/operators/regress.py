"""Least squares and linear discriminants over feature arrays, by a QR factor that tasks merge.

A task folds its rows, batch by batch, into the triangular factor of what it has read; factors are rows again, so two
more folds over ever fewer partitions give the factor of all rows. No task holds more than one factor and a batch, and
the driver gets one factor: as large as the square of the features kept, whatever the rows.

Rows whose target or one of whose features is null or not finite take no part in a fit; predictions for such are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions between the rows' own and the last one; groups that may be left out in turn.
FAN, MOST_GROUPS = 64, 256


def _fold(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = None
        for b in batches:
            if len(b):
                new = np.array(b["features"].tolist(), float)
                factor = np.linalg.qr(new if factor is None else np.vstack((factor, new)), mode="r")
        if factor is not None:
            yield pd.DataFrame({"features": list(factor)})

    return rows.select("features").mapInPandas(run, "features array<double>")


def triangular_factor(rows: DataFrame) -> np.ndarray:
    """R of the matrix whose rows are ``features``; no rows give an empty matrix."""
    found = _fold(_fold(_fold(rows).repartition(FAN)).repartition(1)).collect()
    return np.array([r.features for r in found], float)


def _finite(array: str) -> F.Column:
    return F.col(array).isNotNull() & F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _numbers(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(array: str, values) -> F.Column:
    return F.aggregate(F.zip_with(array, _numbers(values), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit_least_squares(train: DataFrame, weights: list[float]) -> np.ndarray:
    """Coefficients of the weighted features and, last, the intercept: the solution of least norm."""
    weighted = F.zip_with("features", _numbers(weights), lambda x, w: x * w)
    rows = train.where(_finite("features") & F.col("value").isNotNull() & ~F.isnan("value")).select(F.concat(weighted, F.array(F.lit(1.0), F.col("value"))).alias("features"))
    factor = triangular_factor(rows)
    if not len(factor):
        raise ValueError("no row of the train set has a value and finite features")
    return np.linalg.lstsq(factor[:, :-1], factor[:, -1], rcond=None)[0]


def least_squares(train: DataFrame, test: DataFrame, weights: list[float]) -> DataFrame:
    """``test`` (features) with ``predicted``, from a fit on ``train`` (features, value)."""
    solved = fit_least_squares(train, weights)
    value = _dot("features", solved[:-1] * np.array(weights, float)) + F.lit(float(solved[-1]))
    return test.withColumn("predicted", F.when(_finite("features"), value))


def _factors(rows: DataFrame, by: str) -> dict[int, np.ndarray]:
    """The triangular factor of each group's rows (``by``: int); a task holds one factor per group it has met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for g, part in b.groupby(by):
                new = np.array(part["features"].tolist(), float)
                held[int(g)] = np.linalg.qr(np.vstack((held[int(g)], new)) if int(g) in held else new, mode="r")
        for g, f in held.items():
            yield pd.DataFrame({by: [g] * len(f), "features": list(f)})

    schema = f"{by} int, features array<double>"
    once = rows.select(F.col(by).cast("int").alias(by), "features").mapInPandas(run, schema)
    out: dict[int, list] = {}
    for r in once.repartition(FAN, by).mapInPandas(run, schema).collect():  # a factor per group
        out.setdefault(r[by], []).append(r.features)
    return {g: np.array(f, float) for g, f in out.items()}


def leave_group_out(rows: DataFrame, weights: list[float], by: str, most: int = MOST_GROUPS) -> DataFrame:
    """``rows`` (features, value and the group ``by``, int) with ``predicted``, each row from a fit on all other groups.

    The driver holds a factor per group, so there may be ``most`` groups; of more, take folds of groups. A row without
    a group, or the only group, has no prediction."""
    weighted = F.zip_with("features", _numbers(weights), lambda x, w: x * w)
    known = rows.where(_finite("features") & F.col("value").isNotNull() & ~F.isnan("value") & F.col(by).isNotNull())
    if known.select(by).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups: take folds of them")
    factors = _factors(known.select(F.col(by), F.concat(weighted, F.array(F.lit(1.0), F.col("value"))).alias("features")), by)
    solved = []
    for g in factors:
        others = [f for h, f in factors.items() if h != g]
        if others:
            whole = np.linalg.qr(np.vstack(others), mode="r")
            c = np.linalg.lstsq(whole[:, :-1], whole[:, -1], rcond=None)[0]
            solved.append((g, [float(x) for x in c]))
    table = rows.sparkSession.createDataFrame(solved, f"{by} int, _solved array<double>")  # a row per group
    out = rows.join(F.broadcast(table), by, "left")
    scaled = F.zip_with(weighted, F.slice("_solved", 1, len(weights)), lambda x, c: x * c)
    value = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x) + F.element_at("_solved", -1)
    return out.withColumn("predicted", F.when(_finite("features") & F.col("_solved").isNotNull(), value)).drop("_solved")


def fit_discriminants(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(overall mean, scalings: features x components) of at most classes - 1 linear discriminants.

    Features are scaled by their spread within classes, made white, then turned to the axes that part the class means
    most. Components of no weight are left out; a component's largest entry is positive."""
    known = train.where(_finite("features") & F.col("label").isNotNull())
    found = known.select("label", F.posexplode("features").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).collect()
    labels = sorted({r.label for r in found})
    if len(labels) < 2:
        raise ValueError("discriminants need two classes")
    place = {c: i for i, c in enumerate(labels)}
    means, counts = np.zeros((len(labels), 1 + max(r.at for r in found))), np.zeros(len(labels))
    for r in found:
        means[place[r.label], r.at] = r["mean"]
        counts[place[r.label]] = r.n
    total = counts.sum()
    if total <= len(labels):
        raise ValueError("discriminants need more rows than classes")
    overall = counts @ means / total
    table = train.sparkSession.createDataFrame([(c, means[i].tolist()) for c, i in place.items()], "label string, mean array<double>")
    inner = known.select(F.col("label").cast("string").alias("label"), "features").join(table, "label").select(F.zip_with("features", "mean", lambda x, m: x - m).alias("features"))
    factor = triangular_factor(inner)
    spread = np.sqrt((factor**2).sum(axis=0) / total)
    spread[spread == 0] = 1
    _, s, vt = np.linalg.svd(factor / spread / np.sqrt(total - len(labels)), full_matrices=False)
    rank = int((s > 1e-4).sum())
    white = (vt[:rank] / spread).T / s[:rank]
    between = np.sqrt(counts / (len(labels) - 1))[:, None] * (means - overall) @ white
    _, s, vt = np.linalg.svd(between, full_matrices=False)
    rank = min(int((s > 1e-4 * s[0]).sum()), len(labels) - 1) if len(s) else 0
    scalings = white @ vt[:rank].T
    top = np.abs(scalings).argmax(axis=0)
    return overall, scalings * np.where(scalings[top, np.arange(rank)] < 0, -1, 1)


def discriminants(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``components``: their features on the discriminants of ``train`` (features, label)."""
    mean, scalings = fit_discriminants(train)
    components = [_dot("features", c) - F.lit(float(mean @ c)) for c in scalings.T]
    return rows.withColumn("components", F.when(_finite("features"), F.array(*components)))
