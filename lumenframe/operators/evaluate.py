"""How good predictions and features are: correlations with their errors and chances, binomial tails, grids."""

from __future__ import annotations

from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import special
from lumenframe.operators.positions import average_ranks
from lumenframe.plans.scratch import cut


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation."""
    return pd.Series([special.correlation_p(x, int(k)) if x is not None and x == x else None for x, k in zip(r, n, strict=True)], dtype="object").astype("float64")


@F.pandas_udf(T.DoubleType())
def correlation_density(r: pd.Series, n: pd.Series) -> pd.Series:
    """Density of Student's t at a correlation: what older reports call its p."""
    return pd.Series([special.correlation_density(x, int(k)) if x is not None and x == x else None for x, k in zip(r, n, strict=True)], dtype="object").astype("float64")


@F.pandas_udf(T.DoubleType())
def log_binomial_tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """Natural logarithm of the chance of k or more of n."""
    return pd.Series([special.log_binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(n, k, p, strict=True)], dtype="float64")


def slope_error(r: Column, n: Column, sd_y: Column, sd_x: Column) -> Column:
    """Standard error of the slope of y on x."""
    return F.when(n > 2, F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * sd_y * sd_y / (sd_x * sd_x) / (n - 2)))


def pearson_weights(long: DataFrame) -> DataFrame:
    """fidx, slope, intercept, pearson_r, pearson_se, pearson_p, spearman_r, spearman_p, w (the share of r squared) of
    features (fidx, v) against their samples' value."""
    by_value = average_ranks(long.select("sample_id", "value").distinct(), "value", "rank_value").select("sample_id", "rank_value")
    tied = W.partitionBy("fidx", "v")
    ranked = long.withColumn("rank_v", F.rank().over(W.partitionBy("fidx").orderBy("v")) + (F.count("*").over(tied) - 1) / 2)
    stats = ranked.join(by_value, "sample_id").groupBy("fidx").agg(
        F.regr_slope("v", "value").alias("slope"),
        F.regr_intercept("v", "value").alias("intercept"),
        F.corr("v", "value").alias("pearson_r"),
        F.corr("rank_v", "rank_value").alias("spearman_r"),
        F.stddev_pop("v").alias("sd_v"),
        F.stddev_pop("value").alias("sd_value"),
        F.count("*").alias("n"),
    )
    stats = cut(stats, "pearson")  # a row per feature
    total = stats.agg(F.sum(F.col("pearson_r") * F.col("pearson_r")).alias("total"))
    out = stats.crossJoin(total)  # one number
    return out.select("fidx", "slope", "intercept", "pearson_r", slope_error(F.col("pearson_r"), F.col("n"), F.col("sd_v"), F.col("sd_value")).alias("pearson_se"), correlation_p("pearson_r", "n").alias("pearson_p"), "spearman_r", correlation_p("spearman_r", "n").alias("spearman_p"), (F.col("pearson_r") * F.col("pearson_r") / F.col("total")).alias("w"))


def regression_error(pred: DataFrame, truth: str = "tv", predicted: str = "pv") -> DataFrame:
    """One row: n, rmse, avg_abs_dif, pearson_r, pearson_p, pearson_se, t_density, spearman_r, spearman_p."""
    rows = cut(pred.select(F.col(truth).alias("tv"), F.col(predicted).alias("pv")), "predictions")
    ranked = average_ranks(average_ranks(rows, "tv", "rt"), "pv", "rp")
    s = ranked.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("tv") - F.col("pv"), 2))).alias("rmse"), F.avg(F.abs(F.col("tv") - F.col("pv"))).alias("avg_abs_dif"), F.corr("tv", "pv").alias("pearson_r"), F.corr("rt", "rp").alias("spearman_r"), F.stddev_pop("pv").alias("sp"), F.stddev_pop("tv").alias("st"))
    s = cut(s, "regression")
    return s.select("n", "rmse", "avg_abs_dif", "pearson_r", correlation_p("pearson_r", "n").alias("pearson_p"), slope_error(F.col("pearson_r"), F.col("n"), F.col("sp"), F.col("st")).alias("pearson_se"), correlation_density("pearson_r", "n").alias("t_density"), "spearman_r", correlation_p("spearman_r", "n").alias("spearman_p"))


def log_grid(most: int, intervals: int = 20) -> list[int]:
    """Whole numbers at even steps of the logarithm up to ``most``, each once."""
    step = log10(most) / intervals
    return sorted({int(round(10 ** (step * i))) for i in range(1, intervals + 1)})


def sample_grid(smallest_class: int, intervals: int = 20) -> list[int]:
    """Train sizes per class: a log grid without 1 and 2, and one less than the whole class."""
    grid = [n - 1 if n == smallest_class else n for n in log_grid(smallest_class, intervals)]
    return sorted({n for n in grid if n > 2})


def class_names(labels: DataFrame) -> list[str]:
    return [r[0] for r in labels.select("label").where("label is not null").distinct().orderBy("label").collect()]
