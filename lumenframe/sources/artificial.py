"""Artificial feature spaces: smooth signals over -100 .. 100, noisy copies of each, by column expressions.

Noise is normal, by ``randn`` of a seed and the column, and grows with the copy's number; without a seed there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signals, over x.
SIGNALS = {
    "positiveconstant": "100D",
    "negativeconstant": "-100D",
    "positive_linear": "x",
    "negative_linear": "-x",
    "trough_first_sin": "100 * sin(x * pi() / 40)",
    "peak_first_sin": "-100 * sin(x * pi() / 40)",
    "exponential_quadI": "exp(0.05D * x)",
    "exponential_quadII": "exp(-0.05D * x)",
    "exponential_quadIII": "-exp(-0.05D * x)",
    "exponential_quadIV": "-exp(0.05D * x)",
    "quadraticup": "0.01D * x * x - 50",
    "quadraticdown": "-0.01D * x * x + 50",
    "cubicup": "x * x * x / 4500 - x + 50",
    "cubicdown": "-x * x * x / 4500 + x - 50",
    "arctan_left_pos": "50 * atan(0.1D * x + 10)",
    "arctan_middle_pos": "50 * atan(0.1D * x)",
    "arctan_right_pos": "50 * atan(0.1D * x - 10)",
    "arctan_left_neg": "-50 * atan(0.1D * x + 10)",
    "arctan_middle_neg": "-50 * atan(0.1D * x)",
    "arctan_right_neg": "-50 * atan(0.1D * x - 10)",
}
# Signals that aren't defined, or jump, somewhere.
SINGULAR = {
    "log_quadI": "100 * log10(0.05D * x)",
    "log_quadII": "100 * log10(-0.05D * x)",
    "log_quadIII": "-100 * log10(-0.05D * x)",
    "log_quadIV": "-100 * log10(0.05D * x)",
    "stepup": "100 * signum(x)",
    "stepdown": "-100 * signum(x)",
    "triangleup": "abs(x) - 50",
    "triangledown": "-abs(x) + 50",
    "tangent1": "5 * tan(pi() * x / 50)",
    "tangent2": "-5 * tan(pi() * (x / 50 - 0.5D))",
}
LOW, HIGH = -100.0, 100.0


def signals(singular: bool) -> dict[str, str]:
    return dict(sorted((SIGNALS | SINGULAR if singular else SIGNALS).items()))


def feature_names(per_signal: int, singular: bool = False) -> list[str]:
    return [f"{name}{i:04d}" for name in signals(singular) for i in range(per_signal)]


def _features(per_signal: int, singular: bool, gradient: float, noise: float, seed: int | None, clip: tuple[float, float] | None) -> Column:
    out = []
    for formula in signals(singular).values():
        v = F.expr(f"CAST({formula} AS DOUBLE)")
        if clip:
            v = F.least(F.greatest(v, F.lit(clip[0])), F.lit(clip[1]))
        for i in range(per_signal):
            out.append(v if seed is None else v + F.randn(seed + len(out)) * (noise + i * gradient))
    return F.array(*out)


def _space(rows: DataFrame, per_group: int, per_signal: int, singular: bool, gradient: float, noise: float, seed: int | None, clip: tuple[float, float] | None) -> DataFrame:
    group = F.col("sample_id") if per_group == 1 else F.floor(F.col("sample_id") / per_group)
    seq = F.lit(1) if per_group == 1 else F.pmod("sample_id", F.lit(per_group))
    if per_group > 1:
        tail = F.format_string("_g%03d_t%02d", F.floor(F.col("sample_id") / per_group), F.pmod("sample_id", F.lit(per_group)))
        rows = rows.withColumn("name", F.concat("name", tail))
    return rows.select("sample_id", "name", "label", F.col("x").alias("value"), group.cast("long").alias("grp"), seq.cast("int").alias("seq"), _features(per_signal, singular, gradient, noise, seed, clip).alias("features"))


def continuous(spark: SparkSession, n_samples: int = 100, per_signal: int = 25, gradient: float = 10, noise: float = 10, per_group: int = 1, seed: int | None = None, singular: bool = False, clip: tuple[float, float] | None = None) -> DataFrame:
    """sample_id, name, label (null), value, grp, seq, features: values at even steps, whole groups only."""
    n = n_samples // per_group * per_group
    step = (HIGH - LOW) / max(n - 1, 1)
    pattern = "FakeContinuousSample%03d" if per_group == 1 else "FakeContinuousSample_i%03d"
    rows = spark.range(n).select(F.col("id").alias("sample_id"), F.format_string(pattern, "id").alias("name"), F.lit(None).cast("string").alias("label"), (F.lit(LOW) + F.col("id") * step).alias("x"))
    return _space(rows, per_group, per_signal, singular, gradient, noise, seed, clip)


def discrete(spark: SparkSession, n_classes: int = 2, n_samples: int = 100, per_signal: int = 25, gradient: float = 10, noise: float = 10, per_group: int = 1, seed: int | None = None, singular: bool = False, clip: tuple[float, float] | None = None, numeric: bool = True) -> DataFrame:
    """The same for classes at even steps, equally many samples in each: what doesn't part evenly is left out. Class
    names hold the value, or without ``numeric`` a letter."""
    size = n_samples // n_classes // per_group * per_group
    if size <= 0:
        raise ValueError(f"{n_samples} samples don't fill {n_classes} classes of groups of {per_group}")
    step = (HIGH - LOW) / max(n_classes - 1, 1)
    k = F.floor(F.col("id") / size)
    x = F.lit(LOW) + k * step
    label = F.concat(F.lit("FakeClass"), F.when(x > 0, "+").otherwise("-"), F.format_string("%05.1f", F.abs(x))) if numeric else F.concat(F.lit("FakeClass"), F.char(F.pmod(k, F.lit(26)) + 65))
    rows = spark.range(size * n_classes).select(F.col("id").alias("sample_id"), label.alias("label"), x.alias("x"), F.pmod("id", F.lit(size)).alias("i"))
    rows = rows.withColumn("name", F.concat("label", F.format_string("_%03d" if per_group == 1 else "_i%03d", "i")))
    return _space(rows, per_group, per_signal, singular, gradient, noise, seed, clip)


def rows(space: DataFrame) -> DataFrame:
    """A row per sample and feature, values rounded."""
    long = space.select("sample_id", "name", "label", F.round("value", 6).alias("value"), "grp", "seq", F.posexplode("features").alias("fidx", "v"))
    return long.withColumn("v", F.round("v", 6) + 0.0)
