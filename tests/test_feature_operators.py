"""Operators around feature spaces against plain Python, and golden files where a folder of them is named."""

from __future__ import annotations

import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.operators import classify, evaluate, regress, sampling
from lumenframe.operators.positions import average_ranks, with_positions
from lumenframe.plans.relations import long_form, run_plan
from lumenframe.plans.scratch import clean, cut, discard, numbered
from lumenframe.sources import artificial, files

SAMPLES = "sample_id long, label string, value double, grp long, seq int, features array<double>"


def test_positions_and_average_ranks(spark):
    rng = random.Random(50)
    rows = [(i, rng.randint(0, 8)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"]: r["position"] for r in with_positions(df, "v", "id").collect()}
    assert got == {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in rows), 1)}
    ranks = {r["id"]: r["avg_rank"] for r in average_ranks(df, "v").collect()}
    assert ranks == {i: sum(w < v for _, w in rows) + (sum(w == v for _, w in rows) + 1) / 2 for i, v in rows}
    assert with_positions(df.limit(0), "v").count() == 0


def test_pearson_weights_and_regression_error(spark):
    rng = np.random.default_rng(51)
    value = rng.integers(0, 6, 60).astype(float)
    x = np.stack([2 * value + 1 + rng.normal(size=60), rng.normal(size=60), -value**3], axis=1)
    df = spark.createDataFrame([(i, "a", float(value[i]), i, 0, [float(v) for v in x[i]]) for i in range(60)], SAMPLES)
    got = {r["fidx"]: r for r in evaluate.pearson_weights(long_form(df)).collect()}
    r = [np.corrcoef(value, x[:, k])[0, 1] for k in range(3)]
    for k in range(3):
        slope, cut_at = np.polyfit(value, x[:, k], 1)
        assert got[k]["slope"] == pytest.approx(slope) and got[k]["intercept"] == pytest.approx(cut_at) and got[k]["pearson_r"] == pytest.approx(r[k])
        assert got[k]["w"] == pytest.approx(r[k] ** 2 / sum(v * v for v in r))
        left = x[:, k] - slope * value - cut_at
        assert got[k]["pearson_se"] == pytest.approx(np.sqrt((left**2).sum() / 58 / ((value - value.mean()) ** 2).sum()))
        assert got[k]["pearson_p"] == pytest.approx(special.correlation_p(r[k], 60))
    assert got[2]["spearman_r"] == pytest.approx(-1)
    e = evaluate.regression_error(spark.createDataFrame([(float(a), float(b)) for a, b in zip(value, x[:, 0], strict=True)], "tv double, pv double")).first()
    assert e["rmse"] == pytest.approx(np.sqrt(((value - x[:, 0]) ** 2).mean())) and e["avg_abs_dif"] == pytest.approx(np.abs(value - x[:, 0]).mean()) and e["pearson_r"] == pytest.approx(r[0])


def test_grids():
    assert evaluate.log_grid(64)[:4] == [1, 2, 3, 4] and evaluate.log_grid(64)[-1] == 64
    assert evaluate.sample_grid(40)[0] > 2 and evaluate.sample_grid(40)[-1] == 39


def test_leaving_groups_out_of_least_squares(spark):
    rng = np.random.default_rng(52)
    x, g = rng.normal(size=(80, 3)), np.arange(80) % 5
    y = x @ [1.0, -2.0, 0.5] + 3 + g
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i]), int(g[i])) for i in range(80)] + [(99, [1.0, None, 2.0], 1.0, 2), (98, [1.0, 1.0, 1.0], 1.0, None)], "sample_id long, features array<double>, value double, fold int").repartition(4)
    got = {r["sample_id"]: r["predicted"] for r in regress.leave_group_out(df, [1.0, 2.0, 0.5], "fold").collect()}
    for i in range(80):
        rest = g != g[i]
        c = np.linalg.lstsq(np.c_[x[rest], np.ones(rest.sum())], y[rest], rcond=None)[0]
        assert got[i] == pytest.approx(x[i] @ c[:3] + c[3])
    assert got[99] is None and got[98] is None
    with pytest.raises(ValueError):
        regress.leave_group_out(df, [1.0] * 3, "fold", most=4)


def test_artificial_spaces(spark):
    c = artificial.continuous(spark, n_samples=11, per_signal=2, per_group=2).orderBy("sample_id").collect()
    assert len(c) == 10 and c[0]["value"] == -100 and c[9]["value"] == 100 and c[3]["name"] == "FakeContinuousSample_i003_g001_t01" and (c[3]["grp"], c[3]["seq"]) == (1, 1)
    names = artificial.feature_names(2)
    at = names.index("quadraticup0001")
    assert len(names) == 40 and c[0]["features"][at] == pytest.approx(50) and names[:2] == ["arctan_left_neg0000", "arctan_left_neg0001"]
    d = artificial.discrete(spark, n_classes=3, n_samples=20, per_signal=1, clip=(-60.0, 60.0)).orderBy("sample_id").collect()
    assert len(d) == 18 and sorted({r["label"] for r in d}) == ["FakeClass+100.0", "FakeClass-000.0", "FakeClass-100.0"] and max(map(max, (r["features"] for r in d))) == 60
    assert artificial.discrete(spark, n_classes=2, n_samples=4, per_signal=1, numeric=False).first()["label"] == "FakeClassA"
    noisy = [artificial.continuous(spark, n_samples=400, per_signal=2, seed=s).selectExpr(f"stddev(features[{names.index('positiveconstant0001')}]) AS s").first()["s"] for s in (1, 1, 2)]
    assert noisy[0] == noisy[1] != noisy[2] and 15 < noisy[0] < 25
    assert len(artificial.feature_names(1, singular=True)) == 30
    with pytest.raises(ValueError):
        artificial.discrete(spark, n_classes=5, n_samples=4)


def test_sampling_stacking_and_legacy_names(spark):
    images = spark.createDataFrame([(1,), (2,)], "sample_id long")
    rows = sampling.sampling_product(images, rotations=2, tile_cols=3, tile_rows=2, long=True)
    names = {r["name"] for r in rows.collect()}
    assert rows.count() == 24 and "-R_1-t3x2_2_1-l" in names and "-t3x2_0_0-l" in names
    store = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0]), (2, 1, [1.0, 1.0])], "sample_id long, rot int, features array<double>")
    missing = sampling.missing_samples(sampling.sampling_product(images, rotations=2), store, "sample_id", "rot", width=2)
    assert sorted((r["sample_id"], r["rot"]) for r in missing.collect()) == [(1, 1), (2, 0)]
    wide = sampling.stack_channels(spark.createDataFrame([(1, 1, [3.0]), (1, 0, [1.0, 2.0]), (2, 0, [])], "grp long, seq int, features array<double>"))
    assert {r["grp"]: (r["columns"], r["features"]) for r in wide.collect()} == {1: (2, [1.0, 2.0, 3.0]), 2: (1, [])}
    old = spark.createDataFrame([("a", "b")], "old string, new string")
    assert {r["i"]: r["name"] for r in sampling.legacy_names(spark.createDataFrame([(1, "a"), (2, "c")], "i long, name string"), old).collect()} == {1: "b", 2: "c"}


def test_scratch_tables_go(spark):
    a = cut(spark.range(5).toDF("x"), "a")
    b = numbered(a, "n")
    path = Path(a._lumenframe_path.removeprefix("file://"))
    assert path.exists() and b.count() == 5
    discard(a, spark.range(1))
    assert not path.exists() and b.count() == 5
    clean(spark)
    assert not Path(b._lumenframe_path.removeprefix("file://")).exists()


GOLDEN = os.environ.get("LUMENFRAME_GOLDEN")


@pytest.mark.skipif(not GOLDEN, reason="LUMENFRAME_GOLDEN names no folder of golden files")
def test_golden_weights_and_probabilities(spark):
    """A scaled space, its weights, and the rows that are expected of it (name, norm factor, two probabilities, actual,
    predicted, value): all at the precision they were printed in."""
    folder = Path(GOLDEN)
    fit = next(p for p in folder.glob("*.fit") if p.with_name(p.name.replace("-normalized.fit", ".weights")).exists())
    named = {r["name"]: r["weight"] for r in files.read_weights(spark, f"file://{fit.with_name(fit.name.replace('-normalized.fit', '.weights'))}").collect()}
    texts = files.whole_texts(spark, f"file://{fit}")
    names = files.fit_heads(texts).first()["names"]
    rows = files.fit_rows(texts).select(F.col("sample_ord").cast("long").alias("sample_id"), "source", "label", "value", F.col("sample_ord").cast("long").alias("grp"), F.lit(0).alias("seq"), "features")
    floor = "SELECT fidx, mn, mx, sum(pow(m - mu, 2)) / (count(*) - 1) / greatest(avg(s), 1e-6) AS w FROM cs JOIN mu USING (fidx) JOIN mm USING (fidx) GROUP BY fidx, mn, mx"
    w = run_plan(floor, long=long_form(rows)).toPandas().sort_values("fidx")
    assert len(w) == len(names) == len(named) and max(abs(v - named[names[k]]) for k, v in zip(w.fidx, w.w, strict=True)) < 5e-6
    least = w.w.sort_values(ascending=False).iloc[int(np.floor(0.15 * len(w) + 0.5))]
    by = classify.models(w[w.w >= least].assign(split=0))
    got = classify.similarities(classify.one_split(rows), classify.one_split(rows), by).toPandas()
    value = {r["label"]: float(re.search(r"\d+", r["label"])[0]) for r in rows.select("label").distinct().collect()}
    source = {r["sample_id"]: Path(r["source"]).name for r in rows.select("sample_id", "source").collect()}
    text = "\n".join(p.read_text(errors="replace") for p in sorted(folder.iterdir()) if p.suffix == ".pl")
    expected: dict[str, tuple] = {}
    for m in re.finditer(r"^(\S+)\t(\S+)\t([\d.]+)\t([\d.]+)\t(\w+)\t(\w+)\t([\d.]+)$", text, re.M):
        expected.setdefault(Path(m[1]).name, m.groups()[1:])
    seen = 0
    for t, part in got.groupby("t"):
        s = dict(zip(part.rl, part.s, strict=True))
        total = sum(s.values())
        norm, a, b, _, predicted, between = expected[source[t]]
        labels = sorted(s)
        assert (f"{total:.3g}", f"{s[labels[0]] / total:.3f}", f"{s[labels[1]] / total:.3f}", max(s, key=s.get), f"{sum(s[x] / total * value[x] for x in s):.3f}") == (f"{float(norm):.3g}", a, b, predicted, between)
        seen += 1
    assert seen == 20
