import numpy as np

from lumenframe.plans.catalog import PLANS
from lumenframe.plans.queries import channels, plan_over
from lumenframe.plans.relations import EPS


def samples(spark, values, labels):
    rows = [(i, lab, float(i), i // 4, i % 4, [float(v) for v in vs]) for i, (vs, lab) in enumerate(zip(values, labels, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, label string, value double, grp long, seq int, features array<double>")


def test_similarity_map_covers_all_samples(spark):
    rng = np.random.default_rng(30)
    labels = np.array(["abc"[i % 3] for i in range(45)])
    x = rng.normal(size=(45, 12)) + (labels == "a")[:, None] * np.arange(12) / 4
    x[44] = x[2]  # a collision has no row
    got = plan_over(samples(spark, x, labels), PLANS["J11_similarity_map"]).collect()
    u = 100 * (x - x.min(0)) / (x.max(0) - x.min(0))
    means = np.array([u[labels == c].mean(0) for c in "abc"])
    w = ((means - u.mean(0)) ** 2).sum(0) / 2 / np.array([u[labels == c].var(0, ddof=1) for c in "abc"]).mean(0)
    best = np.argsort(-w)[:9]
    z = u[:, best] * w[best]
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    met = d > EPS
    lo, hi = d[met].min(), d[met].max()
    assert {(r["t"], r["r"]) for r in got} == set(zip(*np.nonzero(met), strict=True)) and len(got) == 45 * 44 - 2
    assert all(abs(r["similarity"] - (1 - (d[r["t"], r["r"]] - lo) / (hi - lo))) < 2e-5 for r in got)


def test_ranks_channels_and_columns_cover_all_features(spark):
    x = np.random.default_rng(31).integers(0, 9, size=(20, 64)).astype(float)
    s = samples(spark, x, "ab" * 10)
    ranks = {(r["sample_id"], r["fidx"]): r["avg_rank"] for r in plan_over(s, PLANS["W4_average_ranks"]).collect()}
    assert ranks == {(i, k): (x[:, k] < x[i, k]).sum() + ((x[:, k] == x[i, k]).sum() + 1) / 2 for i in range(20) for k in range(64)}
    wide = {(r["grp"], r["wide_idx"]): (r["name"], r["v"]) for r in channels(s).collect()}
    assert wide == {(i // 4, i % 4 * 64 + k): (f"Embedding ({i % 4}) [{k}]", x[i, k]) for i in range(20) for k in range(64)}
    both = {(r["sample_id"], r["fidx"]): r["v"] for r in plan_over(s, PLANS["U3_columns"]).collect()}
    assert both == {(i, k + 64 * j): x[i, k] ** (j + 1) for i in range(20) for k in range(64) for j in range(2)}
