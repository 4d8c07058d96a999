"""The pair kernel against brute force in one block and in many, and how much it hands on."""

import numpy as np
import pytest

from lumenframe.operators import classify
from lumenframe.operators.classify import EPS, AllPairs, ClassSums, Extremes, Known, Model, nearest_rows, tiles
from lumenframe.plans import queries

RNG = np.random.default_rng(70)
Z = RNG.normal(size=(300, 9)) * 10 + 1000
X = np.concatenate((Z[:20], RNG.normal(size=(30, 9)) * 10 + 1000))
X[25] = Z[3] + 1e-7  # near, no collision
OF = Known(np.arange(300), ["a", "b", "c"], np.array([0, 10, 200, 300]))


def brute(x, z):
    d = np.zeros((len(x), len(z)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - z[None, :, f]) ** 2
    return d


@pytest.fixture(params=[(1 << 16, 1024), (900, 64), (7, 7)])
def cut(request, monkeypatch):
    monkeypatch.setattr(classify, "TILE", request.param[0])
    monkeypatch.setattr(classify, "TILE_COLUMNS", request.param[1])


def through(kind, x=X, z=Z, steps=(9,)):
    made = [kind(np.arange(len(x))) for _ in steps]
    parts = list(tiles(made, list(steps), x, z, OF)) + [(w, c) for w, r in enumerate(made) for c in r.done()]
    return [[np.concatenate([np.asarray(c[k], object) for w, c in parts if w == which]) for k in range(len(parts[0][1]))] for which in range(len(steps))]


def test_class_sums_for_several_numbers_of_columns(cut):
    for (t, rl, n, s), step in zip(through(ClassSums, steps=(2, 5, 9)), (2, 5, 9), strict=True):
        d = brute(X[:, :step], Z[:, :step])
        apart = d > EPS
        want = np.where(apart, np.where(apart, d, 1.0) ** -5, 0.0)
        for k, name in enumerate("abc"):
            mine, part = rl == name, slice(OF.first[k], OF.first[k + 1])
            assert t[mine].tolist() == list(range(50)) and n[mine].tolist() == apart[:, part].sum(axis=1).tolist()
            np.testing.assert_allclose(s[mine].astype(float), want[:, part].sum(axis=1), rtol=1e-9)


def test_extremes_nearest_and_pairs(cut):
    d = brute(X, Z)
    apart = d > EPS
    ((t, pairs, lo, hi),) = through(Extremes)
    assert pairs.tolist() == apart.sum(axis=1).tolist()
    np.testing.assert_allclose(lo.astype(float), np.where(apart, d, np.inf).min(axis=1), rtol=1e-9)
    np.testing.assert_allclose(hi.astype(float), d.max(axis=1), rtol=1e-9)
    ((t, r, near),) = through(nearest_rows(4))
    far = np.where(apart, d, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :4]
    assert r.reshape(-1, 4).tolist() == order.tolist() and (near.reshape(-1, 4) == np.take_along_axis(far, order, axis=1)).all()
    ((t, r, each),) = through(AllPairs)
    assert {(a, b) for a, b in zip(t, r, strict=True)} == set(zip(*np.nonzero(apart), strict=True)) and len(t) == apart.sum()
    np.testing.assert_allclose(each.astype(float), d[t.astype(int), r.astype(int)], rtol=1e-9)


def test_equal_rows_leave_ties_to_the_smaller_id(cut):
    z = np.repeat(Z[:60], 5, axis=0)
    ((t, r, near),) = through(nearest_rows(3, 0.0, True), Z[:8], z)
    far = brute(Z[:8], z)
    far[(far <= 0) | (np.arange(8)[:, None] == np.arange(300)[None])] = np.inf
    assert r.reshape(-1, 3).tolist() == np.argsort(far, axis=1, kind="stable")[:, :3].tolist()


def test_all_pairs_are_handed_on_tile_by_tile(cut):
    """what a task makes of two blocks doesn't grow with them."""
    most = max(len(cols[0]) for _, cols in tiles([AllPairs(np.arange(50))], [9], X, Z, OF))
    assert most <= max(classify.TILE, min(classify.TILE_COLUMNS, 300))


def frame(spark, n=90):
    x = RNG.normal(size=(n, 12))
    rows = [(i, "abc"[i % 3], float(i), i // 4, i % 4, x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, label string, value double, grp long, seq int, features array<double>")


def test_a_test_row_is_reduced_once_however_many_blocks_it_meets(spark, monkeypatch):
    """F6 and on: rows by test row and class, not by block too; packed rows travel a few to a row."""
    monkeypatch.setattr(classify, "CHUNK_ROWS", 20)
    monkeypatch.setattr(classify, "BLOCK_ROWS", 8)
    s = classify.one_split(frame(spark))
    by = {0: Model(np.arange(12), np.full(12, -5.0), np.full(12, 5.0), np.ones(12))}
    got = classify.meet(s, s, by, ClassSums).toPandas()
    assert len(got) == 90 * 3 and got.groupby("rl").n.sum().tolist() == [90 * 30 - 30] * 3
    blocks = classify.packed(classify.selected(s, by), by).collect()
    assert all(len(b["ids"]) <= 8 * 8 for b in blocks) and sum(len(b["ids"]) for b in blocks) == 90 * 8


def test_grid_search_sends_each_row_once(spark, monkeypatch):
    """not once for each number of columns."""
    s, met = frame(spark, 120), []
    real = classify.meet
    monkeypatch.setattr(classify, "meet", lambda test, train, *a, **b: met.append((test.count(), train.count())) or real(test, train, *a, **b))
    assert len(queries.grid_search(s).collect()) > 5
    assert met == [(queries.shuffled(s, "test").count(), queries.shuffled(s, "train").count())]
