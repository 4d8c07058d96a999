import numpy as np
import pytest

from lumenframe.operators import regress


def frame(spark, x, y=None, labels=None):
    rows = [([float(v) for v in r], None if y is None else float(y[i]), None if labels is None else labels[i], i) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "features array<double>, value double, label string, i long").repartition(5)


@pytest.mark.parametrize("deficient", [False, True])
def test_least_squares_is_the_solution_of_least_norm(spark, deficient):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    if deficient:
        x[:, 3] = x[:, 0]
    y, w = x @ [1, -2, 0.5, 3] + 4 + rng.normal(size=60), np.array([0.5, 1, 2, 0.25])
    want = np.linalg.lstsq(np.hstack((x * w, np.ones((60, 1)))), y, rcond=None)[0]
    df = frame(spark, x, y)
    assert np.allclose(regress.fit_least_squares(df, list(w)), want)
    got = regress.least_squares(df, df, list(w)).orderBy("i").toPandas()
    assert np.allclose(got.predicted, np.hstack((x * w, np.ones((60, 1)))) @ want)


def test_rows_that_are_not_real_take_no_part(spark):
    df = frame(spark, [[1], [2], [3], [np.nan], [np.inf]], [3, 5, 7, 100, 100])
    got = regress.least_squares(df, df, [1.0]).orderBy("i").collect()
    assert [r.predicted and round(r.predicted, 6) for r in got] == [3, 5, 7, None, None]
    with pytest.raises(ValueError):
        regress.fit_least_squares(df.where("i > 2"), [1.0])


def test_discriminants_whiten_classes_and_part_their_means(spark):
    rng = np.random.default_rng(2)
    labels = np.repeat(["a", "b", "c"], [40, 30, 50])
    centre = {"a": [0, 0, 0], "b": [3, 0, 1], "c": [0, 4, 1]}
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 3)) + np.array([centre[c] for c in labels])
    x = np.hstack((x, np.ones((120, 1))))  # a constant feature says nothing
    df = frame(spark, x, labels=labels.tolist())
    z = np.array(regress.discriminants(df, df).orderBy("i").toPandas().components.tolist())
    assert z.shape == (120, 2) and np.allclose(z.mean(axis=0), 0)
    inner = np.vstack([z[labels == c] - z[labels == c].mean(axis=0) for c in "abc"])
    assert np.allclose(inner.T @ inner / 117, np.eye(2))
    means = np.vstack([np.sqrt((labels == c).sum()) * z[labels == c].mean(axis=0) for c in "abc"])
    between = means.T @ means
    assert abs(between[0, 1]) < 1e-6 * between[0, 0] and between[0, 0] > between[1, 1]


def test_discriminants_need_two_classes(spark):
    with pytest.raises(ValueError):
        regress.fit_discriminants(frame(spark, [[1], [2]], labels=["a", "a"]))
