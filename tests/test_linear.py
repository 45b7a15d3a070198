"""Fitted linear models against dense numpy: at the optimum every derivative of the whole objective is zero."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from veilspark.operators import linear as L

FOLDS, CLASSES, WIDTH = 5, 3, 9000


def table(spark, changed=None):
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        label, fold = int(r.choice([0, 1, 1, 2, 2, 2])), int(r.integers(FOLDS))
        at = np.sort(r.choice(np.r_[0:20, 4090:4100, 8990:9000], 6, replace=False))
        values = r.random(6) + (at % 3 == label)
        rows.append((i, label, fold, at, values / np.linalg.norm(values)))
    if changed is not None:
        i, label, fold, at, values = rows[changed]
        rows[changed] = (i, (label + 1) % CLASSES, fold, at, values[::-1] * 3)
    df = spark.createDataFrame([(y, f, Vectors.sparse(WIDTH, at.tolist(), v.tolist())) for _, y, f, at, v in rows], ["y", "fold", "features"])
    x = np.zeros((len(rows), WIDTH + 1))
    for i, _, _, at, v in rows:
        x[i, at] = v
    x[:, -1] = 1
    return df.repartition(4), x, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


@pytest.fixture(scope="module")
def fitted(spark):
    df, x, y, fold = table(spark)
    rows = L.SparseRows(df, WIDTH)
    weights, _ = L.fit_margins(rows, FOLDS, CLASSES, tolerance=1e-8)
    curves = L.fit_sigmoids(rows, weights, FOLDS, CLASSES)
    yield rows, weights, curves, x, y, fold
    rows.close()


def balanced(y):
    counts = np.bincount(y, minlength=CLASSES)
    return len(y) / (CLASSES * counts)


def test_softmax_reaches_the_optimum(fitted):
    rows, _, _, x, y, _ = fitted
    coefficients, intercepts, steps = L.fit_softmax(rows, CLASSES, tolerance=1e-8)
    assert coefficients.shape == (CLASSES, WIDTH) and steps < 1000
    z = x[:, :-1] @ coefficients.T + intercepts
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= balanced(y)[y][:, None]
    slope = x.T @ p
    assert np.abs(slope[:-1] + coefficients.T).max() < 1e-5 and np.abs(slope[-1]).max() < 1e-5
    assert not coefficients[:, np.setdiff1d(np.arange(WIDTH), rows.columns)].any()


def test_each_classifier_is_fitted_on_all_folds_but_its_own(fitted):
    rows, weights, _, x, y, fold = fitted
    touched = np.append(rows.columns, WIDTH)
    for f in range(FOLDS):
        seen = fold != f
        for c in range(CLASSES):
            w = weights[:, f * CLASSES + c]
            sign = np.where(y[seen] == c, 1.0, -1.0)
            by = np.where(sign > 0, balanced(y[seen])[c], 1.0)
            short = np.maximum(1 - sign * (x[seen][:, touched] @ w), 0)
            slope = w - 2 * x[seen][:, touched].T @ (by * sign * short)
            assert np.abs(slope).max() < 1e-5
    assert sum((fold != f).sum() for f in range(FOLDS)) == (FOLDS - 1) * len(fold)


def test_curves_are_fitted_on_rows_that_their_classifier_has_not_seen(fitted, spark):
    rows, weights, curves, x, y, fold = fitted
    touched = np.append(rows.columns, WIDTH)
    for f in range(FOLDS):
        held = fold == f
        for c in range(CLASSES):
            a, b = curves[f * CLASSES + c]
            m = x[held][:, touched] @ weights[:, f * CLASSES + c]
            own = y[held] == c
            t = np.where(own, (own.sum() + 1) / (own.sum() + 2), 1 / ((~own).sum() + 2))
            p = 1 / (1 + np.exp(-(a * m + b)))
            assert abs(((p - t) * m).sum()) < 1e-4 and abs((p - t).sum()) < 1e-4
    changed = 17
    other = L.SparseRows(table(spark, changed)[0], WIDTH)
    new, _ = L.fit_margins(other, FOLDS, CLASSES, tolerance=1e-8)
    other.close()
    own = fold[changed]
    for f in range(FOLDS):
        same = np.allclose(new[:, f * CLASSES : (f + 1) * CLASSES], weights[:, f * CLASSES : (f + 1) * CLASSES], atol=1e-5)
        assert same == (f == own)


def test_margins_are_scored_as_fitted(fitted, spark):
    rows, weights, _, x, y, fold = fitted
    df, *_ = table(spark)
    model = L.margin_model(spark.sparkContext, *rows.spread(weights))
    got = np.array([r.rawPrediction.toArray() for r in model.transform(df).select("rawPrediction").collect()])
    want = x[:, np.append(rows.columns, WIDTH)] @ weights
    assert np.allclose(np.sort(got.sum(axis=1)), np.sort(want.sum(axis=1)), atol=1e-9)
