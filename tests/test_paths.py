"""Penalised paths: optimality conditions from the data, scaling per fold, the identification rule."""

import numpy as np
import pytest

from asofkit.ml import paths
from asofkit.operators.contracts import ContractError


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 4)) * [1, 10, 0.1, 0] + [0, 5, 1, 3]
    p = 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.05 * (x[:, 1] - 5) - 0.5)))
    return x, (r.random(600) < p).astype(float), r.integers(0, 5, 600)


@pytest.fixture(scope="module")
def path(spark, rows):
    x, y, fold = rows
    df = spark.createDataFrame([(int(f), float(t), *map(float, v)) for v, t, f in zip(x, y, fold, strict=True)], "fold int, y double, a double, b double, c double, d double")
    return paths.penalised_path(df.repartition(3), ["a", "b", "c", "d"], folds=5, n_lambdas=20, l1_ratios=(0.5, 1.0)), df


def test_every_model_meets_the_optimality_conditions(path, rows):
    fit, _ = path
    x, y, fold = rows
    assert fit.converged.all() and fit.passes < 40
    for f in range(6):
        xs, ys = x[fold != f], y[fold != f]
        mean, sd = xs.mean(0), xs.std(0)
        assert np.allclose(fit.mean[f], mean) and np.allclose(fit.sd[f][:3], sd[:3])
        z = np.where(sd > 1e-9, (xs - mean) / np.where(sd > 1e-9, sd, 1), 0)
        for i, a in enumerate(fit.l1_ratios):
            for j, lam in enumerate(fit.lambdas[i]):
                b = fit.beta[f, i, j]
                mu = 1 / (1 + np.exp(-(fit.intercept[f, i, j] + z @ b)))
                g = z.T @ (mu - ys) / len(ys) + lam * (1 - a) * b
                assert abs((mu - ys).mean()) < 1e-6
                assert np.all(np.abs(g[b != 0] + lam * a * np.sign(b[b != 0])) < 1e-6) and np.all(np.abs(g[b == 0]) <= lam * a + 1e-6)


def test_held_out_deviance_and_top_penalty(path, rows):
    fit, _ = path
    x, y, fold = rows
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    assert np.isclose(fit.lambdas[1, 0], np.abs(z.T @ (y - y.mean())).max() / len(y))
    for f in range(5):
        zs = np.where(fit.sd[f] > 1e-9, (x[fold == f] - fit.mean[f]) / fit.sd[f], 0)
        mu = 1 / (1 + np.exp(-(fit.intercept[f, 1, 7] + zs @ fit.beta[f, 1, 7])))
        ys = y[fold == f]
        assert np.isclose(fit.deviance[f, 1, 7], -2 * np.mean(ys * np.log(mu) + (1 - ys) * np.log(1 - mu)))


def test_scale_of_training_folds(path, rows):
    fit, df = path
    got = {(r.fold, r.feature): (r.mean, r.sd) for r in paths.training_scale(paths.moments(df, fit.features), fit.features).collect()}
    for (f, name), (mean, sd) in got.items():
        v = rows[0][rows[2] != f, fit.features.index(name)]
        assert np.isclose(mean, v.mean()) and np.isclose(sd, v.std(), atol=1e-6)


def test_identified_minimum(path):
    fit, _ = path
    i, j, identified = fit.chosen()
    mean = fit.deviance.mean(0)
    assert mean[i, j] == mean.min() and identified == (((mean[i, j + 1 :] - mean[i, j]) / mean[i, j] >= 1e-3).sum() >= 5)


def test_one_outcome_is_refused(spark):
    with pytest.raises(ContractError):
        paths.penalised_path(spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 3.0)], "fold int, y double, a double"), ["a"], folds=2)


def test_unpenalised_subsets_together(spark, rows, path):
    _, df = path
    x, y, _ = rows
    fits = paths.logistic_fits(df, ["a", "b", "c"], [["a"], ["a", "b"], ["a", "b", "c"], []])
    for (intercept, coefs, deviance), cols in zip(fits, ([0], [0, 1], [0, 1, 2], []), strict=True):
        eta = intercept + sum(coefs["abc"[c]] * x[:, c] for c in cols)
        mu = 1 / (1 + np.exp(-eta))
        design = np.column_stack([np.ones(len(y)), *[x[:, c] for c in cols]])
        assert np.abs(design.T @ (y - mu)).max() < 1e-4
        assert np.isclose(deviance, -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu)))
