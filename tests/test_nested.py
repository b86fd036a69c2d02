"""Nested cross-validation, refit ablation and power forms against plain restatements on small tables."""

import itertools

import numpy as np
import pytest

from asofkit.ml import models, paths, validate
from asofkit.operators.contracts import ContractError

FEATURES = ["a", "b", "c"]


def logistic(x, y):
    """Unpenalised fit by Newton steps on standardised columns: its deviance."""
    z = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0)])
    b = np.zeros(z.shape[1])
    deviance = lambda b: 2 * (np.logaddexp(0, z @ b) - y * (z @ b)).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
        while deviance(b + step) > deviance(b) + 1e-9:
            step /= 2
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return deviance(b)


def penalised(x, y, lam, a):
    """Elastic net by proximal gradient on standardised columns: intercept and coefficients of the columns as given."""
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(y)), (x - mean) / sd])
    b, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    rate = 1 / (np.linalg.eigvalsh(z.T @ z / len(y)).max() / 4 + lam)
    for _ in range(20_000):
        g = z.T @ (1 / (1 + np.exp(-z @ v)) - y) / len(y)
        g[1:] += lam * (1 - a) * v[1:]
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * lam * a, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / s * (new - b)
        done, b, t = np.abs(new - b).max() < 1e-12, new, s
        if done:
            break
    return np.r_[b[0] - (b[1:] * mean / sd).sum(), b[1:] / sd]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 3)) * [1, 5, 0.2] + [0, 2, 1]
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.1 * (x[:, 1] - 2))))
    entity = r.integers(0, 90, 500)
    return x, (r.random(500) < p).astype(float), entity % 4, entity


@pytest.fixture(scope="module")
def table(spark, rows):
    data = [(i, int(e), int(f), float(t), *map(float, v)) for i, (v, t, f, e) in enumerate(zip(*rows, strict=True))]
    return spark.createDataFrame(data, "key long, entity long, fold int, y double, a double, b double, c double").repartition(3)


def test_nested_models_equal_separate_fits(table, rows):
    x, y, fold, _ = rows
    nested = paths.nested_path(table, FEATURES, folds=4, n_lambdas=6, ratio=0.01, l1_ratios=(0.5, 1.0))
    for k in range(4):
        out = fold != k
        xs, ys = x[out], y[out]
        top = np.abs(((xs - xs.mean(0)) / xs.std(0)).T @ (ys - ys.mean())).max() / out.sum()
        best = None
        for a in (0.5, 1.0):
            for lam in paths.penalty_grid(top / a, 6, 0.01):
                errors = []
                for j in {0, 1, 2, 3} - {k}:  # the inner model sees neither fold
                    c = penalised(x[out & (fold != j)], y[out & (fold != j)], lam, a)
                    eta = c[0] + x[fold == j] @ c[1:]
                    errors.append(2 * (np.logaddexp(0, eta) - y[fold == j] * eta).mean())
                if best is None or np.mean(errors) < best[0] - 1e-9:
                    best = (np.mean(errors), a, lam)
        assert (nested.l1_ratio[0, k], nested.lam[0, k]) == (best[1], pytest.approx(best[2]))
        assert np.allclose(nested.coefficients[0, k], penalised(xs, ys, best[2], best[1]), atol=1e-5)
    got = {r["key"]: r["p_all"] for r in nested.out_of_fold(table).collect()}
    eta = nested.coefficients[0, fold, 0] + (nested.coefficients[0, fold, 1:] * x).sum(1)
    assert len(got) == 500 and np.allclose([got[i] for i in range(500)], 1 / (1 + np.exp(-eta)))


def test_assembly_and_optimality(table):
    nested = paths.nested_path(table, FEATURES, folds=4, n_lambdas=6)
    checks = validate.assembled(nested.out_of_fold(table), "p_all", "key", "entity").collect()
    assert len(checks) == 4
    for r in checks:
        assert r["n"] == r["predicted"] == r["keys"] == 500 - r["trained_on"] and r["entities_seen"] == 0
    assert all(r["residual"] < 1e-6 for r in validate.nested_residuals(table, nested).collect())


def test_an_entity_in_two_folds_is_reported(spark):
    t = spark.createDataFrame([(1, 7, 0, 0.5), (2, 7, 1, 0.5), (3, 8, 1, None)], "key long, entity long, fold int, p double")
    got = {r["fold"]: r for r in validate.assembled(t, "p", "key", "entity").collect()}
    assert (got[0]["entities_seen"], got[1]["entities_seen"], got[1]["n"], got[1]["predicted"]) == (1, 1, 2, 1)


def test_sets_share_passes_and_leave_their_features_out(table):
    both = paths.nested_path(table, FEATURES, folds=4, n_lambdas=5, sets={"full": FEATURES, "less": ["b", "c"]})
    alone = paths.nested_path(table, ["b", "c"], folds=4, n_lambdas=5)
    assert (both.coefficients[1, :, 1] == 0).all()
    assert np.allclose(both.coefficients[1][:, [0, 2, 3]], alone.coefficients[0], atol=1e-6) and np.allclose(both.lam[1], alone.lam[0])


def test_refit_ablation_finds_the_domain_that_matters(table):
    got = {(r["removed"], r["metric"]): r for r in validate.refit_ablation(table, FEATURES, {"first": ["a"], "last": ["c"]}, "entity", 100, 3, folds=4, n_lambdas=6).collect()}
    assert len(got) == 8
    assert got["first", "auroc"]["estimate"] > 0.1 and got["first", "auroc"]["ci_low"] > 0 and got["first", "brier"]["estimate"] < 0
    assert abs(got["last", "auroc"]["estimate"]) < 0.02


@pytest.mark.parametrize("change", ["fold = 9", "a = NULL", "y = NULL", "y = 1.0"])
def test_incomplete_input_is_refused(table, change):
    column, value = change.split(" = ")
    kind = table.schema[column].dataType.simpleString()
    where = "true" if change == "y = 1.0" else "key = 3"
    bad = table.selectExpr(*[f"CASE WHEN {where} THEN CAST({value} AS {kind}) ELSE {c} END AS {c}" if c == column else c for c in table.columns])
    with pytest.raises(ContractError):
        paths.nested_path(bad, FEATURES, folds=4, n_lambdas=3)


def test_too_few_folds_or_an_unknown_set_are_refused(table):
    with pytest.raises(ContractError):
        paths.nested_path(table, FEATURES, folds=2)
    with pytest.raises(ContractError):
        paths.nested_path(table, FEATURES, folds=4, sets={"x": ["zz"]})


def test_an_unconverged_fold_is_not_given_out(table, spark):
    path = paths.penalised_path(table, FEATURES, folds=4, n_lambdas=5, max_passes=2)
    with pytest.raises(ContractError):
        path.chosen()
    with pytest.raises(ContractError):
        path.cv_table(spark)


# ------------------------------------------------------------------ power forms
def terms(z, powers):
    out = []
    for i, p in enumerate(powers):
        out.append(out[-1] * np.log(z) if i and powers[i - 1] == p else np.log(z) if p == 0 else z**p)
    return np.column_stack(out)


@pytest.fixture(scope="module")
def curved(spark):
    r = np.random.default_rng(12)
    x = np.column_stack([r.uniform(0.05, 8, 1500), r.uniform(0.5, 4, 1500), r.normal(size=1500)])
    eta = 1.5 * np.log(x[:, 0]) + 0.35 * x[:, 1] ** 2 - 3 + 0.5 * x[:, 2]
    y = (r.random(1500) < 1 / (1 + np.exp(-eta))).astype(float)
    df = spark.createDataFrame([(float(t), *map(float, v)) for v, t in zip(x, y, strict=True)], "y double, u double, v double, w double")
    return x, y, df.repartition(3)


def test_power_forms_equal_an_exhaustive_search(curved):
    x, y, df = curved
    got = {r["variable"]: r for r in models.select_power_forms(df, ["u", "v"], ["w"]).collect()}
    forms = {k: tuple(r["powers"]) for k, r in got.items()}
    assert all(r["converged"] for r in got.values()) and forms["u"] == (0.0,) and len(forms["v"]) == 1 and forms["v"] != (-1.0,)
    scaled = {k: (x[:, i] + got_s) / got_c for i, k in enumerate("uv") for got_s, got_c in [(0.0, 10.0 ** np.floor(np.log10(np.ptp(x[:, i]))))]}
    form = lambda k, p: x[:, ["u", "v"].index(k)][:, None] if p == (1.0,) else terms(scaled[k], p)
    for k, other in (("u", "v"), ("v", "u")):  # no variable would move, given the other
        base = np.column_stack([form(other, forms[other]), x[:, 2]])
        every = {p: logistic(np.column_stack([base, terms(scaled[k], p)]), y) for p in models.power_candidates()}
        want = models.tested_form(every)
        assert want["form"] == forms[k]
        for c in ("deviance_linear", "deviance_one", "deviance_two", "p_nonlinear", "p_simplify"):
            assert got[k][c] == pytest.approx(want[c], rel=1e-5, abs=1e-6)
    joint = {(p, q): logistic(np.column_stack([terms(scaled["u"], (p,)), terms(scaled["v"], (q,)), x[:, 2]]), y) for p, q in itertools.product(models.POWERS, repeat=2)}
    assert min(joint, key=joint.get)[0] == forms["u"][0]
    full = logistic(x, y)
    for i, k in enumerate("uv"):
        assert got[k]["drop_cost"] == pytest.approx(logistic(np.delete(x, i, axis=1), y) - full, rel=1e-6)
    assert got["u"]["place"] == 1 + (got["u"]["drop_cost"] < got["v"]["drop_cost"])


def test_one_term_forms_and_cycle_limit(curved):
    _, _, df = curved
    got = {r["variable"]: r for r in models.select_power_forms(df, ["u", "v"], ["w"], max_degree=1, max_cycles=1).collect()}
    assert got["u"]["powers"] == [0.0] and got["u"]["deviance_two"] is None and got["u"]["p_simplify"] is None
    assert not got["u"]["converged"] and got["u"]["cycles"] == 1


def test_bad_requests_are_refused(curved):
    _, _, df = curved
    for bad in ({"variables": []}, {"variables": ["u"], "max_cycles": 0}, {"variables": ["u"], "max_degree": 3}, {"variables": ["u"], "alpha": 1.0}):
        with pytest.raises(ContractError):
            models.select_power_forms(df, **bad)
    with pytest.raises(ContractError):
        models.select_power_forms(df.selectExpr("y", "IF(u > 7, NULL, u) AS u"), ["u"])


def test_chi_square_tail():
    # fixed values: the 5% points
    for freedom, point in ((1, 3.841459), (2, 5.991465), (3, 7.814728)):
        assert models.chi_square_tail(point, freedom) == pytest.approx(0.05, abs=1e-6)
        assert models.chi_square_tail(0, freedom) == 1 and models.chi_square_tail(-1, freedom) == 1
