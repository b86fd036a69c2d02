"""Calibration of many keys against a direct solve of each key, and the reasons of undefined fits."""

import math
import random

import numpy as np
import pytest

from asofkit.operators import evaluate, grouped_fit


def newton(rows, offset):
    """Plain Newton steps on one key's (y, x, w); coefficients and their standard errors."""
    y, x, w = (np.array(c, float) for c in zip(*rows, strict=True))
    a, b = math.log((w @ y) / (w.sum() - w @ y)) - (w @ x / w.sum() if offset else 0.0), float(offset)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(a + b * x)))
        v, r = w * mu * (1 - mu), w * (y - mu)
        if offset:
            a += r.sum() / v.sum()
        else:
            info = np.array([[v.sum(), v @ x], [v @ x, v @ (x * x)]])
            da, db = np.linalg.solve(info, [r.sum(), r @ x])
            a, b = a + da, b + db
    if offset:
        return a, 1.0, v.sum() ** -0.5, None
    cov = np.linalg.inv(info)
    return a, b, cov[0, 0] ** 0.5, cov[1, 1] ** 0.5


def fitted(spark, rows, **kw):
    df = spark.createDataFrame(rows, "site string, day long, y long, lp double, w double")
    out = grouped_fit.fit_by_key(df, ["site", "day"], weight="w", offset_only=[False, True], **kw).collect()
    return {(r.site, r.day, r.offset_only): r for r in out}


def drawn(rng, n, slope):
    out = []
    for _ in range(n):
        x = round(rng.gauss(0, 1.2), 2)
        out.append((int(rng.random() < 1 / (1 + math.exp(-0.3 - slope * x))), x, float(rng.randint(1, 3))))
    return out


@pytest.mark.parametrize("piece", [100_000, 16])
def test_fits_equal_a_direct_solve_and_a_hot_key_is_dealt(spark, monkeypatch, piece):
    monkeypatch.setattr(grouped_fit, "PIECE_CELLS", piece)
    rng = random.Random(5)
    groups = {("a", d): drawn(rng, 60, 0.4 + d / 10) for d in range(6)}
    groups[None, 3] = drawn(rng, 80, 1.5)
    groups["hot", None] = drawn(rng, 500, 0.8)  # more than half of all rows
    got = fitted(spark, [(*k, *r) for k, rows in groups.items() for r in rows])
    assert len(got) == 2 * len(groups)
    for k, rows in groups.items():
        for offset in (False, True):
            r = got[(*k, offset)]
            assert r.fit_status == "converged"
            want = newton(rows, offset)
            assert (r.intercept, r.slope, r.intercept_se) == pytest.approx(want[:3], abs=1e-7)
            assert r.slope_se is None if offset else r.slope_se == pytest.approx(want[3], abs=1e-7)


def test_reasons_of_undefined_fits(spark):
    rows = [("events", 1, 1, x, 1.0) for x in (0.1, 0.2)] + [("flat", 1, y, 0.5, 1.0) for y in (0, 1, 1)]
    rows += [("apart", 1, int(x > 0), x, 1.0) for x in (-2.0, -1.0, 1.0, 2.0)] + [("none", 1, None, 0.3, 1.0), ("none", 1, 1, None, 1.0), ("none", 1, 0, 0.3, None)]
    got = fitted(spark, rows)
    assert {k[0]: r.fit_status for k, r in got.items() if not k[2]} == {"events": "one_class", "none": "one_class", "flat": "singular", "apart": "separated"}
    assert all(r.intercept is None and r.slope is None and r.slope_se is None for k, r in got.items() if not k[2])
    assert got["flat", 1, True].fit_status == "converged" and got["flat", 1, True].intercept == pytest.approx(math.log(2) - 0.5)


def test_steps_run_out(spark):
    rng = random.Random(2)
    got = fitted(spark, [("a", 1, *r) for r in drawn(rng, 50, 1.0)], max_iter=1)
    assert {r.fit_status for r in got.values()} == {"not_converged"}


def test_no_rows(spark):
    assert fitted(spark, []) == {}


def test_ten_thousand_keys(spark):
    """Every key has the same 8 rows but for a shift of its scores by ``d``, which moves the intercept by -slope * d."""
    base = [(0, -1.0), (1, -1.0), (0, -1.0), (0, 0.0), (1, 0.0), (1, 1.0), (0, 1.0), (1, 1.0)]
    keys = spark.range(10_000).withColumnRenamed("id", "k")
    df = keys.crossJoin(spark.createDataFrame(base, "y long, x double")).selectExpr("k", "y", "x + (k % 100) / 100D AS lp")
    a, b, *_ = newton([(y, x, 1.0) for y, x in base], False)
    got = evaluate.fit_calibration(df, ["k"])
    assert got.count() == 10_000
    wrong = got.where(f"fit_status <> 'converged' OR abs(slope - {b}) > 1e-7 OR abs(intercept - ({a} - {b} * (k % 100) / 100D)) > 1e-7")
    assert wrong.isEmpty()
