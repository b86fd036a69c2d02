"""Spline-smoothed calibration: a logistic fit on a restricted cubic spline of logit(p), read on a grid of risks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.ml.models import fit_unpenalised
from asofkit.operators.ordering import quantiles

KNOT_SHARES = {3: (0.10, 0.50, 0.90), 4: (0.05, 0.35, 0.65, 0.95), 5: (0.05, 0.275, 0.50, 0.725, 0.95)}  # fixed values


def spline_terms(x: Column, knots: list[float]) -> list[Column]:
    """x and the k - 2 non-linear terms, linear beyond the outer knots."""
    first, before, last = knots[0], knots[-2], knots[-1]
    cube = lambda k: F.pow(F.greatest(x - F.lit(k), F.lit(0.0)), 3)
    out = [x]
    for k in knots[:-2]:
        out.append((cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / (last - first) ** 2)
    return out


def smooth_calibration(df: DataFrame, *, n_knots: int = 4, n_grid: int = 50) -> DataFrame:
    """Grid of predicted risks with the smoothed observed rate and a 95% band; empty when the fit is not identifiable.

    Knots and grid are exact quantiles (bounded numbers on the driver); the fit and its covariance are distributed.
    """
    spark = df.sparkSession
    schema = "point int, predicted double, observed double, ci_low double, ci_high double"
    rows = df.select(F.col("y").cast("double").alias("y"), stats.clip(F.col("p"), 1e-6, 1 - 1e-6).alias("p")).persist()
    shares = list(KNOT_SHARES[n_knots])
    grid_shares = [0.01 + 0.98 * i / (n_grid - 1) for i in range(n_grid)]
    q = quantiles(rows, "p", shares + grid_shares).first()
    counts = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    knots = [math.log(q[f"q{i}"] / (1 - q[f"q{i}"])) for i in range(n_knots)]
    if len(set(knots)) < n_knots or counts[0] < 10 or counts[1] - counts[0] < 10:
        rows.unpersist()
        return spark.createDataFrame([], schema)
    names = [f"t{i}" for i in range(n_knots - 1)]
    x = stats.logit(F.col("p"))
    data = rows.withColumns(dict(zip(names, spline_terms(x, knots))))
    model = fit_unpenalised(data, names, max_coef=math.inf)
    beta = [float(model.intercept), *[float(c) for c in model.coefficients]]
    info = _information(data, names, beta)
    rows.unpersist()
    grid = spark.createDataFrame([(i, float(q[f"q{n_knots + i}"])) for i in range(n_grid)], "point int, p double")
    terms = [F.lit(1.0), *spline_terms(x, knots)]
    eta = sum((F.lit(b) * t for b, t in zip(beta[1:], terms[1:])), F.lit(beta[0]))
    var = sum((F.lit(info[i][j]) * terms[i] * terms[j] for i in range(len(terms)) for j in range(len(terms))), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return grid.select("point", F.col("p").alias("predicted"), stats.expit(eta).alias("observed"), stats.expit(eta - 1.959964 * se).alias("ci_low"), stats.expit(eta + 1.959964 * se).alias("ci_high"))


def _information(data: DataFrame, names: list[str], beta: list[float]) -> list[list[float]]:
    """Inverse Fisher information at ``beta`` from one aggregate of weighted cross products."""
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    mu = stats.expit(sum((F.lit(b) * c for b, c in zip(beta[1:], x[1:])), F.lit(beta[0])))
    w = mu * (1 - mu)
    k = len(x)
    sums = data.agg(*[F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    pos = 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = sums[pos]
            pos += 1
    return np.linalg.inv(m).tolist()
