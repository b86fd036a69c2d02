"""Metrics against brute force and published numbers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars, stats
from asofkit.operators import capacity, design, evaluate, profile, resample, timing


def data(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        p = 0.4 if i % 3 == 0 else round(min(0.99, max(0.01, rng.random() * 0.6 + 0.2 * y)), 2)
        out.append((i, i % 5, y, p))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(data(), "id long, fold long, y long, p double").persist()


def brute_auc(rows):
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auroc_by_pair_count(scored):
    assert evaluate.ranking_metrics(scored).first().auroc == pytest.approx(brute_auc(data()), abs=1e-12)


def test_single_class_is_undefined(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y long, p double")
    row = evaluate.ranking_metrics(df).first()
    assert row.auroc is None and row.ap is None


def test_delong_against_placements(scored):
    rows = data()
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    v10 = [np.mean([(p > q) + 0.5 * (p == q) for q in neg]) for p in pos]
    v01 = [np.mean([(p > q) + 0.5 * (p == q) for p in pos]) for q in neg]
    want = np.var(v10, ddof=1) / len(pos) + np.var(v01, ddof=1) / len(neg)
    assert evaluate.delong(scored).first().variance == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("frac", [0.01, 0.1, 0.34, 0.8])
def test_capacity_table_splits_ties_by_key(scored, frac):
    rows = sorted(data(), key=lambda r: (-r[3], r[0]))
    k = max(1, int(np.ceil(frac * len(rows))))
    got = capacity.capacity_table(scored, "id", [frac]).first()
    tp = sum(r[2] for r in rows[:k])
    assert (got.tp, got.fp, got.flagged) == (tp, k - tp, k)


def test_fold_capacity_selects_inside_folds(scored):
    got = capacity.fold_capacity(scored.withColumn("m", F.lit("x")), ["m"], [100], "id").first()
    rows, tp, n = data(), 0, 0
    for f in range(5):
        part = sorted((r for r in rows if r[1] == f), key=lambda r: (-r[3], r[0]))
        tp, n = tp + sum(r[2] for r in part[:6]), n + 6
    assert (got.tp, got.flagged, got.population) == (tp, n, 300)


def test_half_up_rounding_in_integers(spark):
    got = spark.range(1).select(capacity.n_selected(F.lit(30), F.lit(97467)).alias("k"), capacity.n_selected(F.lit(5), F.lit(100)).alias("h")).first()
    assert (got.k, got.h) == (2924, 1)


def test_allocation_is_largest_remainder(spark):
    sizes = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("a", 2, 11)], "m string, fold int, size long")
    got = {r.fold: r.k for r in capacity.allocate(sizes, F.lit(10), ["m"]).collect()}
    assert got == {0: 3, 1: 3, 2: 4}


def test_published_net_benefit(spark):
    got = spark.range(1).select(stats.net_benefit(F.lit(19.2), F.lit(174.3), F.lit(1000.0), F.lit(0.1)).alias("nb")).first().nb
    assert got == pytest.approx(-0.00017, abs=1e-5)


def test_published_log_count(spark):
    got = [r.t for r in spark.createDataFrame([(0,), (9,), (61,)], "c long").select("c", scalars.log_count("c").alias("t")).orderBy("c").collect()]
    assert got == pytest.approx([-2.302585, 0.0, 1.824549], abs=1e-6)


@pytest.mark.parametrize("lo,hi,expected", [(0, 61, (1, 10)), (21, 80, (0, 10)), (0, 2380, (1, 1000))])
def test_power_scaling(spark, lo, hi, expected):
    row = design.power_scaling(spark.range(lo, hi + 1).withColumnRenamed("id", "x"), "x").first()
    assert (row["shift"], row["scale"]) == expected


def test_calibration_of_separated_data_is_undefined(spark):
    df = spark.createDataFrame([(0, -1.0), (0, -2.0), (1, 1.0), (1, 2.0)], "y long, lp double")
    assert evaluate.fit_calibration(df).first().slope is None


def test_perfectly_calibrated_slope(spark):
    rows = [(y, lp) for lp, n1, n0 in ((-1.0986122886681098, 25, 75), (0.0, 50, 50), (1.0986122886681098, 75, 25)) for y, n in ((1, n1), (0, n0)) for _ in range(n)]
    r = evaluate.fit_calibration(spark.createDataFrame(rows, "y long, lp double")).first()
    assert r.slope == pytest.approx(1.0, abs=1e-8) and r.intercept == pytest.approx(0.0, abs=1e-8)


def test_operating_point_is_highest_threshold(scored):
    rows = data()
    total = sum(r[2] for r in rows)
    got = evaluate.operating_points(scored, [0.7]).first()
    feasible = [t for t in sorted({r[3] for r in rows}) if sum(r[2] for r in rows if r[3] >= t) / total >= 0.7]
    assert got.threshold == max(feasible)


def test_bootstrap_weights_and_identical_models(spark, scored):
    df = scored.withColumn("p2", F.col("p"))
    d = resample.paired_difference(df, "p", "p2", "id", 6, 1).collect()
    assert all(r.estimate == 0 and r.ci_low == 0 and r.ci_high == 0 for r in d)
    w = spark.range(4000).withColumn("b", F.lit(1)).select(resample.replicate_weight("id", 1).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1, abs=0.06) and w[1] == pytest.approx(1, abs=0.1)


def test_bounds_cover_every_allowed_state(spark):
    states = spark.createDataFrame([(0.0, 0.0, -1.0), (1.0, 0.0, 2.0), (0.0, 2.0, 5.0), (3.0, 3.0, 9.0)], "a double, b double, contribution double")
    rows = [(1, 1.0, 1.0), (2, None, 0.0), (3, 0.0, None), (4, None, None), (5, -1.0, 0.0)]
    unk = spark.createDataFrame(rows, "row long, a double, b double")
    got = {r.row: (r.lo, r.hi, r.fallback) for r in timing.profile_bounds(unk, states, ["a", "b"], "row").collect()}
    assert got == {1: (-1.0, 2.0, False), 2: (-1.0, 2.0, False), 3: (-1.0, 5.0, False), 4: (-1.0, 9.0, False), 5: (-1.0, 9.0, True)}


def test_pairwise_sums_match_pandas(spark):
    rng = random.Random(2)
    rows = [tuple(None if rng.random() < 0.2 else rng.random() for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr(method="pearson")
    for r in profile.correlation_pairs(df, ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(want.loc[r.column_a, r.column_b], abs=1e-9)


def test_redundancy_clusters_do_not_chain(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.1)], "column_a string, column_b string, r double")
    got = [(r.cluster, r.representative, r.member) for r in profile.redundancy_clusters(pairs, ["a", "b", "c"], 0.8).orderBy("cluster", "member").collect()]
    assert got == [(1, "a", "a"), (1, "a", "b")]
