"""Replicates as vectors against one replicate at a time in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.operators import replicates, resample

SEED, B = 5, 40


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(1500):
        p = r.choice([0.5, 0.5, 0.25, round(r.uniform(0.01, 0.99), 2), r.uniform(0.01, 0.99)])  # two hot scores, some ties, some scores of their own
        out.append((i, r.choice([None, *range(60)]), i % 3, int(r.random() < p), p, r.uniform(0.01, 0.99)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "row long, who long, fold long, y long, a double, b double").repartition(7)


def weights(who, n_boot=B):
    return replicates.weight_vector(None if who is None else str(who), SEED, n_boot)


def brute_ranking(pairs):
    """(score, y, w) of one replicate."""
    pos, neg = sum(w for _, y, w in pairs if y), sum(w for _, y, w in pairs if not y)
    auc = ap = above_pos = above_neg = 0
    for score in sorted({s for s, _, _ in pairs}, reverse=True):
        p, n = (sum(w for s, y, w in pairs if s == score and y == k) for k in (1, 0))
        above_pos, above_neg = above_pos + p, above_neg + n
        auc += p * (neg - above_neg + n / 2)
        ap += p / pos * above_pos / (above_pos + above_neg) if p else 0
    return auc / (pos * neg), ap


def test_vectors_equal_the_column(spark, df):
    cells = df.select("who").distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B)))).withColumn("w", resample.replicate_weight("who", SEED)).collect()
    assert len(cells) == 61 * B and all(weights(r.who)[r.b - 1] == r.w for r in cells)
    many = np.concatenate([replicates.weight_vector(str(i), 1, 200) for i in range(300)])
    assert many.mean() == pytest.approx(1, abs=0.02) and many.var() == pytest.approx(1, abs=0.03)
    assert (replicates.weight_vector("x", 1, 8) == replicates.weight_vector("x", 1, 200)[:8]).all()


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_metrics_equal_brute_force(spark, df, rows, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)  # 60 ranges: the hot scores span several
    try:
        got = {(r.b, r.model): r for r in resample.replicate_metrics(df, {"a": "a", "b": "b"}, "who", B, SEED).collect()}
        points = {(r.b, r.model, r.target): r for r in resample.operating_replicates(df, {"a": "a"}, [0.5, 1.0], "who", B, SEED).collect()}
        captured = {(r.b, r.model): r for r in resample.capture_replicates(df, {"a": "a", "b": "b"}, 0.1, "row", "who", B, SEED).collect()}
        folds = {(r.b, r.model): r for r in resample.capacity_bootstrap(df, {"a": "a"}, 50, "row", "who", B, SEED).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 2 * B
    for b in (1, 2, 17, B):
        for m, at in (("a", 4), ("b", 5)):
            own = [(r, int(weights(r[1])[b - 1])) for r in rows]
            auc, ap = brute_ranking([(r[at], r[3], w) for r, w in own])
            n, events = sum(w for _, w in own), sum(w * r[3] for r, w in own)
            r = got[b, m]
            assert r.auroc == pytest.approx(auc, abs=1e-12) and r.ap == pytest.approx(ap, abs=1e-12)
            assert r.brier == pytest.approx(sum(w * (x[at] - x[3]) ** 2 for x, w in own) / n, abs=1e-12)
            assert r.logloss == pytest.approx(-sum(w * math.log(x[at] if x[3] else 1 - x[at]) for x, w in own) / n, abs=1e-12)
            assert r.oe_ratio == pytest.approx(events / sum(w * x[at] for x, w in own), abs=1e-12)
            copies = sorted([(-x[at], x[0], x[3]) for x, w in own for _ in range(w)])
            k = max(1, math.ceil(0.1 * n))
            assert (captured[b, m].k, captured[b, m].tp) == (k, sum(y for *_, y in copies[:k]))
        own = [(r[4], r[3], int(weights(r[1])[b - 1])) for r in rows]
        total = sum(w * y for _, y, w in own)
        for target in (0.5, 1.0):
            t = max(s for s, _, _ in own if sum(w * y for p, y, w in own if p >= s) / total >= target - 1e-12)
            flagged = sum(w for p, _, w in own if p >= t)
            assert points[b, "a", target].flagged_share == pytest.approx(flagged / sum(w for *_, w in own), abs=1e-12)
        sizes = np.array([[sum(int(weights(r[1])[b - 1]) for r in rows if r[2] == f)] for f in range(3)])
        split = resample.largest_remainders(sizes, (2 * 50 * len(rows) + 1000) // 2000)[:, 0]
        tp = 0
        for f in range(3):
            copies = sorted([(-r[4], r[0], r[3]) for r in rows if r[2] == f for _ in range(int(weights(r[1])[b - 1]))])
            tp += sum(y for *_, y in copies[: split[f]])
        assert (folds[b, "a"].tp, folds[b, "a"].selected) == (tp, split.sum())


def test_calibration_solves_the_score_equations(spark, df, rows):
    got = resample.calibration_bootstrap(df.withColumn("p", F.col("b")), "who", B, SEED).collect()
    assert len(got) == B
    for r in got[::13]:
        g0 = g1 = large = 0.0
        for x in rows:
            w, lp = int(weights(x[1])[r.b - 1]), math.log(x[5] / (1 - x[5]))
            mu = 1 / (1 + math.exp(-(r.intercept + r.slope * lp)))
            g0, g1, large = g0 + w * (x[3] - mu), g1 + w * (x[3] - mu) * lp, large + w * (x[3] - 1 / (1 + math.exp(-(r.citl + lp))))
        assert max(abs(g0), abs(g1), abs(large)) < 1e-6


def test_one_class_and_no_rows(spark, df):
    ones = resample.replicate_metrics(df.withColumn("y", F.lit(1)), {"a": "a"}, "who", 3, SEED).collect()
    assert len(ones) == 3 and all(r.auroc is None and r.brier is None for r in ones)
    assert resample.replicate_metrics(df.limit(0), {"a": "a"}, "who", 3, SEED).collect() == []
    flat = resample.calibration_bootstrap(df.withColumn("y", F.lit(0)).withColumn("p", F.col("a")), "who", 3, SEED).collect()
    assert len(flat) == 3 and all(r.slope is None and r.brier is not None for r in flat)


def test_rows_shuffled_do_not_depend_on_the_replicates(spark, df):
    def dealt_bytes(n_boot):
        seen = {s.stageId() for s in _stages(spark)}
        resample.replicate_metrics(df, {"a": "a", "b": "b"}, "who", n_boot, SEED)
        return [s.shuffleWriteRecords() for s in _stages(spark) if s.stageId() not in seen and s.shuffleWriteBytes() > 0]

    few, many = dealt_bytes(8), dealt_bytes(200)
    assert few == many == [3000, 1500]  # both models' rows once; the fixture's own shuffle


def _stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_dealt_rows_carry_their_weights(spark):
    df = spark.createDataFrame([("m", 0.1 * i, i % 2, None if i == 3 else f"c{i % 4}", i) for i in range(9)], "model string, p double, y int, c string, k long")
    dealt = replicates.deal(df, ["model"], "c", 9, 5, "k")
    rows = dealt.toArrow()
    packed = rows.column("_w").combine_chunks()
    order = [round(10 * p) for p in rows.column("p").to_pylist()]
    assert "_cluster" not in dealt.columns and order == list(range(8, -1, -1))
    expected = [replicates.draw_weights([None if i == 3 else f"c{i % 4}"], 5, 9)[0].tolist() for i in order]
    assert replicates._unpack(packed, 9).tolist() == expected
