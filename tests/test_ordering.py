"""The ordering kernel against brute force, with ties and one score holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.operators import ordering


def rows(n, seed, hot=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = 0.5 if hot and i % 3 == 0 else round(rng.random(), 2)
        out.append((i, rng.choice(["a", "b"]), p, rng.randint(0, 1)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_sums_match_brute_force(spark, seed):
    data = rows(400, seed)
    df = spark.createDataFrame(data, "id long, k string, p double, y long")
    got = {(r.k, r.p): (r.cum_n, r.cum_pos, r.tot_n) for r in ordering.prefix_sums(df, "p", {"n": F.lit(1), "pos": F.col("y")}, ["k"]).collect()}
    for (k, p), (n, pos, tot) in got.items():
        ahead = [r for r in data if r[1] == k and r[2] >= p]
        assert n == len(ahead) and pos == sum(r[3] for r in ahead) and tot == sum(r[1] == k for r in data)
    assert len(got) == len({(r[1], r[2]) for r in data})


@pytest.mark.parametrize("descending", [True, False])
def test_rank_rows_match_sort(spark, descending):
    data = rows(300, 7)
    df = spark.createDataFrame(data, "id long, k string, p double, y long")
    got = {r.id: (r.rn, r.cum_pos) for r in ordering.rank_rows(df, "p", "id", {"pos": F.col("y")}, ["k"], descending=descending).collect()}
    for k in ("a", "b"):
        ordered = sorted((r for r in data if r[1] == k), key=lambda r: (-r[2] if descending else r[2], r[0]))
        total = 0
        for i, r in enumerate(ordered, start=1):
            total += r[3]
            assert got[r[0]] == (i, total)


def test_rank_spread_equals_rank_rows(spark):
    df = spark.createDataFrame(rows(200, 3, hot=False), "id long, k string, p double, y long")
    a = {r.id: r.rn for r in ordering.rank_spread(df, "p", "id", ["k"]).collect()}
    b = {r.id: r.rn for r in ordering.rank_rows(df, "p", "id", keys=["k"], descending=False).collect()}
    assert a == b


def test_quantiles_equal_numpy(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, 1.5, rng.random() * 10]) for _ in range(257)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    row = ordering.quantiles(df, "v", probs).first()
    assert row.n_observed == 257
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], np.quantile(values, probs))


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, k string, p double, y long")
    assert ordering.prefix_sums(df, "p", {"n": F.lit(1)}).collect() == []
    assert ordering.rank_rows(df, "p", "id").collect() == []


def test_no_single_task_window_over_rows(spark):
    """Every window over rows is partitioned; only the table of ranges may be ordered in one task."""
    df = spark.createDataFrame(rows(50, 1), "id long, k string, p double, y long")
    plan = ordering.rank_rows(df, "p", "id")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition(_tie_range" in line or "windowspecdefinition(p" in line:
            assert "_range" in line or "p#" in line


def test_range_search_runs_once_a_row(spark):
    """No filter or join condition repeats the search for a row's range, and the aggregate below it is shared."""
    df = spark.createDataFrame(rows(60, 4), "id long, k string, p double, y long")
    ranked = ordering.rank_spread(df, "id", "id", ["k"])
    runs = ordering.prefix_sums(df.select("k", F.round(F.col("p") * 2, 3).alias("p")), "p", {"n": F.lit(1)}, ["k"], bounds=ordering.value_bounds(df, "p", 64))
    for out in (ranked, runs):
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("lambda" in line for line in plan)
        assert not [line for line in plan if ("Filter" in line or "Join" in line) and "lambda" in line]
    hashed = ordering.rank_spread(df.withColumn("u", F.col("id") / 60), "u", "id", ["k"], bounds=ordering.even_bounds(df))
    assert "lambda" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.rn for r in hashed.collect()} == {r.id: r.rn for r in ranked.collect()}
