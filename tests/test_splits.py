"""Splits and folds: embargo, disjoint entities, exact greedy folds, one release."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import splits


def test_embargo_and_overlap(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1)), (1, d(2021, 6, 1)), (2, d(2020, 1, 1)), (2, d(2020, 9, 1)), (3, d(2020, 11, 1)), (4, d(2020, 1, 1)), (5, d(2021, 6, 1)), (6, d(2020, 9, 1))]
    df = spark.createDataFrame(rows, "entity_id long, index_date date")
    plan = splits.TemporalSplit("2020-06-30", "2020-12-31", window_days=180)
    got = {(r.entity_id, r.index_date): (r.split, r.removed) for r in splits.temporal_split(df, plan).collect()}
    assert got[(1, d(2020, 1, 1))] == ("train", "entity_overlap") and got[(1, d(2021, 6, 1))] == ("test", None)
    assert got[(2, d(2020, 1, 1))] == ("train", "entity_overlap") and got[(2, d(2020, 9, 1))] == ("validation", None)
    assert got[(4, d(2020, 1, 1))] == ("train", None)
    late = splits.TemporalSplit("2020-06-30", "2020-12-31", window_days=300)
    got = {(r.entity_id, r.index_date): r.removed for r in splits.temporal_split(df, late).collect()}
    assert got[(4, d(2020, 1, 1))] == "embargo" and got[(3, d(2020, 11, 1))] == "embargo"


@pytest.mark.parametrize("seed", range(6))
def test_rungs_equal_the_sequential_greedy(seed):
    rng = random.Random(seed)
    k = rng.randint(2, 6)
    load = [rng.randint(0, 40) for _ in range(k)]
    size, m = rng.randint(1, 9), rng.randint(1, 60)
    want, cur = [0] * k, list(load)
    for _ in range(m):
        f = cur.index(min(cur))
        want[f] += 1
        cur[f] += size
    assert splits._rungs(load, size, m) == want


def test_balanced_folds_with_a_hot_group(spark):
    rows = [(0,)] * 100 + [(e,) for e in range(1, 60) for _ in range(1 + e % 4)]
    df = spark.createDataFrame(rows, "entity_id long")
    got = splits.balanced_folds(df, "entity_id", 4, 9).collect()
    assert len(got) == 60 and len({r.entity_id for r in got}) == 60
    load = {}
    for r in got:
        load[r.fold] = load.get(r.fold, 0) + r["size"]
    assert sum(load.values()) == len(rows) and sorted(load.values())[0] >= 40


def test_hash_partition_is_stable(spark):
    row = spark.createDataFrame([("p1",)], "id string").select(splits.hashing.hash_uniform(F.lit("salt"), "id").alias("u")).first()
    assert row.u == 0.5250385830505713


def test_rows_are_released_once(spark):
    held = splits.HeldBackRows(spark.range(3))
    assert held.release("final").count() == 3
    with pytest.raises(RuntimeError):
        held.release("again")


def test_stratified_folds_are_balanced(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 7 == 0).cast("long"))
    n = splits.stratified_folds(df, "id", 5, 1).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in n if r.y == y]
        assert max(sizes) - min(sizes) <= 1
