"""Steps that must not grow faster than their rows: small joins are sent, shared rows are written once, passes send little."""

import numpy as np
from pyspark.sql import functions as F

from asofkit.ml import paths, validate
from asofkit.operators import drift
from asofkit.queries.model_queries import fit_rows
from asofkit.queries.registry import Tables
from asofkit.session import cut_lineage


def test_edges_are_sent_and_values_stay(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") > 9, F.col("id").cast("double")).alias("b"))
    edges = cut_lineage(drift.decile_edges(df, ["a", "b"]))
    shares = drift.bin_shares(df, ["a", "b"], edges)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sizes were unknown
    try:
        assert "BroadcastHashJoin [column_name" in shares._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    missing = {r.column_name: r.n for r in shares.where("bin = 'missing'").collect()}
    assert missing == {"a": 0, "b": 10}


def test_model_rows_are_written_once(spark, tmp_path):
    day = lambda y, m: F.make_date(F.lit(y), m, F.lit(5))
    ids = spark.range(1, 41)
    tables = {
        "orders": ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 8).alias("o_custkey"), day(1997, 1 + F.col("id") % 12).alias("o_orderdate"), (F.col("id") * 10.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": ids.select(F.col("id").alias("l_orderkey"), F.lit("R").alias("l_returnflag"), day(1997, 1 + F.col("id") % 12).alias("l_shipdate")),
        "customer": spark.range(8).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(1).alias("c_nationkey"), F.lit(700.0).alias("c_acctbal")),
        "nation": spark.range(1, 2).select(F.col("id").cast("int").alias("n_nationkey"), F.lit("N").alias("n_name")),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = fit_rows(Tables(spark, str(tmp_path)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 24 and "Join" not in plan and "FileScan" not in plan


def test_cached_rows_come_in_few_parts(spark):
    kept = spark.range(0, 1000, 1, 60).persist()
    few = validate.in_few_parts(kept)
    assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and few.count() == 1000
    kept.unpersist()


def test_pass_leaves_out_what_nobody_reads(spark):
    r = np.random.default_rng(1)
    data = [(int(f), float(y), x.tolist()) for f, y, x in zip(r.integers(0, 2, 300), r.integers(0, 2, 300), r.normal(size=(300, 3)), strict=True)]
    df = spark.createDataFrame(data, "fold int, y double, x array<double>").repartition(3)
    raw = r.normal(size=(2, 3, 4))
    whole = paths._pass(df, [(0,), ()], raw)
    open_ = np.array([[True, False, True], [False, False, False]])
    part = paths._pass(df, [(0,), ()], raw, open_=open_)
    kept = np.concatenate([np.repeat(open_, 4, 1), np.repeat(open_, 10, 1), open_], axis=1)
    assert np.allclose(part, np.where(kept, whole, 0))
    used = np.array([[True, False, True, True], [True, True, False, False], [True, True, True, True]])
    i, j = np.triu_indices(4)
    few = paths._pass(df, [()], raw[:1], used=used)[0]
    every = paths._pass(df, [()], raw[:1])[0]
    own = np.concatenate([np.ones(12, bool), (used[:, i] & used[:, j]).ravel(), np.ones(3, bool)])
    assert np.allclose(few, np.where(own, every, 0))
