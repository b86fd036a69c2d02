"""Typed reads, contracts, manifests, sealed scans, run metrics, registry."""

import json

import pytest
from pyspark.sql import functions as F

from asofkit.functions.hashing import content_number
from asofkit.functions import dates, scalars, suppress
from asofkit.operators import contracts
from asofkit.operators.contracts import ColumnRule, Contract, ContractError
from asofkit.sources import tables


def test_coercion_never_repairs(spark):
    raw = spark.createDataFrame([("7",), (" 7.0 ",), ("7.5",), ("true",), ("False",), ("x",), ("",), (None,), ("nan",), ("1d",), ("1e2",)], "v string")
    got = [r.n for r in raw.select(scalars.to_integer("v").alias("n")).collect()]
    assert got == [7, 7, None, 1, 0, None, None, None, None, None, 100]


def test_dates_by_declared_formats(spark):
    raw = spark.createDataFrame([("2020-02-01",), ("01/02/2020",), ("2020-02-01 10:20:30.5",), ("2020-02-01T10:20:30+02:00",), ("00:00.0",), ("2020-13-01",), ("2999-12-31",)], "v string")
    got = [str(r.d) if r.d else None for r in raw.select(dates.parse_dates("v", ["yyyy-MM-dd", "dd/MM/yyyy"]).alias("d")).collect()]
    assert got == ["2020-02-01", "2020-02-01", "2020-02-01", "2020-02-01", None, None, "2999-12-31"]


def test_ambiguous_formats_are_refused():
    with pytest.raises(ValueError):
        Contract((ColumnRule("d", "date"),), date_formats=("dd/MM/yyyy", "MM/dd/yyyy"))


def test_mapping_lists_every_problem(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, extra int")
    with pytest.raises(ContractError, match="undeclared.*extra"):
        contracts.apply_mapping(df, {"k": "key", "v": "value"}, {})
    with pytest.raises(ContractError, match="v=y"):
        contracts.apply_mapping(df, {"k": "key", "v": "value"}, {"v": {"x": "X"}}, drop=["extra"])
    out = contracts.apply_mapping(df, {"k": "key", "v": "value"}, {"v": {"x": "X", "y": "Y"}}, drop=["extra"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "X"), ("b", "Y")]


def test_rules_pass_find_and_skip(spark):
    df = spark.createDataFrame([(1, 2), (5, 3)], "a int, b int")
    rules = [contracts.Rule("r1", "c", "INFO", "t", ("a", "b"), "a > b"), contracts.Rule("r2", "c", "CRITICAL", "t", ("a",), "a < 0"), contracts.Rule("r3", "c", "INFO", "t", ("zz",), "zz > 0")]
    got = {r.rule_id: (r.status, r.n, r.severity) for r in contracts.run_rules(df, rules).collect()}
    assert got == {"r1": ("FINDING", 1, "INFO"), "r2": ("PASS", 0, None), "r3": ("NOT_APPLICABLE", None, None)}


def test_one_index_date(spark):
    df = spark.sql("SELECT DATE'2020-01-01' AS d UNION ALL SELECT DATE'2020-01-01'")
    assert contracts.one_index_date(df, "d") == "2020-01-01"
    with pytest.raises(ContractError):
        contracts.one_index_date(df.union(spark.sql("SELECT DATE'2021-01-01'")), "d")


def test_small_cells_hide_derived_values(spark):
    df = spark.createDataFrame([("a", 5, 100, 0.05), ("b", 50, 100, 0.5), ("c", 0, 100, 0.0)], "k string, n int, m int, r double")
    got = {r.k: (r.n, r.m, r.r) for r in suppress.suppress_together(df, ["n", "m"], ["r"], 10).collect()}
    assert got == {"a": (None, None, None), "b": (50, 100, 0.5), "c": (0, 100, 0.0)}


def dataset(spark):
    return spark.sql("SELECT id AS entity, DATE'2020-01-01' AS index_date, CAST(id % 2 AS INT) AS y FROM range(20)")


def test_dataset_round_trip_and_tamper(spark, tmp_path):
    path = str(tmp_path / "ds")
    tables.write_dataset(dataset(spark), path, entity="entity", index="index_date", y="y", versions={"dataset_version": "1"})
    schema = "entity long, index_date date, y int, dataset_version string"
    assert tables.read_dataset(spark, path, schema).count() == 20
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_dataset(dataset(spark), path, entity="entity", index="index_date", y="y", versions={"dataset_version": "1"})
    spark.sql("SELECT 99L AS entity, DATE'2020-01-01' AS index_date, 1 AS y, '1' AS dataset_version").write.mode("append").parquet(path + "/data")
    with pytest.raises(ContractError):
        tables.read_dataset(spark, path, schema)


def test_typed_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("code,n,d\n007,1,2020-02-03\n,,\n")
    got = [tuple(r) for r in tables.read_csv(spark, str(f), "code string, n int, d date").collect()]
    assert got[0][0] == "007" and got[0][1] == 1 and str(got[0][2]) == "2020-02-03" and got[1] == (None, None, None)


def test_header_refuses_duplicates(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("a,b,a\n1,2,3\n")
    with pytest.raises(ContractError):
        tables.header(spark, str(f), "csv")


def test_sealed_column_is_refused_and_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    dataset(spark).write.parquet(path)
    df = spark.read.parquet(path)
    with pytest.raises(PermissionError):
        tables.sealed_read(df, ["entity", "y"], {"y": "label"})
    plan = tables.sealed_read(df, ["entity"], {"y": "label"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<entity:bigint>" in plan


def test_predictions_with_duplicate_keys(spark, tmp_path):
    path = str(tmp_path / "pred")
    tables.write_predictions(dataset(spark).withColumn("risk", F.lit(0.1)), path, ["entity", "index_date"], "y", ["risk"])
    assert tables.read_predictions(spark, path, ["entity", "index_date"], ["y", "risk"]).count() == 20
    dataset(spark).withColumn("risk", F.lit(0.1)).write.mode("append").parquet(path)
    with pytest.raises(ContractError):
        tables.read_predictions(spark, path, ["entity", "index_date"], ["risk"])


def test_only_completed_runs_are_read(spark, tmp_path):
    for name, done in (("r1", True), ("r2", False)):
        d = tmp_path / name
        d.mkdir()
        (d / "metrics.json").write_text(json.dumps({"run_id": name, "created": "2020", "kind": "k", "data_hash": "d", "rows_hash": "r",
                                                    "performance": {"test": {"raw": {"auroc": {"estimate": 0.7, "ci_low": 0.6, "ci_high": 0.8}}}}}, indent=1))
        if done:
            (d / "COMPLETED").write_text("ok\n")
    got = tables.read_runs(spark, str(tmp_path)).collect()
    assert [r.run_id for r in got] == ["r1"] and got[0].performance["test"]["raw"]["auroc"].estimate == 0.7


def test_second_evaluation_is_refused(spark, tmp_path):
    path = str(tmp_path / "reg")
    tables.register_evaluation(spark, path, "d", "r", "c", exists=False)
    tables.register_evaluation(spark, path, "d", "r", "c2")
    with pytest.raises(ContractError):
        tables.register_evaluation(spark, path, "d", "r", "c")


def test_unmapped_values_and_content(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(120)], "k string, v string")
    assert contracts.unmapped_values(df, {"k": {"0": "a"}}).count() == 119
    number = lambda rows: spark.createDataFrame(rows, "a string, b string").agg(content_number("a", "b")).first()[0]
    assert len({number([r]) for r in [("", None), (None, ""), ("1:x", "y"), ("1", "x|y"), ("", "")]}) == 5


def test_dataset_prunes_by_index_date_and_checks_on_request(spark, tmp_path):
    df = spark.sql("SELECT id AS entity_id, date_add(DATE'2020-01-01', cast(id % 3 AS int)) AS index_date, cast(id % 2 AS int) AS y FROM range(90)")
    tables.write_dataset(df, f"{tmp_path}/d", entity="entity_id", index="index_date", y="y", versions={"v": "1"})
    schema = "entity_id long, index_date date, y int, v string"
    back = tables.read_dataset(spark, f"{tmp_path}/d", schema, verify="content")
    assert back.columns == ["entity_id", "index_date", "y", "v"] and back.count() == 90
    one = back.where("index_date = DATE'2020-01-02'")
    assert len(one.inputFiles()) > 0 and all("index_date=2020-01-02" in f for f in one.select("_metadata.file_path").distinct().toPandas()["file_path"])
    assert "PartitionFilters: [isnotnull(index_date" in one._jdf.queryExecution().toString()


def test_header_of_quoted_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;"b;c";d\n1;2;3\n')
    assert tables.header(spark, f"{tmp_path}/t.csv", "csv", sep=";") == ["a", "b;c", "d"]
