"""The two-level as-of join: a hot entity is dealt to pieces, results stay, and dates reach the scan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.functions import dates
from asofkit.operators import pit

D = dt.date
DAYS = [D(2019, 1, 1) + dt.timedelta(days=i) for i in range(600)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(7)
    rows = [(e, D(2020, m, 1)) for e in range(40) for m in (1, 4, 7)]
    records = []
    for i in range(6000):
        entity = 3 if i % 2 else r.randrange(60)  # half of the records on one entity, a third of them on one day
        day = D(2020, 3, 3) if entity == 3 and i % 3 == 0 else r.choice(DAYS)
        records.append((entity, i % 97, i % 11, i % 5 > 0, day, r.choice([None, day, day + dt.timedelta(days=40)])))
    rows = spark.createDataFrame(rows, "entity_id long, index_date date")
    return rows, spark.createDataFrame(records, "entity_id long, item long, chapter int, is_drug boolean, record_date date, available_date date")


def plain(rows, records):
    ok = (F.col("record_date") < F.col("index_date")) & ~F.coalesce(F.col("available_date") >= F.col("index_date"), F.lit(False))
    return rows.join(records, "entity_id").where(ok)


def test_hot_entities_are_found_and_dealt(spark, tables):
    rows, records = tables
    hot = {r.entity_id: r._pieces for r in pit.hot_entities(records, share=20).collect()}
    assert set(hot) == {3} and 10 <= hot[3] <= 11  # pieces of about a twentieth of the records
    assert pit.hot_entities(records.limit(0)).collect() == []
    joined = pit.entity_join(rows, records, pit.hot_entities(records, share=20))
    assert joined.columns == ["entity_id", "index_date", "item", "chapter", "is_drug", "record_date", "available_date"]
    assert sorted(joined.collect(), key=str) == sorted(rows.join(records, "entity_id").select(*joined.columns).collect(), key=str)
    placed = records.join(F.broadcast(pit.hot_entities(records, share=20)), "entity_id").groupBy(F.pmod(F.xxhash64(*records.columns), F.col("_pieces"))).count().collect()
    assert max(r["count"] for r in placed) < 600  # 3050 records of entity 3, also those of its hot day, are spread


def test_features_equal_the_plain_join(spark, tables):
    rows, records = tables
    window = pit.drug_in_window(120, (3,))
    want = {tuple(r) for r in plain(rows, records).where(window).groupBy(*pit.ROW).agg(F.count_distinct("item")).collect()}
    for since in (None, dates.window_start("index_date", days=120)):
        pairs = pit.usable_records(rows, records, since=since)
        got = {tuple(r) for r in pit.distinct_items(pairs, window_days=120, excluded_chapters=(3,)).collect()}
        assert got == want and len(want) > 90
    counted = pit.rejection_counts({"t": pit.record_pairs(rows, records)}).collect()
    every = rows.join(records, "entity_id")
    late = every.where("record_date >= index_date").count()
    assert {r.reason: r.n for r in counted} == {"record_on_or_after_index": late, "available_on_or_after_index": every.where("record_date < index_date AND available_date >= index_date").count()}
    assert pit.usable_records(rows.limit(0), records).collect() == []


def test_membership_of_a_hot_entity(spark):
    persons = spark.createDataFrame([(1, D(2000 + i // 12, 1 + i % 12, 1), D(2000 + i // 12, 1 + i % 12, 28), f"s{i}") for i in range(240)] + [(2, D(2001, 1, 1), None, "x"), (4, None, None, "y")], "entity_id long, start_date date, end_date date, site string")
    index = spark.createDataFrame([(e, D(2005, 6, d)) for e in (1, 2, 3, 4) for d in (5, 30)], "entity_id long, index_date date")
    got = {(r.entity_id, r.index_date.day): (r.has_person, r.covers, r.site) for r in pit.as_of_membership(index, persons).collect()}
    assert got[1, 5] == (True, True, "s65") and got[1, 30] == (True, False, "s0")
    assert got[2, 5] == (True, True, "x") and got[3, 5][0] is False and got[4, 5][0] is True


def test_plan_combines_before_the_shuffle_and_prunes_by_date(spark, tables, tmp_path):
    rows, records = tables
    records.write.partitionBy("record_date").parquet(f"{tmp_path}/by_date")
    records.write.parquet(f"{tmp_path}/plain")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.maxMetadataStringLength")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        for place, wanted in (("by_date", ("PartitionFilters: [isnotnull(record_date",)), ("plain", ("LessThan(record_date,2020-07-01)", "GreaterThanOrEqual(record_date,2019-09-03)"))):
            pairs = pit.usable_records(rows, spark.read.parquet(f"{tmp_path}/{place}"), since=dates.window_start("index_date", days=120))
            plan = pit.distinct_items(pairs, window_days=120)._jdf.queryExecution().executedPlan().toString().splitlines()
            join = next(i for i, line in enumerate(plan) if "SortMergeJoin [entity_id" in line and "_piece" in line)
            above = [line for line in plan[:join] if "Exchange" in line or "HashAggregate" in line]
            assert "HashAggregate" in above[-1] and any("Exchange hashpartitioning(entity_id" in line and "index_date" in line for line in above)
            assert all(w in "\n".join(plan) for w in wanted)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_without_a_row_are_not_shuffled(spark, tmp_path):
    """The rows' entities reach the side of a record that has the entity, below the join that makes the record."""
    spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 10).alias("entity_id"), F.expr("if(id % 8 = 0, NULL, DATE '2019-12-01')").alias("record_date")).write.parquet(f"{tmp_path}/heads")
    spark.range(120).select((F.col("id") % 40).alias("k"), (F.col("id") % 7).alias("item"), F.lit(None).cast("date").alias("available_date")).write.parquet(f"{tmp_path}/lines")
    records = spark.read.parquet(f"{tmp_path}/lines").join(spark.read.parquet(f"{tmp_path}/heads"), "k").select("entity_id", "item", "record_date", "available_date")
    rows = spark.createDataFrame([(e, D(2020, 1, d)) for e in (2, 3, None, 77) for d in (1, 9)], "entity_id long, index_date date")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        pairs = pit.record_pairs(rows, records)
        plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
        made = next(i for i, line in enumerate(plan) if "SortMergeJoin [k" in line)
        assert any("Filter" in line and "ubquery" in line for line in plan[made + 1:]) and "lambda" not in "".join(plan)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = rows.join(records, "entity_id")
    assert sorted(map(str, pairs.drop("reject_reason").collect())) == sorted(map(str, want.select(*pairs.drop("reject_reason").columns).collect())) and want.count() == 48
