"""Registered queries against their SQL. Set ASOFKIT_ALL=1 to run every query, else one per family."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from asofkit.queries import load_all

FOLDER = "/root/testdata/sf0.001"
FAMILIES = ["pit_features", "record_rejections", "nearest_match", "auroc_average_precision", "capacity_table", "fold_capacity_curve", "bootstrap_replicates", "temporal_split", "rule_battery",
            "coercion_counts", "numeric_profile", "null_classes", "population_stability", "timing_diagnostic", "snapshot_audit", "recovery_registry", "dependency_closure", "best_run_selection", "wide_to_modeling_rows"]
NAMES = sorted(n for n, q in load_all().items() if q.sql) if os.environ.get("ASOFKIT_ALL") else FAMILIES

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def clean(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None or (isinstance(r[i], float) and math.isnan(r[i])) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    q = load_all()[name]
    df = q.run(spark, FOLDER)
    cur = con.execute(q.oracle())
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert clean(df.columns, [tuple(r) for r in df.collect()]) == clean(columns, cur.fetchall())


def test_every_query_names_its_rows():
    for q in load_all().values():
        assert q.rows and q.spec
