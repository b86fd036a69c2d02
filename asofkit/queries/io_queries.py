"""Reading and writing: subsets of a schema, wide text, outcome columns, aggregate files, and the cell rules around them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from asofkit.functions import scalars, suppress
from asofkit.queries.registry import Tables, query
from asofkit.queries.scores import scored, with_scores
from asofkit.session import shared_folder
from asofkit.sources import tables


def scratch(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/io-{uuid.uuid4().hex}"


@query("subset_schema_scan", "S03", "segment:s n:l has_balance:b", "SELECT c_mktsegment AS segment, count(*) AS n, false AS has_balance FROM customer GROUP BY 1")
def _(t):
    path = f"{t.path}/customer.parquet"
    full = t.customer.schema.add("c_future", "string")  # a column that this extract does not have yet
    chosen = tables.subset_schema(tables.header(t.spark, path), full, ["c_custkey", "c_mktsegment"])
    df = t.spark.read.schema(chosen).parquet(path)
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).withColumn("has_balance", F.lit("c_acctbal" in df.columns))


@query("wide_text_cells", "S05 P05", "segment:s nation:s balance:s n:l", """
SELECT nullif(trim(c_mktsegment), '') AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance, count(*) AS n FROM customer GROUP BY ALL""")
def _(t):
    path = scratch(t)
    cells = t.customer.select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("c_mktsegment"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("c_nationkey"),
                              F.when(F.col("c_acctbal") < 0, "NULL").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("balance"))
    cells.write.option("header", True).option("sep", ";").csv(path)
    wide = tables.read_wide_text(t.spark, path, cells.columns, sep=";")
    return wide.groupBy(scalars.normalise_cell("c_mktsegment").alias("segment"), scalars.normalise_cell("c_nationkey").alias("nation"), "balance").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_only_scan", "S09", "y:l rows:l columns:l", with_scores("SELECT y, count(*) AS rows, 2 AS columns FROM scored GROUP BY 1"))
def _(t):
    outcomes = tables.outcome_only(scored(t), "row_key", ["y"])
    return outcomes.groupBy("y").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(outcomes.columns)))


@query("aggregate_file", "S14", "priority:s n:l basis:s watermark:s", with_scores("SELECT priority, count(*) AS n, 'all rows' AS basis, 'internal' AS watermark FROM scored GROUP BY 1"))
def _(t):
    path = scratch(t)
    tables.write_aggregate(scored(t).groupBy("priority").agg(F.count(F.lit(1)).alias("n")), path, basis="all rows", watermark="internal")
    return tables.read_csv(t.spark, path, "priority string, n long, basis string, watermark string")


@query("risk_categories", "P34", "category:s hidden:s n:l", with_scores("""
SELECT CASE WHEN p < 0.1 THEN 'low' WHEN p < 0.3 THEN 'middle' ELSE 'high' END AS category, NULL AS hidden, count(*) AS n FROM scored GROUP BY 1"""))
def _(t):
    cut = lambda approved: scalars.risk_category("p", [0.1, 0.3], ["low", "middle", "high"], approved=approved)
    return scored(t).groupBy(cut(True).alias("category"), cut(False).alias("hidden")).agg(F.count(F.lit(1)).alias("n"))


@query("suppressed_shares", "P43 P44", "nation:l n_rows:l n_negative:l share_negative:f suppressed:b", """
SELECT nation, CASE WHEN n BETWEEN 1 AND 4 THEN NULL ELSE n END AS n_rows, CASE WHEN g BETWEEN 1 AND 4 THEN NULL ELSE g END AS n_negative, CASE WHEN g BETWEEN 1 AND 4 THEN NULL ELSE g / n END AS share_negative,
 n BETWEEN 1 AND 4 OR g BETWEEN 1 AND 4 AS suppressed FROM (SELECT c_nationkey AS nation, count(*) AS n, count_if(c_acctbal < 0) AS g FROM customer GROUP BY 1)""")
def _(t):
    counts = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))
    shares = counts.withColumn("share_negative", F.col("n_negative") / F.col("n_rows"))
    derived = {"n_negative": ["share_negative"]}
    return suppress.suppress_counts(shares, {c: derived.get(c, []) for c in suppress.count_columns(shares, "^n_")}, 5)


@query("no_record_values", "P51", "entity_id:l flag:f level:f", """
SELECT c_custkey AS entity_id, coalesce(f, 0) AS flag, l AS level FROM customer LEFT JOIN (SELECT o_custkey AS k, max(CAST(o_orderstatus = 'P' AS INTEGER)) AS f, avg(o_totalprice) AS l FROM orders GROUP BY 1) ON k = c_custkey""")
def _(t):
    seen = t.orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max((F.col("o_orderstatus") == "P").cast("double")).alias("f"), F.avg("o_totalprice").alias("l"))
    return t.customer.select(F.col("c_custkey").alias("entity_id")).join(seen, "entity_id", "left").select(
        "entity_id", F.coalesce("f", scalars.no_record_value("binary", "absent")).alias("flag"), F.coalesce("l", scalars.no_record_value("continuous", "absent")).alias("level"))
