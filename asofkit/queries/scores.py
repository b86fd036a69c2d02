"""Score tables derived from the shared tables: unique rows from ``orders``, many ties from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.queries.registry import Tables


def scored(t: Tables) -> DataFrame:
    price = F.floor("o_totalprice")
    y = (F.col("o_orderstatus") == "F").cast("long")
    lo = (1 + price % 70 + 20 * y) / F.lit(100.0)
    return t.orders.select(
        F.col("o_orderkey").alias("row_key"), F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 5).alias("fold"), y.alias("y"),
        lo.alias("p"), ((1 + F.floor(price / 7) % 80 + 10 * y) / F.lit(100.0)).alias("p_ref"),
        lo.alias("lo"), F.least(F.lit(0.99), (6 + price % 70 + 20 * y) / F.lit(100.0)).alias("hi"),
        F.col("o_orderdate").cast("date").alias("index_date"), F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))


def scored_lines(t: Tables) -> DataFrame:
    y = (F.col("l_returnflag") == "R").cast("long")
    return t.lineitem.select(
        y.alias("y"), ((F.col("l_quantity").cast("long") * 2 + F.floor("l_extendedprice") % 13 + 6 * y + 1) / F.lit(125.0)).alias("p"),
        F.col("l_orderkey").alias("entity_id"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("date").alias("index_date"))


SCORED_SQL = """
scored AS (SELECT *, least(0.99, (6 + q + 20 * y) / 100.0) AS hi, (1 + q + 20 * y) / 100.0 AS lo, (1 + q + 20 * y) / 100.0 AS p, (1 + r + 10 * y) / 100.0 AS p_ref FROM
 (SELECT o_orderkey AS row_key, o_custkey AS entity_id, o_orderkey % 5 AS fold, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  CAST(floor(o_totalprice) AS BIGINT) % 70 AS q, (CAST(floor(o_totalprice) AS BIGINT) // 7) % 80 AS r, CAST(o_orderdate AS DATE) AS index_date,
  o_orderpriority AS priority, year(o_orderdate) AS year, o_totalprice AS price FROM orders)),
lscored AS (SELECT *, (CAST(quantity AS BIGINT) * 2 + CAST(floor(price) AS BIGINT) % 13 + 6 * y + 1) / 125.0 AS p FROM
 (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_orderkey AS entity_id, l_linestatus AS status, year(l_shipdate) AS year, l_quantity AS quantity,
  l_discount AS discount, l_tax AS tax, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS index_date FROM lineitem))
"""


def runs_sql(source: str, name: str = "runs", keys: str = "", p: str = "p", w: str = "1") -> str:
    """CTE with the running counts per distinct score of ``source``."""
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS cum_pos, sum(neg) OVER ({part} ORDER BY p DESC) AS cum_neg,
 sum(pos) OVER ({part}) AS tot_pos, sum(neg) OVER ({part}) AS tot_neg FROM
 (SELECT {sel}{p} AS p, CAST(sum({w} * y) AS DOUBLE) AS pos, CAST(sum({w} * (1 - y)) AS DOUBLE) AS neg FROM {source} GROUP BY ALL))"""


AUROC = "sum(pos * (tot_neg - cum_neg + neg / 2)) / nullif(max(tot_pos) * max(tot_neg), 0)"
AP = "sum(pos / nullif(tot_pos, 0) * cum_pos / nullif(cum_pos + cum_neg, 0))"
RATES = """tp + fp + fn + tn AS n, tp + fn AS events, tp + fp AS flagged, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity,
 tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv, fp / nullif(tp + fp, 0) AS false_alert_share, fp / nullif(fp + tn, 0) AS fpr,
 (tp + fp) / nullif(tp + fp + fn + tn, 0) AS flagged_share, (tp + fp) / nullif(tp, 0) AS flagged_per_capture,
 (tp / nullif(tp + fp, 0)) / nullif((tp + fn) / (tp + fp + fn + tn), 0) AS lift, 10000 * tp / (tp + fp + fn + tn) AS captured_per_10000"""
RATES_SPEC = "tp:l fp:l fn:l tn:l n:l events:l flagged:l sensitivity:f specificity:f ppv:f npv:f false_alert_share:f fpr:f flagged_share:f flagged_per_capture:f lift:f captured_per_10000:f"


def with_scores(body: str) -> str:
    """SQL with the score tables in front: ``body`` is 'cte AS (...), ... SELECT ...' or a plain SELECT."""
    text = body.strip()
    return f"WITH {SCORED_SQL} {text}" if text.upper().startswith("SELECT") else f"WITH {SCORED_SQL}, {text}"
