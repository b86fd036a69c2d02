"""A wide extract per (entity, index date) derived from the shared tables, with real NULLs and records after the index day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.queries import roles
from asofkit.queries.registry import Tables


def wide(t: Tables) -> DataFrame:
    idx = roles.index_table(t)
    o = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("date").alias("od"), F.col("o_totalprice").alias("price"),
                        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    off = F.date_diff("index_date", "od")
    past = idx.join(o, "entity_id").where(off.between(-20, 400)).groupBy("entity_id", "index_date").agg(
        *[F.count_if(off.between(1, n)).alias(f"n{n}") for n in (30, 90, 180, 365)], F.max("od").alias("last_order_date"),
        F.avg(F.when(off.between(1, 365), F.col("price"))).alias("mean_price"), F.count_if(off.between(1, 365) & F.col("urgent")).alias("n_urgent"))
    r = roles.order_lines(t).where("l_returnflag = 'R'").select(F.col("o_custkey").alias("entity_id"), "sd")
    ahead = F.date_diff("sd", "index_date")
    future = idx.join(r, "entity_id").where(ahead.between(1, 180)).groupBy("entity_id", "index_date").agg(F.min("sd").alias("first_sd"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_code"), F.col("n_name").alias("nation_name"), F.col("c_acctbal").alias("balance"))
    w = idx.join(c, "entity_id").join(past, ["entity_id", "index_date"], "left").join(future, ["entity_id", "index_date"], "left")
    censored = F.col("segment") == "FURNITURE"
    event = F.when(~censored, F.col("first_sd"))
    bal = F.floor(F.abs("balance"))
    return w.select(
        "entity_id", "index_date", *[F.coalesce(f"n{n}", F.lit(0)).alias(f"n{n}") for n in (30, 90, 180, 365)], "last_order_date",
        F.date_diff("index_date", "last_order_date").alias("days_since"), "mean_price", F.when(F.col("n365") > 0, F.col("n_urgent")).alias("n_urgent"),
        "segment", "nation_code", "nation_name", "balance", (F.col("nation_code") != 7).cast("int").alias("eligible"),
        F.when(~censored, F.col("first_sd").isNotNull().cast("int")).alias("y"), event.alias("event_date"), F.date_diff(event, "index_date").alias("days_to_event"),
        F.date_add("index_date", 180).alias("window_end"),
        F.when(F.col("balance") < 500, F.date_add("index_date", 100)).when(F.col("nation_code") == 3, F.lit("2999-12-31").cast("date")).alias("followup_end"),
        F.when(F.col("balance") < 2000, F.date_add("index_date", (bal % 300).cast("int"))).alias("death_date"),
        F.when(F.year("index_date") == 1997, "train").when(F.year("index_date") == 1998, "validation").otherwise("test").alias("split"),
        F.lit("V1").alias("version"))


WIDE_SQL = f"""{roles.ROLES_SQL.split("persons AS (")[0].split("intervals AS (")[0].rstrip().rstrip(",")},
o1 AS (SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS od, o_totalprice AS price, o_orderpriority = '1-URGENT' AS urgent FROM orders),
past AS (SELECT i.entity_id, i.index_date, count_if(index_date - od BETWEEN 1 AND 30) AS n30, count_if(index_date - od BETWEEN 1 AND 90) AS n90, count_if(index_date - od BETWEEN 1 AND 180) AS n180,
 count_if(index_date - od BETWEEN 1 AND 365) AS n365, max(od) AS last_order_date, avg(price) FILTER (WHERE index_date - od BETWEEN 1 AND 365) AS mean_price,
 count_if(index_date - od BETWEEN 1 AND 365 AND urgent) AS n_urgent FROM idx i JOIN o1 USING (entity_id) WHERE index_date - od BETWEEN -20 AND 400 GROUP BY ALL),
fut AS (SELECT i.entity_id, i.index_date, min(CAST(l_shipdate AS DATE)) AS first_sd FROM idx i JOIN orders ON o_custkey = entity_id JOIN lineitem ON l_orderkey = o_orderkey
 WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) - index_date BETWEEN 1 AND 180 GROUP BY ALL),
wide AS (SELECT i.entity_id, i.index_date, coalesce(n30, 0) AS n30, coalesce(n90, 0) AS n90, coalesce(n180, 0) AS n180, coalesce(n365, 0) AS n365, last_order_date,
 i.index_date - last_order_date AS days_since, mean_price, CASE WHEN n365 > 0 THEN n_urgent END AS n_urgent, c_mktsegment AS segment, c_nationkey AS nation_code, n_name AS nation_name,
 c_acctbal AS balance, CAST(c_nationkey <> 7 AS INTEGER) AS eligible, CASE WHEN c_mktsegment <> 'FURNITURE' THEN CAST(first_sd IS NOT NULL AS INTEGER) END AS y,
 CASE WHEN c_mktsegment <> 'FURNITURE' THEN first_sd END AS event_date, CASE WHEN c_mktsegment <> 'FURNITURE' THEN first_sd - i.index_date END AS days_to_event,
 i.index_date + 180 AS window_end, CASE WHEN c_acctbal < 500 THEN i.index_date + 100 WHEN c_nationkey = 3 THEN DATE '2999-12-31' END AS followup_end,
 CASE WHEN c_acctbal < 2000 THEN i.index_date + CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 300 AS INTEGER) END AS death_date,
 CASE year(i.index_date) WHEN 1997 THEN 'train' WHEN 1998 THEN 'validation' ELSE 'test' END AS split, 'V1' AS version
 FROM idx i JOIN customer ON c_custkey = i.entity_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN past p ON p.entity_id = i.entity_id AND p.index_date = i.index_date
 LEFT JOIN fut f ON f.entity_id = i.entity_id AND f.index_date = i.index_date)
"""


def with_wide(body: str) -> str:
    text = body.strip()
    return f"WITH {WIDE_SQL} {text}" if text.upper().startswith("SELECT") else f"WITH {WIDE_SQL}, {text}"


def raw_text(t: Tables) -> DataFrame:
    """The line table as messy text: padded numbers, true/false, unreadable cells, several date layouts."""
    q = F.col("l_quantity").cast("long").cast("string")
    d = F.col("l_shipdate").cast("date")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.when(tax == 8, "n/a").when(tax == 7, F.concat(q, F.lit(".5"))).when(tax == 6, F.concat(F.lit(" "), q, F.lit(".0 "))).when(tax == 5, "").otherwise(q).alias("quantity"),
        F.when(tax <= 2, "true").when(tax <= 4, "False").when(tax == 5, "1.0").when(tax == 6, "maybe").otherwise("0").alias("flag"),
        F.when(tax == 8, F.lit("12,5")).when(tax == 7, "NULL?").otherwise((F.round(F.col("l_discount") * 100).cast("int")).cast("string")).alias("discount"),
        F.when(tax == 8, "00:00.0").when(tax == 7, F.date_format(d, "dd/MM/yyyy")).when(tax == 6, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:30.123+02:00")))
        .when(tax == 5, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 00:00:00"))).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("shipped"),
        F.when(tax == 8, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("l_returnflag"))).alias("status"))


RAW_SQL = """raw AS (SELECT l_orderkey AS order_id, l_linenumber AS line,
 CASE tax WHEN 8 THEN 'n/a' WHEN 7 THEN q || '.5' WHEN 6 THEN ' ' || q || '.0 ' WHEN 5 THEN '' ELSE q END AS quantity,
 CASE WHEN tax <= 2 THEN 'true' WHEN tax <= 4 THEN 'False' WHEN tax = 5 THEN '1.0' WHEN tax = 6 THEN 'maybe' ELSE '0' END AS flag,
 CASE WHEN tax = 8 THEN '12,5' WHEN tax = 7 THEN 'NULL?' ELSE CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) END AS discount,
 CASE tax WHEN 8 THEN '00:00.0' WHEN 7 THEN strftime(d, '%d/%m/%Y') WHEN 6 THEN strftime(d, '%Y-%m-%d') || 'T10:20:30.123+02:00' WHEN 5 THEN strftime(d, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(d, '%Y-%m-%d') END AS shipped,
 CASE WHEN tax = 8 THEN '  ' ELSE ' ' || l_returnflag END AS status, tax, d, l_returnflag, l_discount, l_quantity
 FROM (SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_shipdate AS DATE) AS d FROM lineitem)),
typed AS (SELECT order_id, line, tax, CASE WHEN tax IN (5, 7, 8) THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
 CASE WHEN tax <= 2 THEN 1 WHEN tax <= 4 THEN 0 WHEN tax = 5 THEN 1 WHEN tax = 6 THEN NULL ELSE 0 END AS flag,
 CASE WHEN tax >= 7 THEN NULL ELSE CAST(round(l_discount * 100) AS DOUBLE) END AS discount, CASE WHEN tax = 8 THEN NULL ELSE d END AS shipped,
 CASE WHEN tax = 8 THEN NULL ELSE l_returnflag END AS status FROM raw)"""
