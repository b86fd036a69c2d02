"""Contract queries: coercion, dates, validation, the rule battery, mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import dates, hashing, scalars, stats, suppress
from asofkit.operators import contracts
from asofkit.operators.contracts import ColumnRule, Contract, FeatureRule, Rule
from asofkit.queries.registry import query
from asofkit.queries.wide import RAW_SQL, raw_text, wide, with_wide

RAW = Contract((
    ColumnRule("order_id", "integer", nullable=False, role="IDENTIFIER", semantic="identifier"), ColumnRule("line", "integer", nullable=False),
    ColumnRule("quantity", "integer", semantic="count"), ColumnRule("flag", "integer", allowed=("0", "1"), semantic="binary"),
    ColumnRule("discount", "decimal"), ColumnRule("shipped", "date"), ColumnRule("status", "text", allowed=("A", "R"), semantic="categorical")),
    date_formats=("yyyy-MM-dd", "dd/MM/yyyy"))


@query("coerced_lines", "P01 P03 P05 S05", "quantity:l flag:l discount:f shipped:d status:s n:l", f"WITH {RAW_SQL} SELECT quantity, flag, discount, shipped, status, count(*) AS n FROM typed GROUP BY ALL")
def _(t):
    return contracts.coerce(raw_text(t), RAW).groupBy("quantity", "flag", "discount", "shipped", "status").agg(F.count(F.lit(1)).alias("n"))


@query("coercion_counts", "P01 S10 C05", "column_name:s observed:l wrong_type:l out_of_list:l nulls:l", f"""WITH {RAW_SQL},
j AS (SELECT r.quantity AS rq, r.flag AS rf, r.discount AS rd, r.shipped AS rs, r.tax, r.l_returnflag, r.d FROM raw r)
SELECT 'order_id' AS column_name, count(*) AS observed, 0 AS wrong_type, 0 AS out_of_list, 0 AS nulls FROM raw
UNION ALL SELECT 'line', count(*), 0, 0, 0 FROM raw
UNION ALL SELECT 'quantity', count_if(tax <> 5), count_if(tax IN (7, 8)), 0, count_if(tax IN (5, 7, 8)) FROM j
UNION ALL SELECT 'flag', count(*), count_if(tax = 6), 0, count_if(tax = 6) FROM j
UNION ALL SELECT 'discount', count(*), count_if(tax >= 7), 0, count_if(tax >= 7) FROM j
UNION ALL SELECT 'shipped', count(*), count_if(tax = 8), 0, count_if(tax = 8) FROM j
UNION ALL SELECT 'status', count_if(tax <> 8), 0, count_if(tax <> 8 AND l_returnflag = 'N'), count_if(tax = 8) FROM j""")
def _(t):
    return contracts.coercion_counts(raw_text(t), RAW)


@query("cell_problem_masks", "S10", "quantity__unreadable:b flag__unreadable:b flag__not_allowed:b discount__unreadable:b shipped__unreadable:b status__not_allowed:b n:l", f"""WITH {RAW_SQL}
SELECT tax IN (7, 8) AS quantity__unreadable, tax = 6 AS flag__unreadable, false AS flag__not_allowed, tax >= 7 AS discount__unreadable, tax = 8 AS shipped__unreadable,
 tax <> 8 AND l_returnflag = 'N' AS status__not_allowed, count(*) AS n FROM raw GROUP BY ALL""")
def _(t):
    m = contracts.problem_masks(raw_text(t), RAW, ["order_id", "line"])
    cols = ["quantity__unreadable", "flag__unreadable", "flag__not_allowed", "discount__unreadable", "shipped__unreadable", "status__not_allowed"]
    return m.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("date_formats_used", "P02", "column_name:s date_format:s n:l", f"""WITH {RAW_SQL}
SELECT 'shipped' AS column_name, CASE WHEN tax = 7 THEN 'dd/MM/yyyy' ELSE 'yyyy-MM-dd' END AS date_format, count(*) AS n FROM raw WHERE tax <> 8 GROUP BY ALL""")
def _(t):
    return contracts.date_formats_used(raw_text(t), RAW)


@query("failed_value_shapes", "P19 C07", "column_name:s shape:s n:l", f"""WITH {RAW_SQL}
SELECT 'quantity' AS column_name, 'a/a' AS shape, count(*) AS n FROM raw WHERE tax = 8 UNION ALL
SELECT 'quantity', regexp_replace(quantity, '[0-9]', '9', 'g'), count(*) FROM raw WHERE tax = 7 GROUP BY 2 UNION ALL
SELECT 'flag', 'aaa…', count(*) FROM raw WHERE tax = 6 UNION ALL SELECT 'discount', '99,9', count(*) FROM raw WHERE tax = 8 UNION ALL
SELECT 'discount', 'aaa…?', count(*) FROM raw WHERE tax = 7 UNION ALL SELECT 'shipped', '99:99.9', count(*) FROM raw WHERE tax = 8""")
def _(t):
    return contracts.failed_shapes(raw_text(t), RAW)


WIDE = Contract((
    ColumnRule("entity_id", "integer", nullable=False, role="IDENTIFIER"), ColumnRule("index_date", "date", nullable=False, role="IDENTIFIER", timing="at_index"),
    ColumnRule("n30", "integer", nullable=False, semantic="count"), ColumnRule("n90", "integer", nullable=False, semantic="count"), ColumnRule("n365", "integer", semantic="count"),
    ColumnRule("last_order_date", "date"), ColumnRule("mean_price", "decimal", nullable=False), ColumnRule("segment", "text", allowed=("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")),
    ColumnRule("y", "integer", role="LABEL", timing="post_index", allowed=("0", "1")), ColumnRule("followup_end", "date", role="LABEL", timing="post_index", sentinels=("2999-12-31",), sentinel_to_null=True),
    ColumnRule("death_date", "date", role="LABEL", timing="post_index")), constants={"version": "V1"})


@query("sentinel_dates", "P04", "column_name:s observed:l first_date:d last_date:d sentinels:l undeclared_far:l", with_wide("""
SELECT 'index_date' AS column_name, count(index_date) AS observed, min(index_date) AS first_date, max(index_date) AS last_date, 0 AS sentinels, 0 AS undeclared_far FROM wide UNION ALL
SELECT 'last_order_date', count(last_order_date), min(last_order_date), max(last_order_date), 0, 0 FROM wide UNION ALL
SELECT 'followup_end', count(followup_end), min(followup_end) FILTER (WHERE followup_end <> DATE '2999-12-31'), max(followup_end) FILTER (WHERE followup_end <> DATE '2999-12-31'),
 count_if(followup_end = DATE '2999-12-31'), 0 FROM wide UNION ALL SELECT 'death_date', count(death_date), min(death_date), max(death_date), 0, 0 FROM wide"""))
def _(t):
    return contracts.sentinel_report(wide(t), WIDE)


@query("sentinels_to_null", "P04", "split:s open_end:l with_end:l", with_wide("SELECT split, count_if(followup_end IS NULL OR followup_end = DATE '2999-12-31') AS open_end, count_if(followup_end <> DATE '2999-12-31') AS with_end FROM wide GROUP BY 1"))
def _(t):
    w = contracts.resolve_sentinels(wide(t), WIDE)
    return w.groupBy("split").agg(F.count_if(F.col("followup_end").isNull()).alias("open_end"), F.count("followup_end").alias("with_end"))


@query("contract_validation", "A58 U03", "column_name:s check_name:s n:l level:s", with_wide("""
c AS (SELECT 'entity_id' AS column_name, 'null_in_not_null' AS check_name, count_if(entity_id IS NULL) AS n FROM wide UNION ALL SELECT 'index_date', 'null_in_not_null', count_if(index_date IS NULL) FROM wide UNION ALL
SELECT 'index_date', 'undeclared_far_date', count_if(index_date >= DATE '2100-01-01') FROM wide UNION ALL SELECT 'n30', 'null_in_not_null', count_if(n30 IS NULL) FROM wide UNION ALL
SELECT 'n90', 'null_in_not_null', count_if(n90 IS NULL) FROM wide UNION ALL SELECT 'last_order_date', 'undeclared_far_date', count_if(last_order_date >= DATE '2100-01-01') FROM wide UNION ALL
SELECT 'mean_price', 'null_in_not_null', count_if(mean_price IS NULL) FROM wide UNION ALL SELECT 'segment', 'not_allowed', count_if(segment = 'FURNITURE') FROM wide UNION ALL
SELECT 'y', 'not_allowed', count_if(y NOT IN (0, 1)) FROM wide UNION ALL SELECT 'followup_end', 'undeclared_far_date', 0 UNION ALL SELECT 'death_date', 'undeclared_far_date', 0 UNION ALL
SELECT 'version', 'not_constant', 0)
SELECT *, CASE WHEN n = 0 THEN 'ok' WHEN column_name = 'mean_price' THEN 'problem' ELSE 'warning' END AS level FROM c"""))
def _(t):
    return contracts.validate_contract(wide(t), WIDE, strict=["mean_price"])


@query("modeling_row_validation", "A57", "check_name:s n:l", with_wide("""
SELECT 'null_index_date' AS check_name, 0 AS n UNION ALL SELECT 'evidence_on_or_after_index', count_if(last_order_date >= index_date) FROM wide UNION ALL SELECT 'null_outcome', count_if(y IS NULL) FROM wide UNION ALL
SELECT 'illegal_outcome', 0 UNION ALL SELECT 'positive_without_event_date', count_if(y = 1 AND event_date IS NULL) FROM wide UNION ALL SELECT 'negative_with_event_date', count_if(y = 0 AND event_date IS NOT NULL) FROM wide UNION ALL
SELECT 'event_outside_window', count_if(event_date < index_date OR event_date > index_date + 179) FROM wide UNION ALL SELECT 'null_key:entity_id', 0 UNION ALL
SELECT 'null:eligible', 0 UNION ALL SELECT 'illegal:eligible', 0 UNION ALL SELECT 'null:mean_price', count_if(mean_price IS NULL) FROM wide UNION ALL SELECT 'not_finite:mean_price', 0 UNION ALL
SELECT 'below_minimum:mean_price', count_if(mean_price < 50000) FROM wide UNION ALL SELECT 'above_maximum:mean_price', count_if(mean_price > 400000) FROM wide UNION ALL
SELECT 'null:segment', 0 UNION ALL SELECT 'undeclared_level:segment', count_if(segment = 'FURNITURE') FROM wide UNION ALL SELECT 'not_constant:version', 0 UNION ALL SELECT 'duplicated_key_rows', 0"""))
def _(t):
    return contracts.validate_modeling_rows(
        wide(t), [FeatureRule("eligible", "binary"), FeatureRule("mean_price", "float", low=50000, high=400000), FeatureRule("segment", "categorical", levels=("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"))],
        keys=["entity_id"], index="index_date", latest="last_order_date", y="y", event="event_date", window_days=180, constants=["version"])


BATTERY = [
    *contracts.contract_rules(WIDE, "index_date"), contracts.nested_windows_rule("E01:orders", ["n30", "n90", "n180", "n365"]), *contracts.days_rules("orders", "last_order_date", "days_since", "index_date"),
    *contracts.label_rules("y", "event_date", "days_to_event", "index_date", "window_end"), Rule("E03:flag", "consistency", "WARNING", "urgent orders without orders", ("n_urgent", "n365"), "n_urgent > n365"),
    Rule("D02:balance", "numeric", "CRITICAL", "implausible balance", ("balance",), "balance < 0 OR balance > 9000"), Rule("C09:followup", "temporal", "WARNING", "follow-up ends before the event", ("followup_end", "event_date"), "followup_end < event_date", "event_date IS NOT NULL"),
    Rule("G07:absent", "provenance", "INFO", "column not exported", ("confidence",), "confidence = 'LOW'"),
]
_BATTERY_SQL = " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS sev, "
    + ("NULL AS n, NULL AS d" if "confidence" in r.columns else
       f"count_if(coalesce({(r.predicate.replace('datediff(index_date, last_order_date)', '(index_date - last_order_date)').replace('datediff(event_date, index_date)', '(event_date - index_date)').replace('AS STRING', 'AS VARCHAR').replace('<=>', 'IS NOT DISTINCT FROM'))}, false)) AS n, count_if(coalesce({r.denominator}, false)) AS d FROM wide") for r in BATTERY)


@query("rule_battery", "A39 A40", "rule_id:s category:s severity:s status:s n:l pct:f", with_wide(f"""b AS ({_BATTERY_SQL})
SELECT rule_id, category, CASE WHEN n > 0 THEN sev END AS severity, CASE WHEN n IS NULL THEN 'NOT_APPLICABLE' WHEN n > 0 THEN 'FINDING' ELSE 'PASS' END AS status,
 CASE WHEN n > 0 AND n < 10 THEN NULL ELSE n END AS n, CASE WHEN d > 0 AND NOT (n > 0 AND n < 10) THEN 100.0 * n / d END AS pct FROM b"""))
def _(t):
    return contracts.run_rules(wide(t), BATTERY, min_cell=10)


@query("one_to_one_check", "A41", "direction:s n:l", with_wide("""
SELECT 'nation_code->nation_name' AS direction, count_if(k > 1) AS n FROM (SELECT nation_code, count(DISTINCT nation_name) AS k FROM wide GROUP BY 1) UNION ALL
SELECT 'nation_name->nation_code', count_if(k > 1) FROM (SELECT nation_name, count(DISTINCT nation_code) AS k FROM wide GROUP BY 1)"""))
def _(t):
    return contracts.one_to_one(wide(t), "nation_code", "nation_name")


@query("duplicate_line_keys", "S12 A57", "keys:l extra_rows:l", "SELECT count(*) AS keys, sum(n - 1) AS extra_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def _(t):
    return contracts.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("event_table_validation", "A59", "check_name:s n:l", """
SELECT 'available_before_record' AS check_name, count_if(l_shipdate < o_orderdate) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
SELECT 'null_record_date', count_if(o_orderdate IS NULL) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
SELECT 'bad_item_code', count_if(NOT regexp_full_match(p_brand, 'Brand#[0-9]{2}')) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey UNION ALL
SELECT 'value_not_positive', count_if(l_quantity <= 0) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    checks = [Rule("available_before_record", "time", "WARNING", "", (), "l_shipdate < o_orderdate"), Rule("null_record_date", "time", "WARNING", "", (), "o_orderdate IS NULL"),
              Rule("bad_item_code", "code", "WARNING", "", (), "NOT p_brand RLIKE '^Brand#[0-9]{2}$'"), Rule("value_not_positive", "value", "WARNING", "", (), "l_quantity <= 0")]
    return contracts.run_rules(j, checks).select(F.col("rule_id").alias("check_name"), "n")


@query("attribute_constancy", "A59", "varying_entities:l entities:l", "SELECT count_if(n > 1) AS varying_entities, count(*) AS entities FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    return per.agg(F.count_if(F.col("a") != F.col("b")).alias("varying_entities"), F.count(F.lit(1)).alias("entities"))


# ------------------------------------------------------------------ scalar functions
STATUS_MAP = {"F": "final", "O": "open"}


@query("recode_and_unmapped", "P06 P13", "target:s n:l", "SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS target, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(scalars.recode("o_orderstatus", STATUS_MAP).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("unmapped_values", "P06", "value:s n:l", "SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def _(t):
    return scalars.unmapped(t.orders, "o_orderstatus", STATUS_MAP)


@query("mapped_features", "P13 P14 P51", "entity_id:l index_date:d any_urgent:l count_value:l below:l at_least:l days:l present:b unexplained:l", with_wide("""
SELECT entity_id, index_date, CASE WHEN n_urgent IS NULL AND mean_price IS NULL THEN NULL ELSE CAST(coalesce(n_urgent > 0, false) OR coalesce(mean_price > 0, false) AS INTEGER) END AS any_urgent,
 CASE WHEN n_urgent IS NULL AND n365 = 0 THEN 0 ELSE n_urgent END AS count_value, CAST(mean_price < 200000 AS INTEGER) AS below, CAST(mean_price >= 200000 AS INTEGER) AS at_least,
 index_date - last_order_date AS days, last_order_date IS NOT NULL AS present, 0 AS unexplained FROM wide"""))
def _(t):
    w = wide(t).withColumn("absent", (F.col("n365") == 0).cast("int"))
    return w.select("entity_id", "index_date", scalars.any_positive(["n_urgent", "mean_price"]).alias("any_urgent"), scalars.explained_count("n_urgent", "absent").alias("count_value"),
                    scalars.flag_below("mean_price", 200000).alias("below"), scalars.flag_at_least("mean_price", 200000).alias("at_least"), dates.days_since("last_order_date", "index_date").alias("days"),
                    F.col("last_order_date").isNotNull().alias("present"), F.lit(0).alias("unexplained"))


@query("unexplained_null_count", "P13", "unexplained:l explained:l", with_wide("SELECT count_if(n_urgent IS NULL AND n365 > 0) AS unexplained, count_if(n_urgent IS NULL AND n365 = 0) AS explained FROM wide"))
def _(t):
    w = wide(t).withColumn("absent", (F.col("n365") == 0).cast("int"))
    return w.agg(scalars.unexplained_nulls("n_urgent", "absent").alias("unexplained"), F.count_if(F.col("n_urgent").isNull() & (F.col("absent") == 1)).alias("explained"))


@query("recorded_values", "P15", "split:s prices:l dates:l texts:l", with_wide("SELECT split, count_if(coalesce(mean_price <> 0, false)) AS prices, count(last_order_date) AS dates, count_if(trim(segment) <> '') AS texts FROM wide GROUP BY 1"))
def _(t):
    return wide(t).groupBy("split").agg(F.count_if(scalars.recorded("mean_price", "double")).alias("prices"), F.count_if(scalars.recorded("last_order_date", "date")).alias("dates"),
                                        F.count_if(scalars.recorded("segment", "string")).alias("texts"))


@query("pseudonymous_keys", "P16 P17 P18", "entity_id:l long_key:s short_key:s name:s", """
SELECT c_custkey AS entity_id, substr(sha256('pepper|' || CAST(c_custkey AS VARCHAR)), 1, 20) AS long_key, substr(sha256('blind|' || CAST(c_custkey AS VARCHAR)), 1, 24) AS short_key,
 regexp_replace(lower(c_name), '[^0-9a-z]+', '_', 'g') AS name FROM customer""")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("entity_id"), hashing.secret_key("pepper", "c_custkey", 20).alias("long_key"), hashing.secret_key("blind", "c_custkey", 24).alias("short_key"),
                             scalars.slug("c_name").alias("name"))


@query("value_shapes", "P19", "shape:s n:l", """SELECT regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g'), 'a{4,}', 'aaa…', 'g') AS shape, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    return t.part.groupBy(scalars.text_shape("p_name").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("code_normalisation", "P20", "code:s system:s normal:s ok:b n:l", """
c AS (SELECT CASE WHEN l_linenumber = 1 THEN ' e88' || l_linenumber || '.0 ' WHEN l_linenumber = 2 THEN 's72.' || CAST(CAST(l_quantity AS BIGINT) % 10 AS VARCHAR) WHEN l_linenumber = 3 THEN 'W19' ELSE '82' || CAST(l_linenumber AS VARCHAR) || '.1' END AS code,
 CASE WHEN l_linestatus = 'F' THEN 'ICD-9-CM' ELSE 'ICD-10' END AS system FROM lineitem)
SELECT code, system, upper(trim(replace(code, '.', ''))) AS normal, NOT contains(code, '.') OR CASE system WHEN 'ICD-9-CM' THEN regexp_full_match(split_part(upper(trim(code)), '.', 1), 'E[0-9]{3}|V[0-9]{2}|[0-9]{3}')
 ELSE regexp_full_match(split_part(upper(trim(code)), '.', 1), '[A-Z][0-9]{2}') END AS ok, count(*) AS n FROM c GROUP BY ALL""".replace("\nc AS", "WITH c AS", 1))
def _(t):
    n = F.col("l_linenumber").cast("string")
    code = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" e88"), n, F.lit(".0 "))).when(F.col("l_linenumber") == 2, F.concat(F.lit("s72."), (F.col("l_quantity").cast("long") % 10).cast("string")))
            .when(F.col("l_linenumber") == 3, "W19").otherwise(F.concat(F.lit("82"), n, F.lit(".1"))))
    c = t.lineitem.select(code.alias("code"), F.when(F.col("l_linestatus") == "F", "ICD-9-CM").otherwise("ICD-10").alias("system"))
    return c.groupBy("code", "system").agg(F.count(F.lit(1)).alias("n")).withColumns({"normal": scalars.normalise_code("code"), "ok": scalars.well_formed("code", "system")})


@query("code_range_expansion", "P21", "codes:s prefix:s parts:l", """
WITH r AS (SELECT codes, unnest(generate_series(lo, hi)) AS i, lo FROM (SELECT DISTINCT 'B' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '-B' || lpad(CAST(p_size + 2 AS VARCHAR), 3, '0') AS codes, p_size AS lo, p_size + 2 AS hi FROM part)),
e AS (SELECT codes, 'B' || lpad(CAST(i AS VARCHAR), 3, '0') AS prefix FROM r)
SELECT codes, prefix, count(p_partkey) AS parts FROM e LEFT JOIN part ON prefix = 'B' || lpad(CAST(p_size AS VARCHAR), 3, '0') GROUP BY ALL""")
def _(t):
    size = lambda add: F.lpad((F.col("p_size") + add).cast("string"), 3, F.lit("0"))
    ranges = t.part.select(F.concat(F.lit("B"), size(0), F.lit("-B"), size(2)).alias("codes")).distinct()
    rules = scalars.expand_code_ranges(ranges)
    parts = t.part.groupBy(F.concat(F.lit("B"), size(0)).alias("prefix")).agg(F.count(F.lit(1)).alias("k"))
    return rules.join(parts, "prefix", "left").select("codes", "prefix", F.coalesce("k", F.lit(0)).alias("parts"))


@query("category_bands", "P22 P32 P33 P34", "category:s age_band:s level:s n:l", with_wide("""
SELECT CASE WHEN days_since IS NULL THEN 'missing' WHEN days_since < 18.5 THEN 'underweight' WHEN days_since < 25 THEN 'normal' WHEN days_since < 30 THEN 'overweight' ELSE 'obese' END AS category,
 CASE WHEN balance < 2000 THEN '<2000' WHEN balance < 5000 THEN '2000-4999' ELSE '5000+' END AS age_band, CASE WHEN y IS NULL THEN 'unknown' WHEN y = 1 THEN 'yes' ELSE 'no' END AS level, count(*) AS n FROM wide GROUP BY ALL"""))
def _(t):
    w = wide(t)
    level = F.when(F.col("y").isNull(), "unknown").when(F.col("y") == 1, "yes").otherwise("no")
    return w.groupBy(scalars.body_category("days_since").alias("category"), scalars.band("balance", [2000.0, 5000.0], ["<2000", "2000-4999", "5000+"]).alias("age_band"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("log_count_term", "P23", "n365:l term:f", with_wide("SELECT n365, ln((n365 + 1) / 10.0) AS term FROM wide GROUP BY ALL"))
def _(t):
    return wide(t).select("n365").distinct().withColumn("term", scalars.log_count("n365"))


@query("linear_encodings", "P25 P28 P29", "entity_id:l index_date:d seg_building:f seg_missing:f ge_1:f ge_2:f recent:f old:f logn:f", with_wide("""
SELECT entity_id, index_date, CAST(segment = 'BUILDING' AS INTEGER) AS seg_building, CAST(segment = 'MACHINERY' AS INTEGER) AS seg_missing, CAST(n365 >= 1 AS INTEGER) AS ge_1, CAST(n365 >= 2 AS INTEGER) AS ge_2,
 CAST(coalesce(days_since >= 0 AND days_since < 90, false) AS INTEGER) AS recent, CAST(coalesce(days_since >= 180, false) AS INTEGER) AS old, ln(1 + greatest(n365, 0)) AS logn FROM wide"""))
def _(t):
    hot = scalars.one_hot("segment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"], reference="AUTOMOBILE")
    th = scalars.thermometer("n365", [1, 2])
    rec = scalars.recency_bands("days_since", [90, 180])
    return wide(t).select("entity_id", "index_date", hot["segment__BUILDING"].alias("seg_building"), hot["segment__MACHINERY"].alias("seg_missing"), th["n365__ge_1"].alias("ge_1"), th["n365__ge_2"].alias("ge_2"),
                          rec["days_since__0_89"].alias("recent"), rec["days_since__180_plus"].alias("old"), scalars.log1p_encoded("n365").alias("logn"))


COEFS = {"n30": 0.3, "n365": -0.2, "balance_k": 0.05}


@query("fixed_equation_scores", "P27 P37 P39", "entity_id:l index_date:d lp:f8 risk:f recalibrated:f", with_wide("""
SELECT entity_id, index_date, -1.5 + 0.3 * n30 - 0.2 * n365 + 0.05 * balance / 1000 AS lp, 1 / (1 + exp(-(-1.5 + 0.3 * n30 - 0.2 * n365 + 0.05 * balance / 1000))) AS risk,
 1 / (1 + exp(-(-0.4 + 0.9 * (-1.5 + 0.3 * n30 - 0.2 * n365 + 0.05 * balance / 1000)))) AS recalibrated FROM wide"""))
def _(t):
    w = wide(t).withColumn("balance_k", F.col("balance") / 1000)
    lp = scalars.linear_predictor(-1.5, COEFS)
    return w.select("entity_id", "index_date", lp.alias("lp"), stats.expit(lp).alias("risk"), stats.expit(-0.4 + 0.9 * lp).alias("recalibrated"))


@query("top_contributions", "P40", "entity_id:l index_date:d place:l name:s value:f8 direction:s", with_wide("""
c AS (SELECT entity_id, index_date, 'n30' AS name, 0.3 * (n30 - 1) AS value FROM wide UNION ALL SELECT entity_id, index_date, 'n365', -0.2 * (n365 - 2) FROM wide UNION ALL SELECT entity_id, index_date, 'balance_k', CAST(0.05 AS DOUBLE) * (balance / 1000) FROM wide),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, index_date ORDER BY abs(value) DESC, name) AS place FROM c)
SELECT entity_id, index_date, place, name, value, CASE WHEN value > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM r WHERE place <= 2 AND value <> 0"""))
def _(t):
    w = wide(t).withColumn("balance_k", F.col("balance") / 1000)
    top = scalars.top_contributions(COEFS, {"n30": 1.0, "n365": 2.0}, 2)
    return w.select("entity_id", "index_date", F.posexplode(top).alias("pos", "e")).select("entity_id", "index_date", (F.col("pos") + 1).alias("place"), "e.name", "e.value", "e.direction")


@query("row_quality_flags", "P35", "flags:s n:l", with_wide("""
SELECT concat_ws(',', CASE WHEN mean_price IS NULL THEN 'missing:mean_price' END, CASE WHEN mean_price > 300000 THEN 'above_range:mean_price' END, CASE WHEN last_order_date >= index_date THEN 'post_index' END) AS flags, count(*) AS n FROM wide GROUP BY 1"""))
def _(t):
    flags = scalars.row_flags({"missing:mean_price": F.col("mean_price").isNull(), "above_range:mean_price": F.col("mean_price") > 300000, "post_index": F.col("last_order_date") >= F.col("index_date")})
    return wide(t).groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query("eligible_on_date", "P11 P12 U01", "index_date:d on_date:l eligible_rows:l labelled:l clean:l", with_wide("""
SELECT index_date, count(*) AS on_date, count_if(eligible = 1) AS eligible_rows, count_if(eligible = 1 AND y IS NOT NULL) AS labelled, count_if(eligible = 1 AND y IS NOT NULL AND NOT coalesce(last_order_date >= index_date, false)) AS clean
FROM wide WHERE index_date IN (DATE '1997-07-01', DATE '1999-07-01') GROUP BY 1"""))
def _(t):
    w = wide(t).where(F.col("index_date").isin(F.lit("1997-07-01").cast("date"), F.lit("1999-07-01").cast("date")))
    el = F.coalesce(F.col("eligible") == 1, F.lit(False))
    lab = el & F.col("y").isNotNull()
    return w.groupBy("index_date").agg(F.count(F.lit(1)).alias("on_date"), F.count_if(el).alias("eligible_rows"), F.count_if(lab).alias("labelled"),
                                       F.count_if(lab & ~F.coalesce(F.col("last_order_date") >= F.col("index_date"), F.lit(False))).alias("clean"))


@query("small_cell_suppression", "P41 P42 P43 P44 P45", "nation_name:s split:s n:l events:l rate:f suppressed:b shown_n:s", with_wide("""
c AS (SELECT nation_name, split, count(*) AS n, coalesce(sum(y), 0) AS events FROM wide GROUP BY ALL), f AS (SELECT *, (n BETWEEN 1 AND 29) OR (events BETWEEN 1 AND 29) AS s FROM c)
SELECT nation_name, split, CASE WHEN NOT s THEN n END AS n, CASE WHEN NOT s THEN events END AS events, CASE WHEN NOT s THEN events / n END AS rate, s AS suppressed,
 CASE WHEN n BETWEEN 1 AND 29 THEN '<30' ELSE CAST(n AS VARCHAR) END AS shown_n FROM f"""))
def _(t):
    c = wide(t).groupBy("nation_name", "split").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("events"))
    c = c.withColumn("rate", F.col("events") / F.col("n")).withColumn("shown_n", suppress.shown(F.col("n"), 30))
    return suppress.suppress_together(c, ["n", "events"], ["rate"], 30)
