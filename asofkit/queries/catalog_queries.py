"""Catalogue queries: the columns of the wide extract described, classified and traced from the data themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators import catalog, profile, timing
from asofkit.queries.profile_queries import long_sql
from asofkit.queries.registry import Tables, query
from asofkit.queries.scores import AUROC, runs_sql
from asofkit.queries.wide import wide, with_wide

# name, role, timing, source, record date of the source
CATALOG = [
    ("n30", "PREDICTOR", "pre_index", "orders", "last_order_date"), ("n365", "PREDICTOR", "pre_index", "orders", "last_order_date"),
    ("mean_price", "PREDICTOR", "pre_index", "orders", "last_order_date"), ("n_urgent", "PREDICTOR", "unknown", "orders", "last_order_date"),
    ("balance", "PREDICTOR", "at_index", "customer", None), ("death_date", "FORBIDDEN", "post_index", "deaths", "death_date"),
    ("y", "LABEL", "post_index", "lines", None), ("event_date", "LABEL", "post_index", "lines", None), ("entity_id", "IDENTIFIER", "at_index", "customer", None),
]
COLS = [c[0] for c in CATALOG]
CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in c) + ")" for c in CATALOG) + ") v(column_name, role, timing, source, record_date))"


def cat(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(CATALOG, "column_name string, role string, timing string, source string, record_date string")


def features(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("recent", ["n30"], True), ("yearly", ["n365", "mean_price"], True), ("rush", ["n_urgent", "n365"], False), ("wealth", ["balance"], False), ("lost", ["gone"], True)],
                                   "feature string, inputs array<string>, mandatory boolean")


FEAT_SQL = """feat AS (SELECT * FROM (VALUES ('recent', 'n30'), ('yearly', 'n365'), ('yearly', 'mean_price'), ('rush', 'n_urgent'), ('rush', 'n365'), ('wealth', 'balance'), ('lost', 'gone')) v(feature, column_name))"""


def dated_counts(t: Tables) -> DataFrame:
    o = timing.offsets(wide(t), ["last_order_date", "death_date"], "index_date")
    return o.groupBy(F.col("column_name").alias("record_date")).agg(F.count_if(F.col("off") == 0).alias("n_on"), F.count_if(F.col("off") > 0).alias("n_after"))


COUNT_SQL = """cnt AS (SELECT 'last_order_date' AS record_date, count_if(last_order_date = index_date) AS n_on, count_if(last_order_date > index_date) AS n_after FROM wide UNION ALL SELECT 'death_date', count_if(death_date = index_date), count_if(death_date > index_date) FROM wide)"""
STATUS_SQL = f"""{CAT_SQL}, {COUNT_SQL}, st AS (SELECT cat.*, CASE WHEN role = 'FORBIDDEN' THEN 'UNSAFE' WHEN timing = 'post_index' THEN 'UNSAFE' WHEN timing = 'unknown' THEN 'UNRESOLVED' WHEN cat.record_date IS NULL THEN 'UNRESOLVED'
 WHEN n_on + n_after > 0 THEN 'UNSAFE' ELSE 'SAFE' END AS status, n_on, n_after FROM cat LEFT JOIN cnt ON cat.record_date = cnt.record_date)"""


@query("catalog_enrichment", "J16 J17 A71 A48", "column_name:s role:s source:s rows:l missing:l distinct:l features:s", with_wide(CAT_SQL + ", " + FEAT_SQL + """,
pf AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count_if({c} IS NULL) AS missing, count(DISTINCT {c}) AS ds FROM wide" for c in COLS) + """),
us AS (SELECT column_name, string_agg(DISTINCT feature, '; ' ORDER BY feature) AS features FROM feat GROUP BY 1)
SELECT cat.column_name, role, source, rows, missing, ds AS "distinct", features FROM cat LEFT JOIN pf ON cat.column_name = pf.column_name LEFT JOIN us ON cat.column_name = us.column_name"""))
def _(t):
    return catalog.enrich(cat(t), profile.column_profile(wide(t), COLS), catalog.usage(features(t)))


@query("sealed_columns", "S08 S07", "column_name:s reason:s n_filled:l", with_wide(CAT_SQL + """, pf AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n FROM wide" for c in COLS) + """)
SELECT cat.column_name, CASE WHEN cat.column_name = 'balance' THEN 'listed' WHEN role IN ('LABEL', 'FORBIDDEN', 'IDENTIFIER') THEN 'role' WHEN timing = 'post_index' THEN 'timing' END AS reason, n AS n_filled FROM cat JOIN pf ON cat.column_name = pf.column_name
WHERE cat.column_name = 'balance' OR role IN ('LABEL', 'FORBIDDEN', 'IDENTIFIER') OR timing = 'post_index'"""))
def _(t):
    sealed = catalog.seal_map(cat(t), listed=["balance"], roles=["LABEL", "FORBIDDEN", "IDENTIFIER"], timings=["post_index"], pattern="^(next_|future_)")
    return sealed.join(profile.column_profile(wide(t), COLS).select("column_name", F.col("observed").alias("n_filled")), "column_name")


@query("schema_diff", "J15 U03", "column_name:s in_old:b in_declared:b in_extract:b column_class:s observed:l", with_wide("""
c AS (SELECT * FROM (VALUES ('n30', true, true, true, 'UNCHANGED'), ('n365', true, true, true, 'CHANGED_DEFINITION'), ('mean_price', true, false, true, 'REVIEW'), ('old_score', true, false, false, 'REMOVED'), ('n_urgent', false, true, true, 'RENAMED'), ('balance', false, true, true, 'NEW_CANDIDATE'),
 ('segment', false, true, true, 'NEW_OTHER'), ('followup_end', false, false, true, 'FORBIDDEN'), ('version', false, false, true, 'REVIEW'), ('planned', false, true, false, 'DECLARED_ONLY')) v(column_name, in_old, in_declared, in_extract, column_class))
SELECT c.*, o.n AS observed FROM c LEFT JOIN (""" + " UNION ALL ".join(f"SELECT '{c}' AS cn, count({c}) AS n FROM wide" for c in ("n30", "n365", "mean_price", "n_urgent", "balance", "segment", "followup_end", "version")) + ") o ON c.column_name = o.cn"))
def _(t):
    spark = t.spark
    keep = {"n30", "n365", "mean_price", "n_urgent", "balance", "segment", "followup_end", "version"}
    header = spark.createDataFrame([(c,) for c in wide(t).columns if c in keep], "column_name string")
    old = spark.createDataFrame([("n30", "PREDICTOR"), ("n365", "PREDICTOR"), ("mean_price", "PREDICTOR"), ("old_score", "PREDICTOR")], "column_name string, role string")
    new = spark.createDataFrame([("n30", "SAME", None, None, None), ("n365", "CHANGED", None, None, None), ("n_urgent", None, "PREDICTOR", "old_score", True), ("balance", None, "PREDICTOR", None, None),
                                 ("segment", None, "METADATA", None, None), ("planned", None, "PREDICTOR", None, None)],
                                "column_name string, equivalence string, new_role string, replaces string, lineage_proven boolean")
    seen = profile.column_profile(wide(t), sorted(keep)).select("column_name", "observed")
    return catalog.enrich(catalog.schema_diff(old, new, header, sealed_pattern="(?i)followup|next_"), seen)


@query("column_status", "A70 A72 A73", "column_name:s source:s n_on:l n_after:l status:s", with_wide(STATUS_SQL + " SELECT column_name, source, n_on, n_after, status FROM st"))
def _(t):
    return catalog.column_status(cat(t), dated_counts(t))


@query("safe_feature_sets", "A73 C16 A51", "feature:s status:s sets:s", with_wide(STATUS_SQL + ", " + FEAT_SQL + """,
fs AS (SELECT feature, max(CASE coalesce(status, 'UNRESOLVED') WHEN 'SAFE' THEN 1 WHEN 'UNRESOLVED' THEN 2 ELSE 3 END) AS w FROM feat LEFT JOIN st ON feat.column_name = st.column_name GROUP BY 1)
SELECT feature, CASE w WHEN 1 THEN 'SAFE' WHEN 2 THEN 'UNRESOLVED' ELSE 'UNSAFE' END AS status, CASE w WHEN 1 THEN 'ALL; SAFE' WHEN 2 THEN 'ALL' ELSE '' END AS sets FROM fs"""))
def _(t):
    return catalog.feature_sets(features(t), catalog.column_status(cat(t), dated_counts(t)))


# A graph from the data: order months in a chain, quarters and years over them (diamonds), and regions in loops with a nation.
GRAPH_SQL = """m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders), 
e AS (SELECT 'month ' || strftime(d, '%Y-%m') AS c, 'month ' || strftime(lag(d) OVER (ORDER BY d), '%Y-%m') AS p FROM m
 UNION SELECT 'quarter ' || strftime(date_trunc('quarter', d), '%Y-%m'), 'month ' || strftime(d, '%Y-%m') FROM m
 UNION SELECT 'year ' || strftime(d, '%Y'), 'quarter ' || strftime(date_trunc('quarter', d), '%Y-%m') FROM m
 UNION SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation
 UNION SELECT 'region ' || n_regionkey, 'nation ' || min(n_nationkey) FROM nation WHERE n_regionkey > 0 GROUP BY n_regionkey),
st AS (SELECT 'month ' || strftime(d, '%Y-%m') AS column_name, CASE WHEN d = (SELECT min(d) FROM m) THEN 'UNSAFE' ELSE 'SAFE' END AS status FROM m
 UNION SELECT c, 'SAFE' FROM e WHERE c NOT LIKE 'month%' UNION SELECT p, 'SAFE' FROM e WHERE p LIKE 'region%')"""


@query("dependency_closure", "J23", "column_name:s own_status:s status:s n_inherited:l", "WITH RECURSIVE " + GRAPH_SQL + """,
r AS (SELECT c, p FROM e WHERE p IS NOT NULL UNION SELECT r.c, e.p FROM r JOIN e ON r.p = e.c WHERE e.p IS NOT NULL),
a AS (SELECT column_name AS c, status FROM st UNION ALL SELECT c, CASE WHEN p IN (SELECT c FROM r WHERE c = p) AND status = 'SAFE' THEN 'UNRESOLVED' ELSE status END FROM r JOIN st ON p = column_name WHERE c <> p
 UNION ALL SELECT c, 'UNRESOLVED' FROM r WHERE c = p)
SELECT column_name, st.status AS own_status, CASE max(CASE a.status WHEN 'SAFE' THEN 1 WHEN 'UNRESOLVED' THEN 2 ELSE 3 END) WHEN 1 THEN 'SAFE' WHEN 2 THEN 'UNRESOLVED' ELSE 'UNSAFE' END AS status, count(*) - 1 AS n_inherited
FROM st JOIN a ON column_name = c GROUP BY ALL""")
def _(t):
    month = t.orders.select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    label = lambda kind, d, f="yyyy-MM": F.concat(F.lit(f"{kind} "), F.date_format(d, f))
    quarter = label("quarter", F.trunc("d", "quarter"))
    before = month.select(F.add_months("d", 1).alias("d"), F.col("d").alias("before"))  # every month of the range has orders
    nation, region = F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
    looped = t.nation.where("n_regionkey > 0").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    edges = (month.join(before, "d").select(label("month", F.col("d")).alias("column_name"), label("month", F.col("before")).alias("parent"))
             .union(month.select(quarter, label("month", F.col("d")))).union(month.select(label("year", F.col("d"), "yyyy"), quarter))
             .union(t.nation.select(nation, region)).union(looped.select(region, nation)).distinct())
    first = month.agg(F.min("d")).scalar()
    rest = edges.select(F.explode(F.array("column_name", "parent")).alias("column_name")).where("column_name NOT LIKE 'month%'").distinct()
    status = month.select(label("month", F.col("d")).alias("column_name"), F.when(F.col("d") == first, "UNSAFE").otherwise("SAFE").alias("status")).union(rest.select("column_name", F.lit("SAFE")))
    return catalog.dependency_closure(status, edges)


@query("needed_columns", "C10", "column_name:s availability:s observed:l", with_wide(FEAT_SQL + """, o AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS cn, count({c}) AS n FROM wide" for c in ("n30", "n365", "mean_price", "n_urgent", "balance")) + """)
SELECT DISTINCT column_name, CASE WHEN column_name = 'balance' THEN 'sealed' WHEN column_name = 'gone' THEN 'absent' ELSE 'available' END AS availability, n AS observed FROM feat LEFT JOIN o ON cn = column_name"""))
def _(t):
    header = t.spark.createDataFrame([(c,) for c in wide(t).columns], "column_name string")
    sealed = t.spark.createDataFrame([("balance",), ("y",)], "column_name string")
    seen = profile.column_profile(wide(t), ["n30", "n365", "mean_price", "n_urgent", "balance"]).select("column_name", "observed")
    return catalog.enrich(catalog.needed_columns(features(t), header, sealed), seen)


@query("feature_coverage", "A50 A51", "features:l available:l unavailable:l mandatory_missing:l pct:f", with_wide(FEAT_SQL + """, o AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS cn, count({c}) / count(*) AS share FROM wide" for c in ("n30", "n365", "mean_price", "n_urgent", "balance")) + """),
ok AS (SELECT feature, bool_and(coalesce(share >= 0.7, false)) AS av FROM feat LEFT JOIN o ON cn = column_name GROUP BY 1)
SELECT count(*) AS features, count_if(av) AS available, count_if(NOT av) AS unavailable, count_if(NOT av AND feature IN ('recent', 'yearly', 'lost')) AS mandatory_missing, 100 * count_if(av) / count(*) AS pct FROM ok"""))
def _(t):
    prof = profile.column_profile(wide(t), ["n30", "n365", "mean_price", "n_urgent", "balance"])
    usable = prof.where(F.col("observed") / F.col("rows") >= 0.7).select("column_name", F.lit(True).alias("h"))
    need = features(t).select("feature", F.explode("inputs").alias("column_name")).join(usable, "column_name", "left")
    ok = need.groupBy("feature").agg(F.every(F.coalesce("h", F.lit(False))).alias("a")).where("a").select("feature")
    return catalog.coverage(features(t), ok)


REG_SQL = STATUS_SQL + ", pf AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS observed, count(DISTINCT {c}) AS ds FROM wide" for c in COLS) + ")"


@query("column_registry", "A65", "column_name:s observed:l disposition:s", with_wide(REG_SQL + ", " + FEAT_SQL + """
SELECT st.column_name, observed, CASE WHEN st.column_name IN (SELECT column_name FROM feat) THEN 'USED' WHEN role IN ('LABEL', 'IDENTIFIER', 'FORBIDDEN') THEN 'NOT_A_PREDICTOR' WHEN observed = 0 THEN 'EMPTY' WHEN ds <= 1 THEN 'CONSTANT' WHEN observed < 50 THEN 'TOO_SPARSE' ELSE 'CANDIDATE' END AS disposition
FROM st JOIN pf ON st.column_name = pf.column_name"""))
def _(t):
    prof = profile.column_profile(wide(t), COLS).join(cat(t).select("column_name", "role"), "column_name")
    return catalog.column_registry(prof, catalog.usage(features(t)), min_observed=50)


@query("registry_funnel", "A64 C25", "step:l stage:s n:l", with_wide(REG_SQL + """ SELECT 0 AS step, 'columns' AS stage, count(*) AS n FROM st UNION ALL SELECT 1, 'predictor role', count_if(role = 'PREDICTOR') FROM st UNION ALL
SELECT 2, 'observed', count_if(role = 'PREDICTOR' AND observed >= 50) FROM st JOIN pf ON st.column_name = pf.column_name UNION ALL SELECT 3, 'not unsafe', count_if(role = 'PREDICTOR' AND observed >= 50 AND status <> 'UNSAFE') FROM st JOIN pf ON st.column_name = pf.column_name"""))
def _(t):
    reg = catalog.column_status(cat(t), dated_counts(t)).join(profile.column_profile(wide(t), COLS).select("column_name", "observed"), "column_name")
    return catalog.registry_funnel(reg, [("columns", "true"), ("predictor role", "role = 'PREDICTOR'"), ("observed", "observed >= 50"), ("not unsafe", "status <> 'UNSAFE'")])


@query("feature_set_membership", "C16 C17", "set_name:s n_features:l members:s alias_of:s", with_wide(STATUS_SQL + """,
m AS (SELECT 'ALL' AS s, column_name FROM st UNION ALL SELECT 'NOT_UNSAFE', column_name FROM st WHERE status <> 'UNSAFE' UNION ALL SELECT 'NO_FUTURE', column_name FROM st WHERE NOT status = 'UNSAFE' UNION ALL SELECT 'PREDICTORS', column_name FROM st WHERE role = 'PREDICTOR'),
g AS (SELECT s AS set_name, count(*) AS n_features, string_agg(column_name, '; ' ORDER BY column_name) AS members FROM m GROUP BY 1) SELECT *, min(set_name) OVER (PARTITION BY members) AS alias_of FROM g"""))
def _(t):
    reg = catalog.column_status(cat(t), dated_counts(t)).withColumnRenamed("column_name", "feature")
    return catalog.set_membership(reg, {"ALL": "true", "NOT_UNSAFE": "status <> 'UNSAFE'", "NO_FUTURE": "NOT status = 'UNSAFE'", "PREDICTORS": "role = 'PREDICTOR'"})


@query("set_violations", "C16 C17", "set_name:s violations:l", with_wide(STATUS_SQL + " SELECT 'PREDICTORS' AS set_name, count_if(status = 'UNSAFE') AS violations FROM st WHERE role = 'PREDICTOR' HAVING count_if(status = 'UNSAFE') > 0"))
def _(t):
    reg = catalog.column_status(cat(t), dated_counts(t)).withColumnRenamed("column_name", "feature").withColumn("eligible", F.col("status") != "UNSAFE")
    members = catalog.set_membership(reg, {"PREDICTORS": "role = 'PREDICTOR'"})
    return catalog.set_violations(members, reg).groupBy("set_name").agg(F.count(F.lit(1)).alias("violations"))


# ------------------------------------------------------------------ evidence per (priority, feature-like) from the score table
def evidence(t: Tables):
    w = wide(t).where("y IS NOT NULL")
    cols = ["n30", "n365", "days_since", "mean_price", "balance"]
    uni = profile.univariate_auroc(w, cols, "y").select(F.col("column_name").alias("feature"), "auroc")
    diff = profile.smd_by_class(w, cols, F.col("y") == 1).select(F.col("column_name").alias("feature"), "smd")
    miss = profile.missing_bands(w, [*cols, "death_date"]).select(F.col("column_name").alias("feature"), "missing_pct")
    return uni, diff, miss


EV_COLS = ["n30", "n365", "days_since", "mean_price", "balance"]


def ev_sql() -> str:
    return ("lab AS (SELECT * FROM wide WHERE y IS NOT NULL), lg AS (SELECT * FROM (" + long_sql("lab", EV_COLS, "y") + ") WHERE value IS NOT NULL), " + runs_sql("lg", keys="column_name", p="value")
            + f""", ua AS (SELECT column_name AS feature, {AUROC} AS auroc FROM runs GROUP BY 1),
sd AS (SELECT column_name AS feature, (avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0)) / sqrt((var_samp(value) FILTER (WHERE y = 1) + var_samp(value) FILTER (WHERE y = 0)) / 2) AS smd FROM lg GROUP BY 1),
ms AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, 100 * count_if({c} IS NULL) / count(*) AS missing_pct FROM lab" for c in [*EV_COLS, "death_date"]) + "), ej AS (SELECT ms.feature, auroc, smd, missing_pct FROM ms LEFT JOIN ua ON ms.feature = ua.feature LEFT JOIN sd ON ms.feature = sd.feature)")


@query("feature_evidence", "J18", "feature:s auroc:f smd:f missing_pct:f", with_wide(ev_sql() + " SELECT * FROM ej"))
def _(t):
    return catalog.evidence_join(*evidence(t))


@query("consensus_rating", "J19", "feature:s votes:l rating:s", with_wide(ev_sql() + """,
f AS (SELECT feature, coalesce(CAST(abs(smd) >= 0.02 AS INTEGER), 0) + coalesce(CAST(abs(auroc - 0.5) >= 0.01 AS INTEGER), 0) + CAST(missing_pct < 10 AS INTEGER) AS votes, coalesce(abs(auroc - 0.5) >= 0.03, false) AS ablation FROM ej)
SELECT feature, votes, CASE WHEN ablation AND votes >= 2 THEN 'STRONG' WHEN ablation OR votes >= 2 THEN 'MODERATE' WHEN votes >= 1 THEN 'WEAK' ELSE 'NONE' END AS rating FROM f"""))
def _(t):
    e = catalog.evidence_join(*evidence(t)).select("feature", (F.abs("smd") >= 0.02).alias("univariate"), (F.abs(F.col("auroc") - 0.5) >= 0.01).alias("importance"),
                                                   (F.col("missing_pct") < 10).alias("linear"), (F.abs(F.col("auroc") - 0.5) >= 0.03).alias("ablation"))
    return catalog.consensus_rating(e)
