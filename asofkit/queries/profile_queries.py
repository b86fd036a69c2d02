"""Profile queries: columns, distributions, NULLs, cohort tables, association, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators import design, ordering, profile
from asofkit.queries.registry import query
from asofkit.queries.scores import AUROC, runs_sql, scored_lines, with_scores
from asofkit.queries.wide import wide, with_wide

NUM = ["n30", "n365", "days_since", "mean_price", "n_urgent", "balance"]
CAT = ["segment", "nation_name", "n_urgent"]

def bases():
    return {"all": F.lit(True), "labelled": F.col("y").isNotNull(), "train": F.col("split") == "train"}


BASES_SQL = "based AS (SELECT *, 'all' AS basis FROM wide UNION ALL SELECT *, 'labelled' FROM wide WHERE y IS NOT NULL UNION ALL SELECT *, 'train' FROM wide WHERE split = 'train')"


def long_sql(source: str, cols: list[str], carry: str, cast: str = "DOUBLE") -> str:
    pre = f"{carry}, " if carry else ""
    return " UNION ALL ".join(f"SELECT {pre}'{c}' AS column_name, CAST({c} AS {cast}) AS value FROM {source}" for c in cols)


@query("numeric_profile", "A17 A16", "basis:s column_name:s rows:l n:l min:f max:f mean:f sd:f p01:f p25:f p50:f p75:f p99:f iqr:f zeros:l negatives:l skewness:f excess_kurtosis:f above_3iqr:l below_3iqr:l distinct:l",
       with_wide(f"""{BASES_SQL}, lg AS ({long_sql('based', NUM, 'basis')}),
q AS (SELECT basis, column_name, count(*) AS rows, count(value) AS n, min(value) AS mn, max(value) AS mx, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.25) AS p25,
 quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99, count_if(value = 0) AS zeros, count_if(value < 0) AS negatives, skewness(value) AS skewness, kurtosis(value) AS excess_kurtosis,
 count(DISTINCT value) AS ds FROM lg GROUP BY ALL),
t AS (SELECT q.basis, q.column_name, count_if(p75 > p25 AND value > p75 + 3 * (p75 - p25)) AS above_3iqr, count_if(p75 > p25 AND value < p25 - 3 * (p75 - p25)) AS below_3iqr FROM q JOIN lg ON q.basis = lg.basis AND q.column_name = lg.column_name GROUP BY ALL)
SELECT q.*, mn AS "min", mx AS "max", ds AS "distinct", p75 - p25 AS iqr, above_3iqr, below_3iqr FROM q JOIN t ON q.basis = t.basis AND q.column_name = t.column_name"""))
def _(t):
    return profile.numeric_profile(wide(t), NUM, bases())


@query("exact_quantiles", "A17", "status:s n_observed:l q0:f q1:f q2:f", with_scores("SELECT status, count(*) AS n_observed, quantile_cont(price, 0.05) AS q0, quantile_cont(price, 0.5) AS q1, quantile_cont(price, 0.95) AS q2 FROM lscored GROUP BY 1"))
def _(t):
    return ordering.quantiles(scored_lines(t), "price", [0.05, 0.5, 0.95], ["status"])


@query("transformation_hints", "P50", "basis:s column_name:s hint:s", with_wide(f"""{BASES_SQL}, lg AS ({long_sql('based', NUM, 'basis')}),
q AS (SELECT basis, column_name, count(value) AS n, min(value) AS mn, max(value) AS mx, count_if(value = 0) / count(value) AS z, skewness(value) AS sk, quantile_cont(value, 0.99) AS p99, count(DISTINCT value) AS ds FROM lg GROUP BY ALL),
h AS (SELECT *, concat_ws('; ', CASE WHEN z >= 0.5 THEN 'zero-inflated' END, CASE WHEN sk > 1 AND mn >= 0 THEN 'right-skewed' END, CASE WHEN mx > 0 AND p99 > 0 AND mx > 3 * p99 THEN 'heavy upper tail' END) AS hs FROM q)
SELECT basis, column_name, CASE WHEN n = 0 THEN 'no data' WHEN ds <= 2 THEN 'binary' WHEN hs = '' THEN 'none' ELSE hs END AS hint FROM h"""))
def _(t):
    return profile.transformation_hint(profile.numeric_profile(wide(t), NUM, bases()))


COLS = ["entity_id", "n30", "segment", "nation_name", "last_order_date", "version", "followup_end", "eligible"]


@query("column_profile", "A16 A65", "column_name:s rows:l observed:l missing:l distinct:l top_share:f status:s", with_wide(f"""lg AS ({long_sql('wide', COLS, '', 'VARCHAR')}),
c AS (SELECT column_name, value, count(*) AS n FROM lg GROUP BY ALL),
s AS (SELECT column_name, sum(n) AS rows, sum(n) FILTER (WHERE value IS NOT NULL) AS observed, sum(n) FILTER (WHERE value IS NULL) AS missing, count(value) AS ds, max(n) FILTER (WHERE value IS NOT NULL) AS top FROM c GROUP BY 1)
SELECT column_name, rows, observed, coalesce(missing, 0) AS missing, ds AS "distinct", top / observed AS top_share, CASE WHEN observed = 0 THEN 'EMPTY' WHEN ds <= 1 THEN 'CONSTANT' WHEN top / observed >= 0.995 THEN 'NEAR_CONSTANT' ELSE 'VARIABLE' END AS status FROM s"""))
def _(t):
    return profile.column_profile(wide(t), COLS)


@query("top_values", "L08 A09", "column_name:s level:s n:l place:l", with_wide(f"""lg AS ({long_sql('wide', CAT, '', 'VARCHAR')}), c AS (SELECT column_name, coalesce(value, 'NULL') AS level, count(*) AS n FROM lg GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, level) AS place FROM c) WHERE place <= 8"""))
def _(t):
    return profile.top_levels(profile.value_counts(wide(t), CAT), 8)


@query("crosstab_suppressed", "A09", "level_a:s level_b:s n:l suppressed:b", with_wide("""
SELECT segment AS level_a, nation_name AS level_b, CASE WHEN count(*) >= 30 THEN count(*) END AS n, count(*) < 30 AS suppressed FROM wide GROUP BY ALL"""))
def _(t):
    return profile.crosstab(wide(t), "segment", "nation_name", 30)


@query("categorical_profile", "A18", "basis:s column_name:s level:s n:l levels_merged:l pct:f sparse:b out_of_list:b", with_wide(f"""{BASES_SQL}, lg AS ({long_sql('based', ['segment', 'nation_name', 'n_urgent'], 'basis', 'VARCHAR')}),
c AS (SELECT basis, column_name, coalesce(value, 'NULL') AS level, count(*) AS n FROM lg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY basis, column_name ORDER BY n DESC, level) AS place, sum(n) OVER (PARTITION BY basis, column_name) AS rows FROM c),
m AS (SELECT basis, column_name, CASE WHEN place <= 10 THEN level ELSE '(more levels)' END AS level, rows, sum(n) AS n, count(*) AS levels_merged FROM r GROUP BY ALL)
SELECT basis, column_name, level, n, levels_merged, 100 * n / rows AS pct, n < 30 OR n / rows < 0.005 AS sparse, column_name = 'segment' AND level NOT IN ('NULL', '(more levels)', 'AUTOMOBILE', 'BUILDING') AS out_of_list FROM m"""))
def _(t):
    return profile.categorical_profile(wide(t), CAT, bases(), allowed={"segment": ["AUTOMOBILE", "BUILDING"]}, min_cell=30, max_levels=10)


@query("extract_audit", "A10", "split:s rows:l entities:l eligible_rows:l labelled:l events:l with_history:l mean_orders:f", with_wide("""
SELECT split, count(*) AS rows, count(DISTINCT entity_id) AS entities, sum(eligible) AS eligible_rows, count(y) AS labelled, sum(y) AS events, count(last_order_date) AS with_history, avg(n365) AS mean_orders FROM wide GROUP BY 1"""))
def _(t):
    return wide(t).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"), F.sum("eligible").alias("eligible_rows"), F.count("y").alias("labelled"),
                                        F.sum("y").alias("events"), F.count("last_order_date").alias("with_history"), F.avg("n365").alias("mean_orders"))


NULL_RULES = {"event_date": [("NOT_APPLICABLE", "y = 0"), ("SOURCE_UNAVAILABLE", "segment = 'FURNITURE'")], "mean_price": [("SOURCE_UNAVAILABLE", "last_order_date IS NULL")], "last_order_date": []}
NULL_DEFAULT = {"event_date": "UNKNOWN", "mean_price": "TRUE_ABSENCE", "last_order_date": "SOURCE_UNAVAILABLE", "followup_end": "NOT_APPLICABLE"}


@query("null_classes", "A19", "column_name:s null_class:s n:l", with_wide("""
SELECT 'event_date' AS column_name, CASE WHEN y = 0 THEN 'NOT_APPLICABLE' WHEN segment = 'FURNITURE' THEN 'SOURCE_UNAVAILABLE' ELSE 'UNKNOWN' END AS null_class, count(*) AS n FROM wide WHERE event_date IS NULL GROUP BY ALL UNION ALL
SELECT 'mean_price', CASE WHEN last_order_date IS NULL THEN 'SOURCE_UNAVAILABLE' ELSE 'TRUE_ABSENCE' END, count(*) FROM wide WHERE mean_price IS NULL GROUP BY ALL UNION ALL
SELECT 'last_order_date', 'SOURCE_UNAVAILABLE', count(*) FROM wide WHERE last_order_date IS NULL GROUP BY ALL UNION ALL
SELECT 'followup_end', CASE WHEN followup_end IS NULL THEN 'NOT_APPLICABLE' ELSE 'SENTINEL' END, count(*) FROM wide WHERE followup_end IS NULL OR followup_end = DATE '2999-12-31' GROUP BY ALL"""))
def _(t):
    return profile.null_classes(wide(t), NULL_RULES, NULL_DEFAULT, {"followup_end": ["2999-12-31"]})


MISS = ["last_order_date", "mean_price", "n_urgent", "event_date", "followup_end", "death_date"]


@query("missing_bands", "A19 A48", "column_name:s rows:l missing:l missing_pct:f band:s", with_wide(f"""lg AS ({long_sql('wide', MISS, '', 'VARCHAR')}),
m AS (SELECT column_name, count(*) AS rows, count_if(value IS NULL) AS missing, 100 * count_if(value IS NULL) / count(*) AS missing_pct FROM lg GROUP BY 1)
SELECT *, CASE WHEN missing_pct > 99 THEN '>99%' WHEN missing_pct > 90 THEN '>90%' WHEN missing_pct > 50 THEN '>50%' WHEN missing_pct > 25 THEN '>25%' WHEN missing = 0 THEN '0%' ELSE '<=25%' END AS band FROM m"""))
def _(t):
    return profile.missing_bands(wide(t), MISS)


SAME = ["n30", "n90", "n365", "n365_copy", "mean_price", "segment"]


@query("identical_columns", "A20 A67", "column_a:s column_b:s differing:l", with_wide("w AS (SELECT *, n365 AS n365_copy FROM wide), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count_if(CAST({a} AS VARCHAR) IS DISTINCT FROM CAST({b} AS VARCHAR)) AS differing FROM w"
    for i, a in enumerate(SAME) for b in SAME[i + 1:]) + ") SELECT * FROM p WHERE differing = 0"))
def _(t):
    w = wide(t).withColumn("n365_copy", F.col("n365"))
    return profile.identical_columns(w, SAME, ["entity_id", "index_date"])


@query("co_missingness", "A21", "column_a:s column_b:s phi:f jaccard:f both:l", with_wide("f AS (SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in MISS) + " FROM wide)" + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS phi, sum({a} * {b}) / nullif(sum(greatest({a}, {b})), 0) AS jaccard, sum({a} * {b}) AS both, avg({a}) AS sa, avg({b}) AS sb FROM f"
    for i, a in enumerate(MISS) for b in MISS[i + 1:]) + ") SELECT column_a, column_b, phi, jaccard, \"both\" FROM p WHERE sa BETWEEN 0.005 AND 0.995 AND sb BETWEEN 0.005 AND 0.995"))
def _(t):
    return profile.co_missingness(wide(t), MISS)


@query("missing_block_patterns", "A22", "pattern:s n:l", with_wide("""
p AS (SELECT concat(CASE WHEN last_order_date IS NULL AND mean_price IS NULL THEN '1' ELSE '0' END, CASE WHEN event_date IS NULL THEN '1' ELSE '0' END, CASE WHEN followup_end IS NULL AND death_date IS NULL THEN '1' ELSE '0' END) AS pattern, count(*) AS n FROM wide GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, pattern) AS place FROM p)
SELECT CASE WHEN place <= 5 AND n >= 30 THEN pattern ELSE '(other)' END AS pattern, sum(n) AS n FROM r GROUP BY 1"""))
def _(t):
    return profile.block_patterns(wide(t), {"history": ["last_order_date", "mean_price"], "events": ["event_date"], "ends": ["followup_end", "death_date"]}, min_cell=30, top=5)


@query("row_missing_share", "A23", "rows:l median_share:f p90_share:f p99_share:f above_50:l above_75:l above_p99:l", with_wide("s AS (SELECT (" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in MISS) + """) / 6 AS share FROM wide),
q AS (SELECT quantile_cont(share, 0.5) AS a, quantile_cont(share, 0.9) AS b, quantile_cont(share, 0.99) AS c FROM s)
SELECT count(*) AS rows, any_value(a) AS median_share, any_value(b) AS p90_share, any_value(c) AS p99_share, count_if(share > 0.5) AS above_50, count_if(share > 0.75) AS above_75, count_if(share > c) AS above_p99 FROM s, q"""))
def _(t):
    return profile.row_missingness(wide(t), MISS)


PR_SQL = """CASE WHEN {a} > 0 AND {c} > 0 AND {n1} > 0 AND {n0} > 0 THEN ({a} / {n1}) / ({c} / {n0}) END AS ratio,
 CASE WHEN {a} > 0 AND {c} > 0 THEN exp(ln(({a} / {n1}) / ({c} / {n0})) - 1.959964 * sqrt(greatest(1 / {a} - 1 / {n1} + 1 / {c} - 1 / {n0}, 0))) END AS ratio_low,
 CASE WHEN {a} > 0 AND {c} > 0 THEN exp(ln(({a} / {n1}) / ({c} / {n0})) + 1.959964 * sqrt(greatest(1 / {a} - 1 / {n1} + 1 / {c} - 1 / {n0}, 0))) END AS ratio_high"""


def pr_sql(a, n1, c, n0):
    return PR_SQL.format(a=a, n1=n1, c=c, n0=n0)


@query("missing_against_outcome", "A24 P47", "column_name:s n_missing:l events_missing:l n_observed:l events_observed:l rate_missing:f rate_observed:f ratio:f ratio_low:f ratio_high:f", with_wide(
    "tr AS (SELECT * FROM wide WHERE split = 'train' AND y IS NOT NULL), m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS DOUBLE) AS nm, CAST(coalesce(sum(y) FILTER (WHERE {c} IS NULL), 0) AS DOUBLE) AS em, CAST(count_if({c} IS NOT NULL) AS DOUBLE) AS no, CAST(coalesce(sum(y) FILTER (WHERE {c} IS NOT NULL), 0) AS DOUBLE) AS eo FROM tr" for c in ["last_order_date", "mean_price", "n_urgent", "death_date", "followup_end"]) +
    f") SELECT column_name, nm AS n_missing, em AS events_missing, no AS n_observed, eo AS events_observed, em / nm AS rate_missing, eo / no AS rate_observed, {pr_sql('em', 'nm', 'eo', 'no')} FROM m WHERE nm / (nm + no) >= 0.01 AND no > 0"))
def _(t):
    return profile.missing_against_outcome(wide(t).where("split = 'train' AND y IS NOT NULL"), ["last_order_date", "mean_price", "n_urgent", "death_date", "followup_end"], "y")


STEPS = [("eligible", "eligible = 1"), ("labelled", "y IS NOT NULL"), ("clean", "NOT coalesce(last_order_date >= index_date, false)"), ("train", "split = 'train'")]


@query("cohort_funnel", "A25", "step:l stage:s rows:l entities:l events:l removed:l", with_wide(" UNION ALL ".join(
    f"SELECT {i} AS step, '{n}' AS stage, count(*) AS rows, count(DISTINCT entity_id) AS entities, coalesce(sum(y), 0) AS events, (SELECT count(*) FROM wide WHERE {' AND '.join(['true'] + [c for _, c in STEPS[:max(i - 1, 0)]])}) - count(*) AS removed FROM wide WHERE {' AND '.join(['true'] + [c for _, c in STEPS[:i]])}"
    for i, n in enumerate(["all rows"] + [s for s, _ in STEPS]))))
def _(t):
    return profile.funnel(wide(t), [(n, F.expr(c)) for n, c in STEPS], entity="entity_id", y="y")


@query("population_profile", "A26", "basis:s variable:s level:s n:l pct:f", with_wide(f"""{BASES_SQL}, lg AS ({long_sql('based', ['segment', 'eligible'], 'basis', 'VARCHAR')}),
c AS (SELECT basis, column_name AS variable, coalesce(value, 'NULL') AS level, count(*) AS n FROM lg GROUP BY ALL)
SELECT basis, variable, level, CASE WHEN n >= 30 THEN n END AS n, CASE WHEN n >= 30 THEN 100 * n / sum(n) OVER (PARTITION BY basis, variable) END AS pct FROM c"""))
def _(t):
    return profile.population_profile(wide(t), ["segment", "eligible"], bases(), 30)


WILSON = """{k} / {n} AS rate, greatest(0, ({k} / {n} + 1.959964 * 1.959964 / (2 * {n})) / (1 + 1.959964 * 1.959964 / {n}) - 1.959964 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 1.959964 * 1.959964 / (4 * {n} * {n})) / (1 + 1.959964 * 1.959964 / {n})) AS ci_low,
 least(1, ({k} / {n} + 1.959964 * 1.959964 / (2 * {n})) / (1 + 1.959964 * 1.959964 / {n}) + 1.959964 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 1.959964 * 1.959964 / (4 * {n} * {n})) / (1 + 1.959964 * 1.959964 / {n})) AS ci_high"""


@query("stratified_prevalence", "A27 P47", "stratifier:s level:s n:l events:l non_events:l rate:f ci_low:f ci_high:f suppressed:b", with_wide(f"""
l AS (SELECT * FROM wide WHERE y IS NOT NULL), s AS (SELECT 'segment' AS stratifier, segment AS level, y FROM l UNION ALL SELECT 'split', split, y FROM l UNION ALL SELECT 'nation_name', nation_name, y FROM l UNION ALL SELECT 'overall', 'all', y FROM l),
c AS (SELECT stratifier, level, CAST(count(*) AS DOUBLE) AS nn, CAST(sum(y) AS DOUBLE) AS k FROM s GROUP BY ALL), w AS (SELECT *, {WILSON.format(k='k', n='nn')}, (nn BETWEEN 1 AND 19) OR (k BETWEEN 1 AND 19) OR (nn - k BETWEEN 1 AND 19) AS suppressed FROM c)
SELECT stratifier, level, CASE WHEN NOT suppressed THEN nn END AS n, CASE WHEN NOT suppressed THEN k END AS events, CASE WHEN NOT suppressed THEN nn - k END AS non_events, CASE WHEN NOT suppressed THEN rate END AS rate,
 CASE WHEN NOT suppressed THEN ci_low END AS ci_low, CASE WHEN NOT suppressed THEN ci_high END AS ci_high, suppressed FROM w"""))
def _(t):
    return profile.stratified_prevalence(wide(t).where("y IS NOT NULL"), ["segment", "split", "nation_name"], "y", min_cell=20)


LAB = "lab AS (SELECT * FROM wide WHERE y IS NOT NULL)"
NUM2 = ["n365", "days_since", "mean_price", "balance"]


def univ_sql() -> str:
    return f"{LAB}, lg AS (SELECT * FROM ({long_sql('lab', NUM2, 'y')}) WHERE value IS NOT NULL), " + runs_sql("lg", keys="column_name", p="value") + f""",
a AS (SELECT column_name, max(tot_pos) AS n1, max(tot_neg) AS n0, {AUROC} AS auc FROM runs GROUP BY 1),
ua AS (SELECT *, sqrt(greatest((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n0), 0)) AS se FROM a)"""


SMD_SQL = """sm AS (SELECT column_name, count(value) FILTER (WHERE y = 1) AS n1, count(value) FILTER (WHERE y = 0) AS n0, avg(value) FILTER (WHERE y = 1) AS mean1, avg(value) FILTER (WHERE y = 0) AS mean0,
 var_samp(value) FILTER (WHERE y = 1) AS var1, var_samp(value) FILTER (WHERE y = 0) AS var0, quantile_cont(value, 0.5) FILTER (WHERE y = 1) AS p50_1, quantile_cont(value, 0.5) FILTER (WHERE y = 0) AS p50_0,
 quantile_cont(value, 0.25) FILTER (WHERE y = 1) AS p25_1, quantile_cont(value, 0.75) FILTER (WHERE y = 0) AS p75_0 FROM lg GROUP BY 1)"""


@query("univariate_auroc", "A33 A30 A38", "column_name:s n1:l n0:l auroc:f auroc_low:f auroc_high:f", with_wide(univ_sql() + """
SELECT column_name, n1, n0, auc AS auroc, greatest(0, auc - 1.959964 * se) AS auroc_low, least(1, auc + 1.959964 * se) AS auroc_high FROM ua"""))
def _(t):
    return profile.univariate_auroc(wide(t).where("y IS NOT NULL"), NUM2, "y")


@query("numeric_by_outcome", "A28 A32 A38", "column_name:s n1:l n0:l mean1:f mean0:f smd:f p50_1:f p50_0:f p25_1:f p75_0:f auroc:f", with_wide(univ_sql() + f""", {SMD_SQL}
SELECT sm.*, (mean1 - mean0) / sqrt((var1 + var0) / 2) AS smd, auc AS auroc FROM sm JOIN (SELECT column_name, auc FROM ua) u USING (column_name)"""))
def _(t):
    return profile.numeric_by_outcome(wide(t).where("y IS NOT NULL"), NUM2, "y")


@query("categorical_by_outcome", "A29", "column_name:s level:s is_reference:b n:l events:l rate:f ci_low:f ci_high:f ratio:f ratio_low:f ratio_high:f sparse:b separation:s rows_left_out:l levels_left_out:l", with_wide(f"""{LAB}, lg AS ({long_sql('lab', ['segment', 'n_urgent', 'split'], 'y', 'VARCHAR')}),
c AS (SELECT column_name, coalesce(value, 'NULL') AS level, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS events FROM lg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, level) AS place, sum(n) OVER (PARTITION BY column_name) AS rows, count(*) OVER (PARTITION BY column_name) AS levels FROM c),
f AS (SELECT column_name, level AS ref, n AS rn, events AS re FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, level DESC) AS k FROM c) WHERE k = 1)
SELECT r.column_name, level, level = ref AS is_reference, n, events, {WILSON.format(k='events', n='n')}, {pr_sql('events', 'n', 're', 'rn')}, n < 20 OR n / rows < 0.005 AS sparse,
 CASE WHEN events = 0 AND n >= 20 THEN 'no events' WHEN events = n AND n >= 20 THEN 'only events' ELSE '' END AS separation,
 rows - sum(n) OVER (PARTITION BY r.column_name) AS rows_left_out, levels - count(*) OVER (PARTITION BY r.column_name) AS levels_left_out FROM r JOIN f USING (column_name) WHERE place <= 25"""))
def _(t):
    return profile.categorical_by_outcome(wide(t).where("y IS NOT NULL"), ["segment", "n_urgent", "split"], "y", min_cell=20)


@query("cramers_v", "A31 A30", "column_a:s column_b:s n:l cramers_v:f", with_wide("cm AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("segment", "nation_name"), ("n_urgent", "n365"), ("segment", "y"))) +
    """), o AS (SELECT column_a, column_b, a, b, CAST(count(*) AS DOUBLE) AS n FROM cm GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY column_a, column_b, a) AS ra, sum(n) OVER (PARTITION BY column_a, column_b, b) AS rb, sum(n) OVER (PARTITION BY column_a, column_b) AS t FROM o)
SELECT column_a, column_b, max(t) AS n, sqrt((sum(n * n / (ra * rb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS cramers_v FROM m GROUP BY ALL"""))
def _(t):
    return profile.cramers_v(wide(t), [("segment", "nation_name"), ("n_urgent", "n365"), ("segment", "y")])


@query("baseline_table", "A34", "variable:s level:s non_event:f event:f smd:f missing:l", with_wide(f"""{LAB}, lg AS (SELECT * FROM ({long_sql('lab', NUM2, 'y')}) WHERE value IS NOT NULL), {SMD_SQL},
cl AS ({long_sql('lab', ['segment', 'split'], 'y', 'VARCHAR')}), c AS (SELECT column_name, coalesce(value, 'missing') AS level, CAST(sum(y) AS DOUBLE) AS k1, CAST(sum(1 - y) AS DOUBLE) AS k0 FROM cl GROUP BY ALL),
c2 AS (SELECT *, k1 / sum(k1) OVER (PARTITION BY column_name) AS p1, k0 / sum(k0) OVER (PARTITION BY column_name) AS p0, sum(k1) OVER (PARTITION BY column_name) AS n1, sum(k0) OVER (PARTITION BY column_name) AS n0 FROM c)
SELECT column_name AS variable, 'median' AS level, p50_0 AS non_event, p50_1 AS event, (mean1 - mean0) / sqrt((var1 + var0) / 2) AS smd, (SELECT count(*) FROM lab) - n1 - n0 AS missing FROM sm UNION ALL
SELECT column_name, level, 100 * p0, 100 * p1, (p1 - p0) / sqrt((p1 * (1 - p1) * n1 / (n1 - 1) + p0 * (1 - p0) * n0 / (n0 - 1)) / 2), NULL FROM c2"""))
def _(t):
    return profile.baseline_table(wide(t).where("y IS NOT NULL"), NUM2, ["segment", "split"], "y")


PAIRS = [(a, b) for i, a in enumerate(NUM2) for b in NUM2[i + 1:]]


@query("correlation_pairs", "A35", "column_a:s column_b:s n:l r:f", with_wide(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM wide" for a, b in PAIRS)))
def _(t):
    return profile.correlation_pairs(wide(t), NUM2)


RANK_SQL = "rk AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 END AS {c}" for c in NUM2) + " FROM wide)"
SPEAR_SQL = RANK_SQL + ", sp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM rk" for a, b in PAIRS) + ")"


def keyed(t):
    return wide(t).withColumn("row_key", F.concat_ws("|", "entity_id", "index_date"))


@query("spearman_pairs", "A36 A35 C18", "column_a:s column_b:s n:l r:f redundancy:s", with_wide(SPEAR_SQL + """ SELECT *, CASE WHEN abs(r) >= 0.95 THEN 'CANDIDATE_DUPLICATE' WHEN abs(r) >= 0.8 THEN 'HIGHLY_REDUNDANT' WHEN abs(r) >= 0.5 THEN 'MODERATE' WHEN abs(r) >= 0.3 THEN 'WEAK' END AS redundancy FROM sp"""))
def _(t):
    return profile.spearman_pairs(keyed(t), NUM2, "row_key")


@query("redundancy_clusters", "A37 C18", "cluster:l representative:s member:s abs_r:f", None)
def _(t):
    cols = ["n30", "n90", "n180", "n365", "n_urgent", "mean_price"]
    return profile.redundancy_clusters(profile.spearman_pairs(keyed(t), cols, "row_key"), cols, 0.5)


@query("split_balance", "A42", "column_name:s split:s n:l mean:f sd:f smd:f imbalanced:b", with_wide(f"""lg AS ({long_sql('wide', NUM2, 'split')}), s AS (SELECT column_name, split, count(value) AS n, avg(value) AS mean, var_samp(value) AS v FROM lg GROUP BY ALL)
SELECT s.column_name, s.split, s.n, s.mean, sqrt(s.v) AS sd, (s.mean - r.mean) / sqrt((s.v + r.v) / 2) AS smd, abs((s.mean - r.mean) / sqrt((s.v + r.v) / 2)) > 0.1 AS imbalanced FROM s JOIN s r ON s.column_name = r.column_name AND r.split = 'train'"""))
def _(t):
    return profile.split_balance(wide(t), NUM2, "split")


@query("missing_rate_by_split", "C08", "column_name:s split:s rows:l missing:l missing_rate:f", with_wide(f"""lg AS ({long_sql('wide', MISS, 'split', 'VARCHAR')}) SELECT column_name, split, count(*) AS rows, count_if(value IS NULL) AS missing, avg(CAST(value IS NULL AS INTEGER)) AS missing_rate FROM lg GROUP BY ALL"""))
def _(t):
    return profile.missing_by_split(wide(t), MISS, "split")


@query("adequacy_gate", "A49", "split:s rows:l events:l non_events:l events_per_parameter:f verdict:s", with_wide("""
s AS (SELECT split, count(*) AS rows, sum(y) AS events, sum(1 - y) AS non_events FROM wide WHERE y IS NOT NULL GROUP BY 1)
SELECT *, least(events, non_events) / 12 AS events_per_parameter, CASE WHEN events >= 100 AND non_events >= 100 AND (split <> 'train' OR least(events, non_events) / 12 >= 10) THEN 'READY' ELSE 'INSUFFICIENT' END AS verdict FROM s"""))
def _(t):
    return profile.adequacy(wide(t).where("y IS NOT NULL"), [], "split", "y", parameters=12, min_epp=10, min_events=100)


@query("sparse_predictors", "A49 A38", "column_name:s n1:l events1:l n0:l events0:l status:s separation:b", with_wide("""
f AS (SELECT y, CAST(n30 > 0 AS INTEGER) AS any30, CAST(n365 >= 4 AS INTEGER) AS many, 1 AS always FROM wide WHERE y IS NOT NULL), lg AS (SELECT 'any30' AS column_name, any30 AS v, y FROM f UNION ALL SELECT 'many', many, y FROM f UNION ALL SELECT 'always', always, y FROM f),
s AS (SELECT column_name, count_if(v = 1) AS n1, coalesce(sum(y) FILTER (WHERE v = 1), 0) AS events1, count_if(v <> 1) AS n0, coalesce(sum(y) FILTER (WHERE v <> 1), 0) AS events0 FROM lg GROUP BY 1)
SELECT *, CASE WHEN n1 = 0 OR n0 = 0 THEN 'constant' WHEN least(events1, events0) < 50 THEN 'sparse' ELSE 'ok' END AS status, events1 = 0 OR events0 = 0 OR events1 = n1 OR events0 = n0 AS separation FROM s"""))
def _(t):
    f = wide(t).where("y IS NOT NULL").select("y", (F.col("n30") > 0).cast("int").alias("any30"), (F.col("n365") >= 4).cast("int").alias("many"), F.lit(1).alias("always"))
    return profile.sparse_predictors(f, ["any30", "many", "always"], "y", min_events=50)


@query("two_proportions", "P48 P49", "difference:f diff_low:f diff_high:f differs:b", with_wide("""
c AS (SELECT CAST(count_if(split = 'train' AND y = 1) AS DOUBLE) AS e1, CAST(count_if(split = 'train' AND y IS NOT NULL) AS DOUBLE) AS n1, CAST(count_if(split = 'test' AND y = 1) AS DOUBLE) AS e2, CAST(count_if(split = 'test' AND y IS NOT NULL) AS DOUBLE) AS n2 FROM wide),
d AS (SELECT e1 / n1 - e2 / n2 AS difference, 1.959964 * sqrt(e1 / n1 * (1 - e1 / n1) / n1 + e2 / n2 * (1 - e2 / n2) / n2) AS h FROM c)
SELECT difference, difference - h AS diff_low, difference + h AS diff_high, difference - h > 0 OR difference + h < 0 AS differs FROM d"""))
def _(t):
    w = wide(t)
    c = w.agg(*[F.count_if((F.col("split") == s) & cond).alias(n) for s, k in (("train", "1"), ("test", "2")) for n, cond in ((f"e{k}", F.col("y") == 1), (f"n{k}", F.col("y").isNotNull()))])
    return c.select(*stats.columns(stats.two_proportions(F.col("e1"), F.col("n1"), F.col("e2"), F.col("n2"))))


@query("standardised_columns", "P31", "entity_id:l index_date:d z_balance:f z_orders:f", with_wide("""
s AS (SELECT avg(balance) AS mb, stddev_pop(balance) AS sb, avg(n365) AS mo, stddev_pop(n365) AS so FROM wide) SELECT entity_id, index_date, (balance - mb) / sb AS z_balance, (n365 - mo) / so AS z_orders FROM wide, s"""))
def _(t):
    w = wide(t)
    return design.standardise(w, ["balance", "n365"]).select("entity_id", "index_date", F.col("balance__z").alias("z_balance"), F.col("n365__z").alias("z_orders"))


@query("median_imputation", "P26", "entity_id:l index_date:d mean_price:f days_since:f price_missing:l", with_wide("""
s AS (SELECT quantile_cont(mean_price, 0.5) AS mp, quantile_cont(days_since, 0.5) AS md FROM wide WHERE split = 'train') SELECT entity_id, index_date, coalesce(mean_price, mp) AS mean_price, coalesce(days_since, md) AS days_since, CAST(mean_price IS NULL AS INTEGER) AS price_missing FROM wide, s"""))
def _(t):
    w = wide(t)
    return design.median_impute(w, w.where("split = 'train'"), ["mean_price", "days_since"]).select("entity_id", "index_date", "mean_price", "days_since", F.col("mean_price__missing").alias("price_missing"))


@query("power_scaling", "P24 W17", "shift:f scale:f low:f high:f gap:f", with_wide("""
d AS (SELECT DISTINCT CAST(n365 AS DOUBLE) AS x FROM wide), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap FROM d), s AS (SELECT min(x) AS low, max(x) AS high, min(gap) AS gap FROM g)
SELECT CASE WHEN low <= 0 THEN -low + gap ELSE 0 END AS shift, pow(10, sign(log10(high - low)) * floor(abs(log10(high - low)))) AS scale, low, high, gap FROM s"""))
def _(t):
    return design.power_scaling(wide(t), "n365")


@query("raw_tree_matrix", "P30 P52", "entity_id:l index_date:d seg:f price:f days:f", with_wide("SELECT entity_id, index_date, CASE segment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS seg, mean_price AS price, days_since AS days FROM wide"))
def _(t):
    return wide(t).select("entity_id", "index_date", F.when(F.col("segment") == "BUILDING", 1.0).when(F.col("segment") == "MACHINERY", 0.0).alias("seg"), F.col("mean_price").cast("double").alias("price"), F.col("days_since").cast("double").alias("days"))


@query("absent_term_shift", "P38", "intercept_shift:f variance_share:f terms_absent:l", with_wide("""
SELECT 0.05 * avg(balance / 1000) AS intercept_shift, (0.09 * var_pop(n30) + 0.04 * var_pop(n365)) / (0.09 * var_pop(n30) + 0.04 * var_pop(n365) + 0.0025 * var_pop(balance / 1000)) AS variance_share, 1 AS terms_absent FROM wide"""))
def _(t):
    return design.absent_terms(wide(t).withColumn("balance_k", F.col("balance") / 1000), {"n30": 0.3, "n365": -0.2, "balance_k": 0.05}, ["balance_k"])
