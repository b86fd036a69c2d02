"""Drift, time contracts, snapshots and row recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import drift, evaluate, timing
from asofkit.queries.profile_queries import long_sql, pr_sql
from asofkit.queries.registry import query
from asofkit.queries.scores import AUROC, runs_sql, scored_lines, with_scores
from asofkit.queries.wide import wide, with_wide

DCOLS = ["quantity", "discount", "price"]


def halves(t):
    s = scored_lines(t)
    late = F.col("index_date") >= F.lit("1998-06-01").cast("date")
    # NULL prices in the later half, so that the missing bin moves too
    s = s.withColumn("price", F.when(~(late & (F.col("tax") > 0.07)), F.col("price")))
    return s.where(~late), s.where(late)


HALVES_SQL = """ls AS (SELECT y, p, quantity, discount, CASE WHEN NOT (index_date >= DATE '1998-06-01' AND tax > 0.07) THEN price END AS price, index_date FROM lscored),
old AS (SELECT * FROM ls WHERE index_date < DATE '1998-06-01'), new AS (SELECT * FROM ls WHERE index_date >= DATE '1998-06-01')"""
BIN_SQL = HALVES_SQL + f""", ol AS ({long_sql('old', DCOLS, '')}), nl AS ({long_sql('new', DCOLS, '')}),
ed AS (SELECT column_name, list_sort(list_distinct([{', '.join(f'quantile_cont(value, {i / 10})' for i in range(1, 10))}])) AS edges FROM ol WHERE value IS NOT NULL GROUP BY 1),
bins AS (SELECT column_name, unnest(list_concat(list_transform(generate_series(0, len(edges)), lambda i: CAST(i AS VARCHAR)), ['missing'])) AS bin FROM ed),
ob AS (SELECT ol.column_name, CASE WHEN value IS NULL THEN 'missing' ELSE CAST(len(list_filter(edges, lambda e: e <= value)) AS VARCHAR) END AS bin, count(*) AS n FROM ol JOIN ed ON ol.column_name = ed.column_name GROUP BY ALL),
nb AS (SELECT nl.column_name, CASE WHEN value IS NULL THEN 'missing' ELSE CAST(len(list_filter(edges, lambda e: e <= value)) AS VARCHAR) END AS bin, count(*) AS n FROM nl JOIN ed ON nl.column_name = ed.column_name GROUP BY ALL),
os AS (SELECT b.column_name, b.bin, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY b.column_name) AS share FROM bins b LEFT JOIN ob ON b.column_name = ob.column_name AND b.bin = ob.bin),
ns AS (SELECT b.column_name, b.bin, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY b.column_name) AS share FROM bins b LEFT JOIN nb ON b.column_name = nb.column_name AND b.bin = nb.bin),
fl AS (SELECT os.column_name, greatest(os.share, 0.0001) AS e, greatest(ns.share, 0.0001) AS a FROM os JOIN ns ON os.column_name = ns.column_name AND os.bin = ns.bin),
nm AS (SELECT column_name, e / sum(e) OVER (PARTITION BY column_name) AS e, a / sum(a) OVER (PARTITION BY column_name) AS a FROM fl),
ps AS (SELECT column_name, sum((a - e) * ln(a / e)) AS psi FROM nm GROUP BY 1)"""


@query("reference_profile", "A44 A45", "column_name:s bin:s n:l share:f", with_scores(BIN_SQL + " SELECT column_name, bin, n, share FROM os"))
def _(t):
    old, _ = halves(t)
    return drift.bin_shares(old, DCOLS, drift.decile_edges(old, DCOLS))


@query("population_stability", "A43", "column_name:s psi:f", with_scores(BIN_SQL + " SELECT * FROM ps"))
def _(t):
    old, new = halves(t)
    edges = drift.decile_edges(old, DCOLS)
    return drift.psi(drift.bin_shares(old, DCOLS, edges), drift.bin_shares(new, DCOLS, edges))


@query("category_stability", "A43 A44", "column_name:s bin:s n:l share:f", with_wide("""
c AS (SELECT 'segment' AS column_name, segment AS bin FROM wide UNION ALL SELECT 'n_urgent', coalesce(CAST(n_urgent AS VARCHAR), 'missing') FROM wide), k AS (SELECT column_name, bin, count(*) AS n FROM c GROUP BY ALL),
d AS (SELECT * FROM (VALUES ('segment', 'BUILDING'), ('segment', 'FURNITURE'), ('segment', 'missing'), ('n_urgent', '0'), ('n_urgent', '1'), ('n_urgent', '9'), ('n_urgent', 'missing')) v(column_name, bin))
SELECT d.column_name, d.bin, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM wide) AS share FROM d LEFT JOIN k ON d.column_name = k.column_name AND d.bin = k.bin"""))
def _(t):
    return drift.level_shares(wide(t), {"segment": ["BUILDING", "FURNITURE"], "n_urgent": ["0", "1", "9"]})


@query("drift_report", "A46", "column_name:s psi:f missing_reference:f missing_current:f status:s", with_scores(BIN_SQL + """
SELECT ps.column_name, psi, o.share AS missing_reference, n.share AS missing_current, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 OR abs(n.share - o.share) >= 0.05 THEN 'warn' ELSE 'ok' END AS status
FROM ps JOIN os o ON ps.column_name = o.column_name AND o.bin = 'missing' JOIN ns n ON ps.column_name = n.column_name AND n.bin = 'missing'"""))
def _(t):
    old, new = halves(t)
    return drift.feature_drift(old, new, DCOLS)


@query("drift_worst_status", "A46", "worst:s features:l", with_scores(BIN_SQL + """,
st AS (SELECT CASE WHEN psi >= 0.25 THEN 2 WHEN psi >= 0.1 OR abs(n.share - o.share) >= 0.05 THEN 1 ELSE 0 END AS s FROM ps JOIN os o ON ps.column_name = o.column_name AND o.bin = 'missing' JOIN ns n ON ps.column_name = n.column_name AND n.bin = 'missing')
SELECT CASE max(s) WHEN 2 THEN 'alert' WHEN 1 THEN 'warn' ELSE 'ok' END AS worst, count(*) AS features FROM st"""))
def _(t):
    old, new = halves(t)
    return drift.feature_drift(old, new, DCOLS).agg(drift.worst(F.col("status")).alias("worst"), F.count(F.lit(1)).alias("features"))


@query("performance_drift", "A46", "metric:s reference:f current:f change:f status:s", with_scores(HALVES_SQL + ", " + runs_sql("old", name="ro") + ", " + runs_sql("new", name="rn") + f""",
m AS (SELECT 'auroc' AS metric, (SELECT {AUROC} FROM ro) AS reference, (SELECT {AUROC} FROM rn) AS current, 0.02 AS w, 0.05 AS a UNION ALL
 SELECT 'prevalence', (SELECT avg(y) FROM old), (SELECT avg(y) FROM new), 0.02, 0.1 UNION ALL SELECT 'oe_ratio', (SELECT sum(y) / sum(p) FROM old), (SELECT sum(y) / sum(p) FROM new), 0.1, 0.25)
SELECT metric, reference, current, current - reference AS change, CASE WHEN abs(current - reference) >= a THEN 'alert' WHEN abs(current - reference) >= w THEN 'warn' ELSE 'ok' END AS status FROM m"""))
def _(t):
    old, new = halves(t)
    both = [evaluate.side_by_side([evaluate.point_metrics(h), evaluate.ranking_metrics(h)], []) for h in (old, new)]
    return drift.performance_drift(both[0], both[1], {"auroc": (0.02, 0.05), "prevalence": (0.02, 0.1), "oe_ratio": (0.1, 0.25)})


@query("predictor_shift", "A47", "column_name:s kind:s mean_old:f mean_new:f p50_old:f p50_new:f smd:f psi:f verdict:s reason:s", with_scores(BIN_SQL + f""",
oo AS (SELECT column_name, bin, n / sum(n) OVER (PARTITION BY column_name) AS share FROM os WHERE bin <> 'missing'), nn AS (SELECT column_name, bin, n / sum(n) OVER (PARTITION BY column_name) AS share FROM ns WHERE bin <> 'missing'),
pp AS (SELECT oo.column_name, sum((greatest(nn.share, 0.0001) - greatest(oo.share, 0.0001)) * ln(greatest(nn.share, 0.0001) / greatest(oo.share, 0.0001))) AS psi FROM oo JOIN nn ON oo.column_name = nn.column_name AND oo.bin = nn.bin GROUP BY 1),
sa AS (SELECT column_name, count(*) AS rows, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS p50 FROM ol GROUP BY 1),
sb AS (SELECT column_name, count(*) AS rows, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS p50 FROM nl GROUP BY 1)
SELECT sa.column_name, CASE WHEN sa.column_name = 'quantity' THEN 'count' ELSE 'continuous' END AS kind, sa.mean AS mean_old, sb.mean AS mean_new, sa.p50 AS p50_old, sb.p50 AS p50_new, (sb.mean - sa.mean) / sqrt((sa.sd * sa.sd + sb.sd * sb.sd) / 2) AS smd, psi,
 CASE WHEN abs(sa.n / sa.rows - sb.n / sb.rows) * 100 > 10 OR psi > 0.25 THEN 'WARN' ELSE 'OK' END AS verdict, concat_ws('; ', CASE WHEN abs(sa.n / sa.rows - sb.n / sb.rows) * 100 > 10 THEN 'missingness' END, CASE WHEN psi > 0.25 THEN 'stability index' END) AS reason
FROM sa JOIN sb ON sa.column_name = sb.column_name JOIN pp ON sa.column_name = pp.column_name"""))
def _(t):
    old, new = halves(t)
    return drift.predictor_shift(old, new, {"quantity": "count", "discount": "continuous", "price": "continuous"})


# ------------------------------------------------------------------ timing
DATES = ["last_order_date", "followup_end", "death_date"]
SENT = {"followup_end": ["2999-12-31"]}
OFF_SQL = """of AS (SELECT 'last_order_date' AS column_name, last_order_date - index_date AS o, eligible, y, split FROM wide UNION ALL
 SELECT 'followup_end', CASE WHEN followup_end <> DATE '2999-12-31' THEN followup_end - index_date END, eligible, y, split FROM wide UNION ALL SELECT 'death_date', death_date - index_date, eligible, y, split FROM wide)"""


@query("timing_diagnostic", "A12", "column_name:s n_observed:l n_before:l n_on:l n_after:l affected_eligible:l affected_labelled:l rate_affected:f rate_clean:f min_offset:l max_offset:l median_offset:f p90_offset:f p99_offset:f root_cause:s", with_wide(OFF_SQL + """,
s AS (SELECT column_name, count(o) AS n_observed, count_if(o < 0) AS n_before, count_if(o = 0) AS n_on, count_if(o > 0) AS n_after, count_if(o >= 0 AND eligible = 1) AS affected_eligible, count_if(o >= 0 AND eligible = 1 AND y IS NOT NULL) AS affected_labelled,
 avg(y) FILTER (WHERE o >= 0 AND eligible = 1) AS rate_affected, avg(y) FILTER (WHERE eligible = 1 AND NOT coalesce(o >= 0, false)) AS rate_clean, min(o) FILTER (WHERE o >= 0) AS min_offset, max(o) FILTER (WHERE o >= 0) AS max_offset,
 quantile_cont(o, 0.5) FILTER (WHERE o >= 0) AS median_offset, quantile_cont(o, 0.9) FILTER (WHERE o >= 0) AS p90_offset, quantile_cont(o, 0.99) FILTER (WHERE o >= 0) AS p99_offset FROM of GROUP BY 1)
SELECT *, CASE WHEN n_on + n_after = 0 THEN 'CLEAN' WHEN n_after = 0 THEN 'SAME_DAY_INCLUSION' WHEN n_on = 0 THEN 'FUTURE_RECORDS' ELSE 'SAME_DAY_AND_FUTURE' END AS root_cause FROM s"""))
def _(t):
    return timing.timing_diagnostic(wide(t), DATES, "index_date", eligible="eligible", y="y", sentinels=SENT)


TIMINGS = {"last_order_date": "pre_index", "followup_end": "post_index", "death_date": "unknown"}


@query("temporal_audit", "A13", "column_name:s n_observed:l n_before:l n_equal:l n_after:l eligible_on_or_after:l within_week:l p01:f p05:f p50:f p95:f p99:f timing:s risk:s", with_wide(OFF_SQL + """,
s AS (SELECT column_name, count(o) AS n_observed, count_if(o < 0) AS n_before, count_if(o = 0) AS n_equal, count_if(o > 0) AS n_after, count_if(o >= 0 AND eligible = 1) AS eligible_on_or_after, count_if(o BETWEEN -7 AND -1) AS within_week,
 quantile_cont(o, 0.01) AS p01, quantile_cont(o, 0.05) AS p05, quantile_cont(o, 0.5) AS p50, quantile_cont(o, 0.95) AS p95, quantile_cont(o, 0.99) AS p99 FROM of GROUP BY 1)
SELECT *, CASE column_name WHEN 'last_order_date' THEN 'pre_index' WHEN 'followup_end' THEN 'post_index' ELSE 'unknown' END AS timing,
 CASE column_name WHEN 'followup_end' THEN 'POST_INDEX_BY_DESIGN' WHEN 'death_date' THEN 'TIMING_UNKNOWN' ELSE CASE WHEN eligible_on_or_after > 0 THEN 'PROVEN_INDEX_DAY_OR_FUTURE_RECORDS' ELSE 'CLEAN_IN_THIS_EXTRACT' END END AS risk FROM s"""))
def _(t):
    return timing.temporal_audit(wide(t), TIMINGS, "index_date", eligible="eligible", sentinels=SENT, buckets=[("within_week", -7, -1)])


@query("companion_agreement", "A12 A54", "column_name:s both:l equal:l negative:l share_equal:f", with_wide("""
SELECT 'last_order_date' AS column_name, count(days_since) AS "both", count_if(days_since = index_date - last_order_date) AS equal, count_if(days_since < 0) AS negative, count_if(days_since = index_date - last_order_date) / count(days_since) AS share_equal FROM wide"""))
def _(t):
    return timing.companion_agreement(wide(t), {"last_order_date": "days_since"}, "index_date")


@query("source_timing", "A14 A73", "source:s split:s n_before:l n_on:l n_after:l n_null:l max_days_after:l root_cause:s", with_wide("""
o AS (SELECT 'orders' AS source, split, last_order_date - index_date AS o FROM wide UNION ALL SELECT 'deaths', split, death_date - index_date FROM wide),
s AS (SELECT source, split, count_if(o < 0) AS n_before, count_if(o = 0) AS n_on, count_if(o > 0) AS n_after, count_if(o IS NULL) AS n_null, coalesce(max(o) FILTER (WHERE o > 0), 0) AS max_days_after FROM o GROUP BY ALL)
SELECT *, CASE WHEN n_after > 0 THEN 'POST_INDEX_RECORDS' WHEN n_on > 0 THEN 'CLEAN_UNDER_END_OF_DAY' ELSE 'CLEAN' END AS root_cause FROM s"""))
def _(t):
    return timing.source_timing(wide(t), {"orders": "last_order_date", "deaths": "death_date"}, "index_date", "split")


@query("post_index_rows", "A15", "column_name:s rows_after:l rows:l", with_wide("""
SELECT 'any' AS column_name, count_if(coalesce(last_order_date > index_date, false) OR coalesce(death_date > index_date, false)) AS rows_after, count(*) AS rows FROM wide UNION ALL
SELECT 'last_order_date', count_if(last_order_date > index_date), count(last_order_date) FROM wide UNION ALL SELECT 'death_date', count_if(death_date > index_date), count(death_date) FROM wide"""))
def _(t):
    return timing.post_index_rows(wide(t), ["last_order_date", "death_date"], "index_date")


@query("outcome_contract", "A52 J07", "check_name:s n:l allowed:f verdict:s", with_wide("""
a AS (SELECT greatest(count_if(y = 1), 1) AS np, greatest(count(y), 1) AS nl, count_if(y = 1) AS pos, count_if(y = 1 AND days_to_event < 1) AS o1, count_if(window_end - index_date <> 180) AS o2, count_if(y = 1 AND event_date - index_date > 180) AS o3,
 count_if(y = 1 AND followup_end IS NOT NULL AND year(followup_end) < 2900 AND event_date > followup_end) AS o4, count_if((y = 1 AND event_date IS NULL) OR (y = 0 AND event_date - index_date BETWEEN 1 AND 180)) AS o5 FROM wide),
c AS (SELECT 'O1_event_before_window' AS check_name, o1 AS n, 0.0 AS allowed FROM a UNION ALL SELECT 'O2_window_end', o2, 0 FROM a UNION ALL SELECT 'O3_event_after_window', o3, 0 FROM a UNION ALL
 SELECT 'O4_event_after_followup', o4, CAST(0.01 AS DOUBLE) * np FROM a UNION ALL SELECT 'O5_label_date_inconsistent', o5, CAST(0.001 AS DOUBLE) * nl FROM a UNION ALL SELECT 'O6_missing_events', greatest(100 - pos, 0), 0 FROM a)
SELECT *, CASE WHEN n <= allowed THEN 'PASS' ELSE 'STOP' END AS verdict FROM c"""))
def _(t):
    return timing.outcome_contract(wide(t), y="y", event="event_date", days="days_to_event", index="index_date", end="window_end", followup="followup_end", window=180,
                                   max_followup_share=0.01, max_inconsistent_share=0.001, min_events=100)


@query("followup_zero_tolerance", "A53", "positives:l after_followup:l open_followup:l verdict:s", with_wide("""
a AS (SELECT count_if(y = 1) AS positives, count_if(y = 1 AND year(followup_end) < 2900 AND event_date > followup_end) AS after_followup, count_if(y = 1 AND (followup_end IS NULL OR year(followup_end) >= 2900)) AS open_followup FROM wide)
SELECT *, CASE WHEN after_followup = 0 THEN 'PASS' ELSE 'STOP' END AS verdict FROM a"""))
def _(t):
    return timing.followup_zero_tolerance(wide(t), y="y", event="event_date", followup="followup_end")


@query("time_contract_checks", "A54", "check_name:s n:l", with_wide("""
SELECT 'positive_outside_window' AS check_name, count_if(y = 1 AND NOT (event_date - index_date BETWEEN 1 AND 180)) AS n FROM wide UNION ALL SELECT 'window_end', count_if(window_end - index_date <> 180) FROM wide UNION ALL
SELECT 'post_index_records', count_if(last_order_date > index_date) FROM wide UNION ALL SELECT 'day_count:days_since', count_if(days_since <> index_date - last_order_date) FROM wide UNION ALL
SELECT 'indicator:eligible', count_if((eligible = 1) <> (nation_code <> 7)) FROM wide"""))
def _(t):
    return timing.time_contract_checks(wide(t), y="y", event="event_date", index="index_date", end="window_end", window=180, date_cols=["last_order_date"],
                                       companions={"last_order_date": "days_since"}, indicators={"eligible": "nation_code <> 7"})


@query("episode_recency_bands", "A55", "band:s n:l events:l early_events:l gap_le_7:l event_rate:f early_share:f", with_wide("""
b AS (SELECT *, index_date - last_order_date AS s FROM wide), c AS (SELECT CASE WHEN s IS NULL THEN 'no prior event' WHEN s < 0 THEN 'after index' WHEN s = 0 THEN '0' WHEN s <= 7 THEN '1-7' WHEN s <= 30 THEN '8-30' WHEN s <= 90 THEN '31-90' WHEN s <= 180 THEN '91-180' WHEN s <= 365 THEN '181-365' ELSE '>365' END AS band,
 count(*) AS n, count_if(y = 1) AS events, count_if(y = 1 AND event_date - index_date <= 14) AS early_events, count_if(y = 1 AND event_date - last_order_date <= 7) AS gap_le_7 FROM b GROUP BY 1)
SELECT *, events / n AS event_rate, early_events / nullif(events, 0) AS early_share FROM c"""))
def _(t):
    return timing.episode_bands(wide(t), y="y", event="event_date", index="index_date", last="last_order_date")


@query("death_label_audit", "A56", "deaths:l deaths_in_window:l events:l non_events:l unlabelled:l overwrite_suspected:b", with_wide("""
a AS (SELECT count(death_date) AS deaths, count_if(death_date - index_date BETWEEN 0 AND 180) AS deaths_in_window, count_if(death_date - index_date BETWEEN 0 AND 180 AND y = 1) AS events, count_if(death_date - index_date BETWEEN 0 AND 180 AND y = 0) AS non_events,
 count_if(death_date - index_date BETWEEN 0 AND 180 AND y IS NULL) AS unlabelled FROM wide) SELECT *, deaths_in_window >= 50 AND events = 0 AS overwrite_suspected FROM a"""))
def _(t):
    return timing.death_label_audit(wide(t), y="y", death="death_date", index="index_date", window=180)


SNAP_SQL = """sn AS (SELECT index_date, count(*) AS rows, count(DISTINCT entity_id) AS entities, count_if(eligible = 1) AS eligible_rows, count_if(eligible = 1 AND y IS NOT NULL) AS labelled, count_if(eligible = 1 AND y IS NULL) AS censored,
 count_if(eligible = 1 AND y IS NOT NULL AND ((y = 1 AND event_date IS NULL) OR (y = 0 AND event_date IS NOT NULL))) AS invalid, count_if(eligible = 1 AND y = 1) AS events, count_if(eligible = 1 AND coalesce(last_order_date >= index_date, false)) AS violations FROM wide GROUP BY 1)"""


@query("snapshot_audit", "A11", "index_date:d rows:l entities:l eligible_rows:l labelled:l censored:l invalid:l events:l violations:l window_end:d reason:s status:s", with_wide(SNAP_SQL + """,
r AS (SELECT *, index_date + 180 AS window_end, concat_ws('; ', CASE WHEN eligible_rows = 0 THEN 'no eligible rows' END, CASE WHEN eligible_rows > 0 AND labelled = 0 THEN 'no usable label' END, CASE WHEN labelled > 0 AND censored / eligible_rows > 0.5 THEN 'censored share' END,
 CASE WHEN invalid > 0 THEN 'invalid labels' END, CASE WHEN index_date + 180 > DATE '1999-06-30' THEN 'window after freeze' END) AS reason FROM sn)
SELECT *, CASE WHEN reason = '' THEN 'USABLE' ELSE 'EXCLUDED' END AS status FROM r"""))
def _(t):
    return timing.snapshot_audit(wide(t), index="index_date", entity="entity_id", eligible="eligible", y="y", event="event_date", date_cols=["last_order_date"], horizon=180, freeze="1999-06-30")


MONTH_SQL = """mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS index_date, count(*) AS rows, count_if(o_orderstatus = 'F') AS events FROM orders GROUP BY 1),
rv AS (SELECT *, sum(rows) OVER (ORDER BY index_date DESC) AS cr, sum(events) OVER (ORDER BY index_date DESC) AS ce, row_number() OVER (ORDER BY index_date DESC) AS k, sum(rows) OVER () AS t, count(*) OVER () AS m FROM mo),
ft AS (SELECT max(index_date) AS ft FROM rv WHERE (cr >= 0.2 * t AND ce >= 50) OR k >= m - 2),
ea AS (SELECT index_date, events FROM mo, ft WHERE index_date < ft),
fe AS (SELECT d.index_date AS d, coalesce(sum(x.events) FILTER (WHERE x.index_date >= d.index_date AND x.index_date + 180 < ft), 0) AS ve, coalesce(sum(x.events) FILTER (WHERE x.index_date < d.index_date AND x.index_date + 180 < d.index_date), 0) AS te FROM ea d, ea x, ft GROUP BY 1),
bd AS (SELECT max(d) AS b FROM fe WHERE ve >= 30 AND te >= 100)"""


@query("temporal_design", "W16", "index_date:d rows:l events:l part:s", f"""WITH {MONTH_SQL}
SELECT index_date, rows, events, CASE WHEN index_date >= ft THEN 'test' WHEN index_date >= b THEN CASE WHEN index_date + 180 < ft THEN 'validation' ELSE 'validation (embargoed)' END WHEN index_date < b THEN CASE WHEN index_date + 180 < b THEN 'train' ELSE 'train (embargoed)' END END AS part FROM mo, ft, bd""")
def _(t):
    mo = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("index_date")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("events"), F.lit("USABLE").alias("status"))
    return timing.temporal_design(mo, "index_date", horizon=180, test_share=0.2, min_test=50, min_validation=30, min_train=100)


# ------------------------------------------------------------------ row recovery
FEATURES = {"orders_90": ("n90", "last_order_date"), "orders_365": ("n365", "last_order_date"), "price": ("mean_price", "last_order_date"), "urgent": ("n_urgent", "death_date")}


REG_SQL = with_wide("r AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) AS rows, count_if(coalesce({d} > index_date, false) OR (coalesce({v} <> 0, false) AND {d} IS NULL)) AS n_unknown, count_if({d} IS NOT NULL AND NOT coalesce({d} > index_date, false)) AS n_informative,
 count({v}) FILTER (WHERE split = 'train' AND NOT (coalesce({d} > index_date, false) OR (coalesce({v} <> 0, false) AND {d} IS NULL))) AS n_known_train, coalesce(min({v}) FILTER (WHERE split = 'train' AND NOT (coalesce({d} > index_date, false) OR (coalesce({v} <> 0, false) AND {d} IS NULL))) = max({v}) FILTER (WHERE split = 'train' AND NOT (coalesce({d} > index_date, false) OR (coalesce({v} <> 0, false) AND {d} IS NULL))), true) AS cst, count_if({d} = index_date) AS n_on, count_if({d} > index_date) AS n_after, count_if(coalesce({v} <> 0, false) AND {d} IS NULL) AS n_undated FROM wide"""
    for f, (v, d) in FEATURES.items()) + """), s AS (SELECT *, n_unknown / rows AS unknown_share, n_unknown / greatest(1, n_unknown + n_informative) AS unknown_share_informative FROM r)
SELECT *, CASE WHEN n_known_train < 50 OR cst THEN 'NOT_RECOVERABLE_DATA' WHEN n_unknown > 0 AND (unknown_share > 0.05 OR unknown_share_informative > 0.2) THEN 'NOT_RECOVERABLE_FUTURE' WHEN n_unknown > 0 THEN 'SAFE_BOUNDED' ELSE 'SAFE_VERIFIED' END AS gate_class FROM s""")


@query("recovery_registry", "A60 A66", "feature:s rows:l n_unknown:l n_informative:l n_known_train:l n_on:l n_after:l n_undated:l unknown_share:f unknown_share_informative:f gate_class:s", REG_SQL)
def _(t):
    return timing.recovery_registry(wide(t), FEATURES, "index_date", train=F.col("split") == "train", min_known=50, max_population=0.05, max_informative=0.2)


@query("unknown_masks", "A60 P52", "orders_90:b price:b urgent:b n:l", with_wide("""
SELECT coalesce(last_order_date > index_date, false) OR (coalesce(n90 <> 0, false) AND last_order_date IS NULL) AS orders_90, coalesce(last_order_date > index_date, false) OR (coalesce(mean_price <> 0, false) AND last_order_date IS NULL) AS price,
 coalesce(death_date > index_date, false) OR (coalesce(n_urgent <> 0, false) AND death_date IS NULL) AS urgent, count(*) AS n FROM wide GROUP BY ALL"""))
def _(t):
    return timing.unknown_masks(wide(t), FEATURES, "index_date", ["entity_id", "index_date"]).groupBy("orders_90", "price", "urgent").agg(F.count(F.lit(1)).alias("n"))


@query("remediation_rows", "A61", "source:s n_blocked:l blocked:s n_bounded:l bounded:s", f"""
SELECT source, count_if(gate_class LIKE 'NOT_RECOVERABLE%') AS n_blocked, coalesce(string_agg(feature, '; ' ORDER BY feature) FILTER (WHERE gate_class LIKE 'NOT_RECOVERABLE%'), '') AS blocked,
 count_if(gate_class = 'SAFE_BOUNDED') AS n_bounded, coalesce(string_agg(feature, '; ' ORDER BY feature) FILTER (WHERE gate_class = 'SAFE_BOUNDED'), '') AS bounded
FROM ({REG_SQL}) g JOIN (SELECT * FROM (VALUES ('orders_90', 'orders'), ('orders_365', 'orders'), ('price', 'orders'), ('price', 'prices'), ('urgent', 'deaths'), ('urgent', 'orders')) v(f, source)) m ON g.feature = m.f
GROUP BY 1 HAVING count_if(gate_class LIKE 'NOT_RECOVERABLE%') + count_if(gate_class = 'SAFE_BOUNDED') > 0""")
def _(t):
    reg = timing.recovery_registry(wide(t), FEATURES, "index_date", train=F.col("split") == "train", min_known=50, max_population=0.05, max_informative=0.2)
    src = t.spark.createDataFrame([("orders_90", "orders"), ("orders_365", "orders"), ("price", "orders; prices"), ("urgent", "deaths; orders")], "feature string, sources string")
    return timing.remediation(reg, src)


@query("selection_bias_by_source", "A62", "column_name:s n1:l e1:l n0:l e0:l rate_affected:f rate_other:f ratio:f ratio_low:f ratio_high:f", with_wide("""
o AS (SELECT 'last_order_date' AS column_name, coalesce(last_order_date >= index_date, false) AS h, y FROM wide WHERE y IS NOT NULL UNION ALL SELECT 'death_date', coalesce(death_date >= index_date, false), y FROM wide WHERE y IS NOT NULL),
s AS (SELECT column_name, CAST(count_if(h) AS DOUBLE) AS n1, CAST(coalesce(sum(y) FILTER (WHERE h), 0) AS DOUBLE) AS e1, CAST(count_if(NOT h) AS DOUBLE) AS n0, CAST(coalesce(sum(y) FILTER (WHERE NOT h), 0) AS DOUBLE) AS e0 FROM o GROUP BY 1)
SELECT *, e1 / nullif(n1, 0) AS rate_affected, e0 / nullif(n0, 0) AS rate_other, """ + pr_sql("e1", "n1", "e0", "n0") + " FROM s"))
def _(t):
    return timing.selection_bias(wide(t).where("y IS NOT NULL"), ["last_order_date", "death_date"], "index_date", "y")


@query("domain_feasibility", "A63", "domain:s rows:l events:l decision:s", with_wide("""
SELECT 'history' AS domain, count_if(mean_price IS NOT NULL OR last_order_date IS NOT NULL) AS rows, sum(y) FILTER (WHERE mean_price IS NOT NULL OR last_order_date IS NOT NULL) AS events,
 CASE WHEN count_if(mean_price IS NOT NULL OR last_order_date IS NOT NULL) >= 100 AND sum(y) FILTER (WHERE mean_price IS NOT NULL OR last_order_date IS NOT NULL) >= 50 THEN 'GO' ELSE 'NO_GO' END AS decision FROM wide WHERE y IS NOT NULL UNION ALL
SELECT 'ends', count_if(followup_end IS NOT NULL), sum(y) FILTER (WHERE followup_end IS NOT NULL), CASE WHEN count_if(followup_end IS NOT NULL) >= 100 AND sum(y) FILTER (WHERE followup_end IS NOT NULL) >= 50 THEN 'GO' ELSE 'NO_GO' END FROM wide WHERE y IS NOT NULL"""))
def _(t):
    return timing.feasibility(wide(t).where("y IS NOT NULL"), {"history": ["mean_price", "last_order_date"], "ends": ["followup_end"]}, "y", min_rows=100, min_events=50)


@query("profile_bounds", "J14", "row:s lo:f hi:f fallback:b", with_wide("""
pr AS (SELECT DISTINCT n90, n_urgent, 0.3 * n90 - 0.2 * coalesce(n_urgent, 5) AS c FROM wide WHERE split = 'train'), un AS (SELECT CAST(entity_id AS VARCHAR) || '|' || CAST(index_date AS VARCHAR) AS row, n90, n_urgent FROM wide WHERE coalesce(last_order_date >= index_date, false)),
b AS (SELECT row, min(c) AS lo, max(c) AS hi FROM un u JOIN pr p ON (u.n90 IS NULL OR p.n90 <= u.n90) AND (u.n_urgent IS NULL OR p.n_urgent <= u.n_urgent) GROUP BY 1)
SELECT un.row, coalesce(lo, (SELECT min(c) FROM pr)) AS lo, coalesce(hi, (SELECT max(c) FROM pr)) AS hi, lo IS NULL AS fallback FROM un LEFT JOIN b ON un.row = b.row"""))
def _(t):
    w = wide(t).withColumn("row", F.concat_ws("|", "entity_id", "index_date"))
    prof = timing.state_profiles(w.where("split = 'train'"), ["n90", "n_urgent"], 0.3 * F.col("n90") - 0.2 * F.coalesce("n_urgent", F.lit(5)))
    return timing.profile_bounds(w.where("coalesce(last_order_date >= index_date, false)"), prof, ["n90", "n_urgent"], "row")
