"""Comparison queries: paired rows, cohorts, runs, decisions, composite jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions import scalars, suppress
from asofkit.functions.hashing import content_sql
from asofkit.operators import capacity, compare, contracts, evaluate, resample, splits
from asofkit.plans import cohorts
from asofkit.queries.evaluate_queries import FOLD_SQL, MODELS_SQL, models_long
from asofkit.queries.registry import Tables, query
from asofkit.queries.resample_queries import B, PLAN, REP_SQL, SEED, TSPLIT_SQL
from asofkit.queries.scores import AP, AUROC, runs_sql, scored, with_scores
from asofkit.queries.wide import raw_text, RAW_SQL, wide, with_wide
from asofkit.sources import tables

EARLY, LATE = "year <= 1998", "year >= 1998"


@query("same_rows_check", "J10", "both:l only_a:l only_b:l outcome_differs:l", with_scores("""
a AS (SELECT * FROM scored WHERE year <= 1998), b AS (SELECT *, CASE WHEN priority = '5-LOW' THEN 0 ELSE y END AS y2 FROM scored WHERE year >= 1998)
SELECT count_if(a.row_key IS NOT NULL AND b.row_key IS NOT NULL) AS "both", count_if(b.row_key IS NULL) AS only_a, count_if(a.row_key IS NULL) AS only_b, count_if(a.y <> b.y2) AS outcome_differs FROM a FULL JOIN b ON a.row_key = b.row_key"""))
def _(t):
    s = scored(t)
    b = s.where(LATE).withColumn("y", F.when(F.col("priority") == "5-LOW", 0).otherwise(F.col("y")))
    return compare.same_rows(s.where(EARLY), b, ["row_key"], "y")


@query("paired_predictions", "J11 J22 S16", "row_key:l y:l p_a:f p_b:f", with_scores("SELECT row_key, y, p AS p_a, p_ref AS p_b FROM scored"))
def _(t):
    s = scored(t)
    return compare.paired_predictions(s, s.select("row_key", F.col("p_ref").alias("p")), ["row_key"])


@query("cohort_overlap", "J12", "both:l only_earlier:l only_later:l", with_scores("""
a AS (SELECT DISTINCT entity_id FROM scored WHERE year <= 1996), b AS (SELECT DISTINCT entity_id FROM scored WHERE year >= 2000)
SELECT count_if(a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL) AS "both", count_if(b.entity_id IS NULL) AS only_earlier, count_if(a.entity_id IS NULL) AS only_later FROM a FULL JOIN b ON a.entity_id = b.entity_id"""))
def _(t):
    s = scored(t)
    return compare.cohort_overlap(s.where("year <= 1996"), s.where("year >= 2000"), "entity_id")


@query("seen_before_flag", "J12 C12", "seen_before:b rows:l events:l", with_scores("""
SELECT entity_id IN (SELECT entity_id FROM scored WHERE year <= 1996) AS seen_before, count(*) AS rows, sum(y) AS events FROM scored WHERE year >= 2000 GROUP BY 1"""))
def _(t):
    s = scored(t)
    return compare.seen_before(s.where("year >= 2000"), s.where("year <= 1996"), "entity_id").groupBy("seen_before").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("events"))


@query("rows_differ_report", "J13 C03", "item:s n:l", with_scores("""
a AS (SELECT row_key, p, priority FROM scored WHERE year <= 1999), b AS (SELECT row_key, CASE WHEN y = 1 THEN p + 1 ELSE p END AS p, CASE WHEN year = 1997 THEN NULL ELSE priority END AS priority FROM scored WHERE year >= 1997),
j AS (SELECT a.row_key AS ka, b.row_key AS kb, a.p AS pa, b.p AS pb, a.priority AS ra, b.priority AS rb FROM a FULL JOIN b ON a.row_key = b.row_key)
SELECT 'p' AS item, count_if(ka IS NOT NULL AND kb IS NOT NULL AND pa IS DISTINCT FROM pb) AS n FROM j UNION ALL SELECT 'priority', count_if(ka IS NOT NULL AND kb IS NOT NULL AND ra IS DISTINCT FROM rb) FROM j UNION ALL
SELECT '(shared rows)', count_if(ka IS NOT NULL AND kb IS NOT NULL) FROM j UNION ALL SELECT '(only a)', count_if(kb IS NULL) FROM j UNION ALL SELECT '(only b)', count_if(ka IS NULL) FROM j"""))
def _(t):
    s = scored(t)
    b = s.where("year >= 1997").withColumn("p", F.when(F.col("y") == 1, F.col("p") + 1).otherwise(F.col("p"))).withColumn("priority", F.when(F.col("year") != 1997, F.col("priority")))
    return cohorts.rebuild_matches(s.where("year <= 1999"), b, ["row_key"], ["p", "priority"])


@query("outcome_alignment", "J22", "scores:l outcomes:l aligned:l", with_scores("""
a AS (SELECT row_key FROM scored WHERE year >= 1996), b AS (SELECT row_key FROM scored WHERE year <= 2000) SELECT count(a.row_key) AS scores, count(b.row_key) AS outcomes, count_if(a.row_key IS NOT NULL AND b.row_key IS NOT NULL) AS aligned FROM a FULL JOIN b ON a.row_key = b.row_key"""))
def _(t):
    s = scored(t)
    return compare.alignment_check(s.where("year >= 1996"), s.where("year <= 2000"), "row_key")


@query("partition_alignment", "J21 S09", "split:s rows:l events:l mean_p:f", with_scores(TSPLIT_SQL + " SELECT split, count(*) AS rows, sum(y) AS events, avg(p) AS mean_p FROM s3 WHERE removed IS NULL AND split <> 'test' GROUP BY 1"))
def _(t):
    s = scored(t)
    assigned = splits.temporal_split(s, PLAN).where("removed IS NULL").select("row_key", "split")
    return s.join(assigned, "row_key").where("split <> 'test'").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("events"), F.avg("p").alias("mean_p"))


# ------------------------------------------------------------------ models compared: one per order priority
def per_priority(t: Tables) -> DataFrame:
    s = scored(t).withColumn("model", F.col("priority"))
    m = evaluate.ranking_metrics(s, ["model"]).join(evaluate.point_metrics(s, ["model"]), "model")
    curve = evaluate.decision_curve(s.withColumnRenamed("model", "mdl"), [0.3], ["mdl"])
    nb = curve.select(F.col("mdl").alias("model"), F.col("model").alias("net_benefit"), "treat_all")
    slope = evaluate.fit_calibration(s.withColumn("lp", F.log(F.col("p")) - F.log1p(-F.col("p"))), ["model"]).select("model", "slope")
    return m.join(nb, "model").join(slope, "model").withColumn("complexity", F.substring("model", 1, 1).cast("int"))


PRI_SQL = runs_sql("scored", keys="priority") + f""",
cal AS (SELECT priority AS b, 1 AS w, y, p, ln(p) - ln(1 - p) AS lp FROM scored),
it AS (SELECT 0 AS k, b, ln(sum(w * y) / sum(w * (1 - y))) AS ia, CAST(0.0 AS DOUBLE) AS ib FROM cal GROUP BY b
 UNION ALL SELECT k + 1, b, ia + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), ib + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
  (SELECT k, b, ia, ib, sum(y - mu) AS g0, sum((y - mu) * lp) AS g1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * lp) AS h01, sum(mu * (1 - mu) * lp * lp) AS h11 FROM
   (SELECT it.k, it.b, ia, ib, y, lp, 1 / (1 + exp(-(ia + ib * lp))) AS mu FROM it JOIN cal ON it.b = cal.b WHERE k < 12) GROUP BY k, b, ia, ib)),
rm AS (SELECT priority AS model, {AUROC} AS auroc, {AP} AS ap FROM runs GROUP BY 1),
pm AS (SELECT priority AS model, avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss, count_if(p >= 0.3 AND y = 1) / count(*) - count_if(p >= 0.3 AND y = 0) / count(*) * CAST(0.3 AS DOUBLE) / CAST(0.7 AS DOUBLE) AS net_benefit,
 avg(y) - (1 - avg(y)) * CAST(0.3 AS DOUBLE) / CAST(0.7 AS DOUBLE) AS treat_all FROM scored GROUP BY 1),
md AS (SELECT rm.model, CAST(rm.model[1] AS INTEGER) AS complexity, auroc, ap, brier, logloss, net_benefit, treat_all, it.ib AS slope FROM rm JOIN pm ON rm.model = pm.model JOIN it ON it.b = rm.model AND it.k = 12)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("best_run_selection", "L12 M27 C30", "model:s auroc:f brier:f slope:f net_benefit:f within_margin:b best_discrimination:b best_calibrated:b simplest_within_margin:b", recursive(with_scores(PRI_SQL + """,
w AS (SELECT *, abs(slope - 1) AS er, auroc >= max(auroc) OVER () - 0.02 - 1e-12 AND brier <= min(brier) OVER () + 0.01 + 1e-12 AND slope BETWEEN 0.2 AND 2 AND net_benefit > greatest(treat_all, 0) AS within_margin FROM md)
SELECT *, row_number() OVER (ORDER BY auroc DESC, model) = 1 AS best_discrimination, row_number() OVER (ORDER BY er, model) = 1 AS best_calibrated, within_margin AND row_number() OVER (ORDER BY within_margin DESC, complexity, er, auroc DESC, model) = 1 AS simplest_within_margin FROM w""")))
def _(t):
    return compare.best_runs(per_priority(t).select("model", "complexity", "auroc", "brier", "slope", "net_benefit", "treat_all"), auroc_margin=0.02, brier_margin=0.01, slope=(0.2, 2.0))


@query("model_selection_rule", "C19 C20", "model:s ap:f logloss:f passes:b candidate:b selected:b", recursive(with_scores(PRI_SQL + """,
r AS (SELECT ap AS rap, logloss AS rll FROM md WHERE model = '3-MEDIUM'), p AS (SELECT md.*, model <> '3-MEDIUM' AND ap - rap >= -0.02 AND logloss <= 1.01 * rll AND slope BETWEEN 0.2 AND 2 AS passes FROM md, r),
c AS (SELECT *, coalesce(passes AND ap >= max(ap) FILTER (WHERE passes) OVER () - 0.01, false) AS candidate FROM p)
SELECT model, ap, logloss, passes, candidate, candidate AND row_number() OVER (ORDER BY candidate DESC, complexity, ap DESC, model) = 1 AS selected FROM c""")))
def _(t):
    m = per_priority(t).select("model", "complexity", "ap", "logloss", "slope")
    return compare.select_model(m, reference="3-MEDIUM", min_ap_gain=-0.02, max_logloss_ratio=1.01, slope=(0.2, 2.0), margin=0.01).withColumn("candidate", F.coalesce("candidate", F.lit(False)))


@query("composite_objective", "M30", "model:s objective:f", recursive(with_scores(PRI_SQL + " SELECT model, 0.6 * auroc + 0.4 * ap - 0.5 * brier AS objective FROM md")))
def _(t):
    return per_priority(t).select("model", compare.composite({"auroc": 0.6, "ap": 0.4, "brier": -0.5}).alias("objective"))


def step_rows(t: Tables) -> DataFrame:
    s = scored(t).select("year", "y", "p")
    return evaluate.ranking_metrics(s, ["year"]).join(evaluate.point_metrics(s, ["year"]), "year").select(F.col("year").alias("step"), F.col("year").cast("string").alias("name"), "auroc", "brier")


STEP_SQL = runs_sql("scored", keys="year") + f", st AS (SELECT r.year AS step, auroc, brier FROM (SELECT year, {AUROC} AS auroc FROM runs GROUP BY 1) r JOIN (SELECT year, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1) b ON r.year = b.year)"


@query("step_changes", "M28 C23 W18", "step:l auroc:f brier:f auroc_vs_previous:f auroc_vs_baseline:f brier_vs_baseline:f", with_scores(STEP_SQL + """
SELECT *, auroc - lag(auroc) OVER (ORDER BY step) AS auroc_vs_previous, auroc - (SELECT auroc FROM st WHERE step = 1996) AS auroc_vs_baseline, brier - (SELECT brier FROM st WHERE step = 1996) AS brier_vs_baseline FROM st"""))
def _(t):
    return compare.step_changes(step_rows(t), "step", ["auroc", "brier"], "1996")


@query("learning_increments", "R26", "step:l gain:f gain_low:f plateau:b", with_scores(STEP_SQL + """, g AS (SELECT step, auroc - lag(auroc) OVER (ORDER BY step) AS gain FROM st)
SELECT step, gain, gain - 0.01 AS gain_low, gain < 0.005 OR gain - 0.01 <= 0 AS plateau FROM g"""))
def _(t):
    inc = compare.step_changes(step_rows(t), "step", ["auroc"], "1996").select("step", F.col("auroc_vs_previous").alias("gain"), (F.col("auroc_vs_previous") - 0.01).alias("gain_low"))
    return compare.trial_gain(inc, min_gain=0.005)


def yearly_runs(t: Tables) -> DataFrame:
    """A run per (year, priority) with nested metrics, as read from metrics files."""
    s = scored(t).select("year", "priority", "y", F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("p").alias("p")), F.struct(F.lit("ref").alias("variant"), F.col("p_ref").alias("p")))).alias("v"))
    flat = s.select("year", "priority", "y", "v.variant", "v.p")
    m = evaluate.point_metrics(flat, ["year", "priority", "variant"])
    metrics = F.create_map(F.lit("brier"), F.col("brier"), F.lit("oe_ratio"), F.col("oe_ratio"))
    per_variant = m.groupBy("year", "priority").agg(F.map_from_entries(F.collect_list(F.struct(F.col("variant").alias("key"), metrics.alias("value")))).alias("vs"))
    return (per_variant.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct(F.col("priority").alias("key"), F.col("vs").alias("value")))).alias("performance"))
            .select(F.col("year").cast("string").alias("run_id"), F.concat(F.col("year").cast("string"), F.lit("-12-31")).alias("created"),
                    F.when(F.col("year") < 2000, "d1").otherwise("d2").alias("data_hash"), F.lit("r1").alias("rows_hash"), F.lit("reference").alias("kind"), "performance"))


VAR_SQL = """v AS (SELECT year, priority, 'raw' AS variant, y, p FROM scored UNION ALL SELECT year, priority, 'ref', y, p_ref FROM scored),
vm AS (SELECT year, priority, variant, avg((p - y) * (p - y)) AS brier, sum(y) / sum(p) AS oe_ratio FROM v GROUP BY ALL),
vr AS (SELECT CAST(year AS VARCHAR) AS run_id, priority AS split, variant, 'brier' AS metric, brier AS value FROM vm UNION ALL SELECT CAST(year AS VARCHAR), priority, variant, 'oe_ratio', oe_ratio FROM vm)"""


@query("run_variant_rows", "C37 S13 M14", "run_id:s split:s variant:s metric:s value:f", with_scores(VAR_SQL + " SELECT * FROM vr"))
def _(t):
    return compare.variant_rows(yearly_runs(t))


@query("comparable_runs", "M27", "run_id:s data_hash:s comparable:b", with_scores("SELECT DISTINCT CAST(year AS VARCHAR) AS run_id, CASE WHEN year < 2000 THEN 'd1' ELSE 'd2' END AS data_hash, year < 2000 AS comparable FROM scored"))
def _(t):
    return compare.flag_comparable(yearly_runs(t).drop("performance"))


@query("latest_reference_run", "C31", "run_id:s auroc:f", with_scores(STEP_SQL + " SELECT CAST(step AS VARCHAR) AS run_id, auroc FROM st WHERE step = (SELECT max(step) FROM st WHERE step < 2000)"))
def _(t):
    runs = yearly_runs(t).drop("performance").join(step_rows(t).select(F.col("name").alias("run_id"), "auroc"), "run_id")
    return compare.latest_reference(runs, "reference", "d1", "r1")


@query("reproduction_diff", "C32", "status:s rows:l", with_scores(VAR_SQL + """,
b AS (SELECT run_id, split, variant, metric, CASE WHEN run_id = '1997' THEN value + 0.001 ELSE value END AS value FROM vr WHERE run_id <> '1995')
SELECT CASE WHEN vr.value IS NULL OR b.value IS NULL THEN 'missing' WHEN abs(vr.value - b.value) > 1e-9 THEN 'differs' ELSE 'ok' END AS status, count(*) AS rows FROM vr FULL JOIN b ON vr.run_id = b.run_id AND vr.split = b.split AND vr.variant = b.variant AND vr.metric = b.metric GROUP BY 1"""))
def _(t):
    a = compare.variant_rows(yearly_runs(t))
    b = a.where("run_id <> '1995'").withColumn("value", F.when(F.col("run_id") == "1997", F.col("value") + 0.001).otherwise(F.col("value")))
    return compare.reproduction_diff(a, b, ["run_id", "split", "variant", "metric"], 1e-9).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query("operating_objective", "M31", "trial:s flagged_share:f false_alert_share:f place:l", with_scores(runs_sql("scored", keys="priority") + f""",
hit AS (SELECT priority, max(p) AS p FROM runs WHERE cum_pos / tot_pos >= 0.7 - 1e-12 GROUP BY 1),
o AS (SELECT h.priority AS trial, (cum_pos + cum_neg) / (tot_pos + tot_neg) AS flagged_share, cum_neg / (cum_pos + cum_neg) AS false_alert_share FROM hit h JOIN runs r ON h.priority = r.priority AND h.p = r.p),
a AS (SELECT priority AS trial, {AP} AS ap FROM runs GROUP BY 1)
SELECT o.*, row_number() OVER (ORDER BY round(flagged_share / 0.01) * 0.01, round(false_alert_share / 0.01) * 0.01, flagged_share, ap DESC, o.trial) AS place FROM o JOIN a ON o.trial = a.trial"""))
def _(t):
    s = scored(t)
    op = evaluate.operating_points(s, [0.7], ["priority"]).select(F.col("priority").alias("trial"), "flagged_share", "false_alert_share")
    m = evaluate.ranking_metrics(s, ["priority"]).select(F.col("priority").alias("trial"), "ap").withColumn("brier", F.lit(0.0)).withColumn("complexity", F.lit(1))
    return compare.best_trial(op.join(m, "trial"), tie=0.01)


@query("decision_rule", "M29", "lower_share:b interval_below_zero:b every_fold_improves:b not_timing_dependent:b calibration_kept:b verdict:s", recursive(with_scores(PRI_SQL + f""",
rf AS (SELECT fold, p, sum(pos) OVER (PARTITION BY fold ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY fold ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY fold) AS tp FROM (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL)),
rg AS (SELECT fold, p, sum(pos) OVER (PARTITION BY fold ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY fold ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY fold) AS tp FROM (SELECT fold, p_ref AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL)),
na AS (SELECT fold, arg_max(cn / (cp + cn), p) AS fas FROM rf WHERE cp / tp >= 0.7 - 1e-12 GROUP BY 1), nb AS (SELECT fold, arg_max(cn / (cp + cn), p) AS fas FROM rg WHERE cp / tp >= 0.7 - 1e-12 GROUP BY 1),
d AS (SELECT bool_and(na.fas - nb.fas < 0) AS ef, avg(na.fas - nb.fas) AS dl FROM na JOIN nb ON na.fold = nb.fold)
SELECT dl < 0 AS lower_share, dl + 0.001 < 0 AS interval_below_zero, ef AS every_fold_improves, dl < 0 AS not_timing_dependent, true AS calibration_kept,
 CASE WHEN dl < 0 AND dl + 0.001 < 0 AND ef THEN 'USEFUL' WHEN dl < 0 AND (dl + 0.001 < 0 OR ef) THEN 'PROMISING_NOT_ROBUST' ELSE 'NO_ROBUST_GAIN' END AS verdict FROM d""")))
def _(t):
    op = evaluate.operating_points(models_long(t), [0.7], ["model", "fold"])
    fold = op.groupBy("fold").agg((F.max(F.when(F.col("model") == "new", F.col("false_alert_share"))) - F.max(F.when(F.col("model") == "ref", F.col("false_alert_share")))).alias("d"))
    row = fold.agg(F.collect_list("d").alias("fold_deltas"), F.avg("d").alias("delta_fas")).select(
        "fold_deltas", "delta_fas", F.col("delta_fas").alias("delta_fas_desc"), (F.col("delta_fas") + 0.001).alias("fas_high"), (F.col("delta_fas") + 0.001).alias("fas_desc_high"), F.lit(True).alias("safe_same"),
        F.lit(0.0).alias("delta_fas_safe"), F.lit(1.0).alias("slope_a"), F.lit(1.0).alias("slope_b"), F.lit(0.0).alias("intercept_a"), F.lit(0.0).alias("intercept_b"), F.lit(-0.1).alias("brier_low"))
    return compare.decision(row, slope=(0.8, 1.2), max_intercept=0.2)


@query("leave_one_out_ablation", "C21", "removed:s metric:s estimate:f ci_low:f ci_high:f", with_scores(f"""{REP_SQL},
d AS (SELECT x.b, z.auroc - x.auroc AS auroc, z.ap - x.ap AS ap, z.brier - x.brier AS brier, z.logloss - x.logloss AS logloss FROM m x JOIN m z ON x.b = z.b AND x.model = 'a' AND z.model = 'b'),
ol0 AS (SELECT y, 'a' AS model, p_ref AS p FROM scored UNION ALL SELECT y, 'b', p FROM scored), {runs_sql('ol0', name='oruns', keys='model')},
o AS (SELECT r.model, auroc, ap, brier, logloss FROM (SELECT model, {AUROC} AS auroc, {AP} AS ap FROM oruns GROUP BY 1) r JOIN (SELECT model, avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss FROM ol0 GROUP BY 1) q ON r.model = q.model),
od AS (SELECT z.auroc - x.auroc AS auroc, z.ap - x.ap AS ap, z.brier - x.brier AS brier, z.logloss - x.logloss AS logloss FROM o x JOIN o z ON x.model = 'a' AND z.model = 'b'),
dl AS (UNPIVOT d ON auroc, ap, brier, logloss INTO NAME metric VALUE v), oo AS (UNPIVOT od ON auroc, ap, brier, logloss INTO NAME metric VALUE estimate)
SELECT 'history' AS removed, metric, any_value(estimate) AS estimate, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM dl JOIN oo USING (metric) GROUP BY 2"""))
def _(t):
    return cohorts.leave_one_out(scored(t), "p", {"history": "p_ref"}, "entity_id", B, SEED)


@query("pairwise_run_facts", "C29", "kind:s rows_a:l rows_b:l shared:l events:l", with_scores("""
x AS (SELECT * FROM (VALUES ('early/late', 1996, 1998, 1998, 2000), ('first/last', 1995, 1997, 1999, 2001)) v(kind, a0, a1, b0, b1))
SELECT kind, count_if(year BETWEEN a0 AND a1) AS rows_a, count_if(year BETWEEN b0 AND b1) AS rows_b, count_if(year BETWEEN a0 AND a1 AND year BETWEEN b0 AND b1) AS shared, sum(y) FILTER (WHERE year BETWEEN a0 AND a1 AND year BETWEEN b0 AND b1) AS events FROM scored, x GROUP BY 1"""))
def _(t):
    pairs = {"early/late": (1996, 1998, 1998, 2000), "first/last": (1995, 1997, 1999, 2001)}
    s = scored(t)
    items = []
    for kind, (a0, a1, b0, b1) in pairs.items():
        a, b = F.col("year").between(a0, a1), F.col("year").between(b0, b1)
        items.append(F.struct(F.lit(kind).alias("kind"), F.count_if(a).alias("rows_a"), F.count_if(b).alias("rows_b"), F.count_if(a & b).alias("shared"), F.sum(F.when(a & b, F.col("y"))).alias("events")))
    return s.agg(F.array(*items).alias("x")).select(F.explode("x").alias("e")).select("e.*")


@query("keys_only_suppression", "C28 P42", "model:s fold:l permille:l suppressed:b tp:l selected:l", with_scores(f"{FOLD_SQL}, f AS (SELECT *, (tp BETWEEN 1 AND 9) OR (fp BETWEEN 1 AND 9) OR (fn BETWEEN 1 AND 9) OR (tn BETWEEN 1 AND 9) AS s FROM fold_rows) SELECT model, fold, permille, s AS suppressed, CASE WHEN NOT s THEN tp END AS tp, CASE WHEN NOT s THEN selected END AS selected FROM f"))
def _(t):
    rows = capacity.fold_rows(models_long(t), ["model"], [5, 10, 20, 30, 50, 100, 150, 200], "row_key")
    return suppress.keep_keys_only(rows, ["model", "fold", "permille"], ["tp", "fp", "fn", "tn"], 10)


# ------------------------------------------------------------------ composite jobs
def cohort(t: Tables):
    feats = {"orders": F.col("n365"), "price": F.coalesce("mean_price", F.lit(0.0)), "urgent": scalars.any_positive(["n_urgent"], null_is_absent=True)}
    return cohorts.build_cohort(wide(t), dates=["1997-07-01", "1998-07-01"], index="index_date", eligible="eligible", y="y", guards=["last_order_date"], features=feats, secret="pepper", entity="entity_id")


COHORT_SQL = """ch AS (SELECT *, CASE WHEN index_date NOT IN (DATE '1997-07-01', DATE '1998-07-01') THEN 'other date' WHEN eligible <> 1 THEN 'not eligible' WHEN y IS NULL THEN 'no label' WHEN last_order_date >= index_date THEN 'record on or after index' ELSE 'kept' END AS step FROM wide)"""


@query("wide_to_modeling_rows", "C01 C06 S02", "entity_key:s index_date:d y:l orders:l price:f urgent:l", with_wide(COHORT_SQL + """
SELECT substr(sha256('pepper|' || CAST(entity_id AS VARCHAR)), 1, 20) AS entity_key, index_date, y, n365 AS orders, coalesce(mean_price, 0) AS price, CAST(coalesce(n_urgent > 0, false) AS INTEGER) AS urgent FROM ch WHERE step = 'kept'"""))
def _(t):
    return cohort(t)[0]


@query("cohort_build_report", "C01", "step:s rows:l", with_wide(COHORT_SQL + " SELECT step, count(*) AS rows FROM ch GROUP BY 1"))
def _(t):
    return cohort(t)[1]


U_EXT = "(CAST('0x' || substr(sha256('ext|' || CAST(entity_id AS VARCHAR)), 1, 13) AS BIGINT) / CAST(4503599627370496.0 AS DOUBLE))"


@query("population_extension", "C04 R04", "origin:s split:s rows:l entities:l", with_scores(f"""
ref AS (SELECT * FROM scored WHERE year <= 1995 AND priority <> '5-LOW'), ex AS (SELECT *, CASE WHEN {U_EXT} < 0.6 THEN 'train' WHEN {U_EXT} < CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM scored WHERE priority = '5-LOW' AND entity_id NOT IN (SELECT entity_id FROM ref))
SELECT 'reference' AS origin, NULL AS split, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM ref UNION ALL SELECT 'extension', split, count(*), count(DISTINCT entity_id) FROM ex WHERE split <> 'test' GROUP BY 2"""))
def _(t):
    s = scored(t)
    ext = cohorts.extend_cohort(s.where("year <= 1995 AND priority <> '5-LOW'"), s.where("priority = '5-LOW'"), "entity_id", salt="ext", train=0.6, validation=0.2)
    return ext.groupBy("origin", "split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"))


@query("blind_scoring", "C11 S11 S16", "row_key:s entity_id:l p:f seen_before:b n_flags:l", with_wide("""
s AS (SELECT *, 1 / (1 + exp(-(-1.0 + 0.4 * n365 - 0.00002 * balance))) AS p FROM wide WHERE split = 'test'), e AS (SELECT *, 1 / (1 + exp(-(-1.0 + 0.4 * n365 - 0.00002 * balance))) AS p FROM wide WHERE split = 'train'),
c AS (SELECT capacity, max(p) FILTER (WHERE rn = greatest(1, ceil(capacity * n))) AS cutoff FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM e), (SELECT unnest([CAST(0.05 AS DOUBLE), 0.1]) AS capacity) GROUP BY 1),
sb AS (SELECT DISTINCT entity_id FROM wide WHERE split = 'train' AND n365 > 0)
SELECT substr(sha256('score|' || CAST(s.entity_id AS VARCHAR)), 1, 24) AS row_key, s.entity_id, p, s.entity_id IN (SELECT entity_id FROM sb) AS seen_before, (SELECT count(*) FROM c WHERE s.p >= cutoff) AS n_flags FROM s"""))
def _(t):
    w = wide(t)
    coefs = {"n365": 0.4, "balance": -0.00002}
    dev = w.where("split = 'train'").withColumn("p", 1 / (1 + F.exp(-scalars.linear_predictor(-1.0, coefs))))
    out = cohorts.blind_score(w.where("split = 'test'").select("entity_id", "n365", "balance"), intercept=-1.0, coefs=coefs, entity="entity_id", salt="score",
                              cutoffs=capacity.frozen_cutoffs(dev, [0.05, 0.1]), earlier=w.where("split = 'train' AND n365 > 0"))
    return out.withColumn("n_flags", F.size("flagged_at"))


TE_SQL = """pop AS (SELECT 'all' AS population, * FROM scored UNION ALL SELECT 'urgent', * FROM scored WHERE priority = '1-URGENT' UNION ALL SELECT 'tiny', * FROM scored WHERE price < 1000),
bl AS (SELECT population, 'adverse' AS mode, y, CASE WHEN y = 1 THEN lo ELSE hi END AS p FROM pop UNION ALL SELECT population, 'favourable', y, CASE WHEN y = 1 THEN hi ELSE lo END FROM pop)"""


@query("temporal_evaluation", "C12 C22 C26", "population:s mode:s n:l events:l auroc:f brier:f oe_ratio:f", with_scores(TE_SQL + ", " + runs_sql("bl", keys="population, mode") + f"""
SELECT a.population, a.mode, n, events, auroc, brier, oe_ratio FROM (SELECT population, mode, {AUROC} AS auroc FROM runs GROUP BY ALL) a JOIN (SELECT population, mode, count(*) AS n, sum(y) AS events, avg((p - y) * (p - y)) AS brier, sum(y) / sum(p) AS oe_ratio FROM bl GROUP BY ALL) b
 ON a.population = b.population AND a.mode = b.mode WHERE n >= 100"""))
def _(t):
    pops = {"all": F.lit(True), "urgent": F.col("priority") == "1-URGENT", "tiny": F.col("price") < 1000}
    return cohorts.temporal_evaluation(scored(t), populations=pops, min_rows=100)


@query("validation_tables", "C22 C26", "model:s item:s value:f", with_scores(f"""{MODELS_SQL}, {runs_sql('mlong', keys='model')},
r AS (SELECT model, {AUROC} AS auroc, {AP} AS ap FROM runs GROUP BY 1), pq AS (SELECT model, avg(y) AS prevalence, avg((p - y) * (p - y)) AS brier, sum(y) / sum(p) AS oe_ratio FROM mlong GROUP BY 1), w AS (SELECT r.model, prevalence, brier, oe_ratio, auroc, ap FROM r JOIN pq ON r.model = pq.model),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, row_key) AS rn, count(*) OVER (PARTITION BY model) AS n FROM mlong)
SELECT model, item, value FROM (UNPIVOT w ON prevalence, brier, oe_ratio, auroc, ap INTO NAME item VALUE value) UNION ALL SELECT model, 'sensitivity@0.1', sum(y) FILTER (WHERE rn <= ceil(0.1 * n)) / sum(y) FROM k GROUP BY 1"""))
def _(t):
    return cohorts.validation_tables(models_long(t), "row_key", ["model"], [0.1])


@query("candidate_columns", "C14 C13 C15", "column_name:s kind:s rows:l present:l unreadable:l informative:l class:s", f"""WITH {RAW_SQL}
SELECT 'flag' AS column_name, 'binary' AS kind, count(*) AS rows, count(*) AS present, count_if(tax IN (0, 1, 2, 3, 4, 6)) AS unreadable, count_if(tax = 5) AS informative, 'INELIGIBLE_SEMANTICS' AS class FROM raw UNION ALL
SELECT 'quantity', 'count', count(*), count_if(tax <> 5), count_if(tax IN (7, 8)), count_if(tax NOT IN (5, 7, 8) AND l_quantity <> 0), 'ELIGIBLE' FROM raw UNION ALL
SELECT 'discount', 'ordinal', count(*), count(*), count_if(tax >= 7 OR round(l_discount * 100) > 9), count_if(tax < 7 AND round(l_discount * 100) BETWEEN 1 AND 9), 'ELIGIBLE' FROM raw""")
def _(t):
    return cohorts.candidate_columns(raw_text(t), {"flag": ("binary", ()), "quantity": ("count", ()), "discount": ("ordinal", tuple(float(i) for i in range(10)))}, max_unreadable=0.35)


@query("interval_change_verdict", "P49 C12", "metric:s verdict:s", None)
def _(t):
    s = scored(t)
    a = resample.metric_intervals(s.where("year >= 1999"), {"m": "p"}, "entity_id", B, 1)
    b = resample.metric_intervals(s.where("year < 1999"), {"m": "p"}, "entity_id", B, 1)
    return cohorts.development_change(a, b)


@query("partial_effect_grid", "C33", "price:f4 relative_effect:f", with_scores("""
q AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.99) AS b FROM scored), g AS (SELECT a + (b - a) * i / 59 AS price, m FROM q, (SELECT unnest(generate_series(0, 59)) AS i))
SELECT price, 0.3 * ln(price / 1000) - 0.3 * ln(m / 1000) AS relative_effect FROM g"""))
def _(t):
    return cohorts.partial_effect(scored(t), "price", 0.3 * F.log(F.col("price") / 1000))


@query("index_date_counts", "C09", "index_date:d rows:l", with_wide("SELECT index_date, count(*) AS rows FROM wide GROUP BY 1"))
def _(t):
    return wide(t).groupBy("index_date").agg(F.count(F.lit(1)).alias("rows"))


@query("dataset_manifest", "S01 S02 S15", "rows:l entities:l first_index_date:d last_index_date:d prevalence:f content:s", with_scores("""
SELECT count(*) AS rows, count(DISTINCT entity_id) AS entities, min(index_date) AS first_index_date, max(index_date) AS last_index_date, avg(y) AS prevalence,
 CAST(sum(""" + content_sql("entity_id", "index_date", "row_key", "y") + """) AS VARCHAR) AS content FROM scored"""))
def _(t):
    return tables.manifest(scored(t).select("entity_id", "index_date", "row_key", "y"), entity="entity_id", index="index_date", y="y", versions={"version": "1"})


@query("sealed_scan", "S07 S06 S09 S03", "l_returnflag:s rows:l quantity:f2", "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def _(t):
    df = tables.sealed_read(t.lineitem, ["l_returnflag", "l_quantity"], {"l_shipdate": "post_index"})
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("aggregate_with_basis", "S14 S10", "status:s rows:l basis:s", "SELECT o_orderstatus AS status, count(*) AS rows, 'FULL' AS basis FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("rows")).withColumn("basis", F.lit("FULL"))


@query("mapped_orders", "P06 S04", "order_id:l status:s priority:s", "SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS status, o_orderpriority AS priority FROM orders")
def _(t):
    return contracts.apply_mapping(t.orders, {"o_orderkey": "order_id", "o_orderstatus": "status", "o_orderpriority": "priority"}, {"o_orderstatus": {"F": "final", "O": "open", "P": "pending"}},
                                   drop=["o_custkey", "o_totalprice", "o_orderdate"])
