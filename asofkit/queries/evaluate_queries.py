"""Score evaluation queries: ranking, calibration, thresholds, capacity, subgroups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators import capacity, evaluate, ordering
from asofkit.queries.registry import query
from asofkit.queries.scores import AP, AUROC, RATES, RATES_SPEC, runs_sql, scored, scored_lines, with_scores

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
FRACTIONS = [0.01, 0.05, 0.1, 0.2]
PERMILLES = [5, 10, 20, 30, 50, 100, 150, 200]
TARGETS = [0.5, 0.6, 0.7, 0.8]


def models_long(t) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("new").alias("model"), F.col("p").alias("s")), F.struct(F.lit("ref").alias("model"), F.col("p_ref").alias("s"))))
    return scored(t).select("row_key", "entity_id", "fold", "y", each.alias("m")).select("row_key", "entity_id", "fold", "y", "m.model", F.col("m.s").alias("p"))


MODELS_SQL = """mlong AS (SELECT row_key, entity_id, fold, y, 'new' AS model, p FROM scored UNION ALL SELECT row_key, entity_id, fold, y, 'ref' AS model, p_ref AS p FROM scored)"""


@query("auroc_average_precision", "M01 M03", "status:s auroc:f ap:f",
       with_scores(runs_sql("lscored", keys="status") + f" SELECT status, {AUROC} AS auroc, {AP} AS ap FROM runs GROUP BY status"))
def _(t):
    return evaluate.ranking_metrics(scored_lines(t), ["status"])


@query("auroc_delong", "M02 W06", "n1:l n0:l auroc:f variance:f10 logit_se:f", with_scores(runs_sql("scored") + f""",
pl AS (SELECT *, (tot_neg - cum_neg + neg / 2) / tot_neg AS v10, (cum_pos - pos / 2) / tot_pos AS v01 FROM runs),
s AS (SELECT max(tot_pos) AS n1, max(tot_neg) AS n0, {AUROC} AS auroc FROM runs),
v AS (SELECT n1, n0, auroc, (SELECT sum(pos * pow(v10 - auroc, 2)) FROM pl) / (n1 - 1) / n1 + (SELECT sum(neg * pow(v01 - auroc, 2)) FROM pl) / (n0 - 1) / n0 AS variance FROM s)
SELECT *, sqrt(variance) / (auroc * (1 - auroc)) AS logit_se FROM v"""))
def _(t):
    return evaluate.delong(scored(t))


@query("midranks", "W06", "p:f n:l midrank:f", with_scores("""
SELECT p, count(*) AS n, avg(rn) AS midrank FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM scored) GROUP BY p"""))
def _(t):
    return ordering.midranks(scored(t), "p")


@query("score_prefix_sums", "W07", "p:f pos:l neg:l cum_pos:l cum_neg:l", with_scores(runs_sql("lscored") + " SELECT p, pos, neg, cum_pos, cum_neg FROM runs"))
def _(t):
    return evaluate.score_runs(scored_lines(t))


POINTS = "n:l events:l prevalence:f mean_predicted:f brier:f brier_skill:f logloss:f oe_ratio:f log_oe_se:f"
POINTS_SQL = """count(*) AS n, sum(y) AS events, avg(y) AS prevalence, avg(p) AS mean_predicted, avg((p - y) * (p - y)) AS brier,
 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS brier_skill, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss, sum(y) / sum(p) AS oe_ratio,
 sqrt((1 - avg(y)) / sum(y)) AS log_oe_se"""


@query("point_metrics", "M04 M06", "status:s year:l " + POINTS, with_scores(f"SELECT status, year, {POINTS_SQL} FROM lscored GROUP BY ALL"))
def _(t):
    return evaluate.point_metrics(scored_lines(t), ["status", "year"])


NEWTON_SQL = """
it AS (SELECT 0 AS k, ln(avg(y) / (1 - avg(y))) AS a, CAST(0.0 AS DOUBLE) AS b FROM scored
 UNION ALL SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
  (SELECT k, a, b, sum(y - mu) AS g0, sum((y - mu) * lp) AS g1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * lp) AS h01, sum(mu * (1 - mu) * lp * lp) AS h11 FROM
   (SELECT k, a, b, y, ln(p) - ln(1 - p) AS lp, 1 / (1 + exp(-(a + b * (ln(p) - ln(1 - p))))) AS mu FROM it, scored WHERE k < 12) GROUP BY k, a, b)),
it0 AS (SELECT 0 AS k, ln(avg(y) / (1 - avg(y))) - avg(ln(p) - ln(1 - p)) AS a FROM scored
 UNION ALL SELECT k + 1, a + g0 / h00 FROM (SELECT k, a, sum(y - mu) AS g0, sum(mu * (1 - mu)) AS h00 FROM
   (SELECT k, a, y, 1 / (1 + exp(-(a + ln(p) - ln(1 - p)))) AS mu FROM it0, scored WHERE k < 12) GROUP BY k, a)),
fin AS (SELECT a, b FROM it WHERE k = 12), fin0 AS (SELECT a AS citl FROM it0 WHERE k = 12),
info AS (SELECT sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * lp) AS h01, sum(mu * (1 - mu) * lp * lp) AS h11 FROM
 (SELECT ln(p) - ln(1 - p) AS lp, 1 / (1 + exp(-(a + b * (ln(p) - ln(1 - p))))) AS mu FROM fin, scored))"""


def with_newton(body: str) -> str:
    return with_scores(NEWTON_SQL + body).replace("WITH", "WITH RECURSIVE", 1)


@query("calibration_slope_intercept", "M05 M41", "intercept:f slope:f intercept_se:f slope_se:f citl:f", with_newton("""
SELECT a AS intercept, b AS slope, sqrt(h11 / (h00 * h11 - h01 * h01)) AS intercept_se, sqrt(h00 / (h00 * h11 - h01 * h01)) AS slope_se, citl FROM fin, fin0, info"""))
def _(t):
    return evaluate.calibration_measures(scored(t))


KEYED_NEWTON_SQL = """
cal AS (SELECT priority, year, y, ln(p) - ln(1 - p) AS lp FROM scored),
it AS (SELECT 0 AS k, priority, year, ln(avg(y) / (1 - avg(y))) AS a, CAST(0.0 AS DOUBLE) AS b, ln(avg(y) / (1 - avg(y))) - avg(lp) AS c, CAST(0.0 AS DOUBLE) AS va, CAST(0.0 AS DOUBLE) AS vb FROM cal GROUP BY ALL HAVING min(y) < max(y)
 UNION ALL SELECT k + 1, priority, year, a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det, c + o0 / oh, h11 / det, h00 / det FROM
  (SELECT *, h00 * h11 - h01 * h01 AS det FROM
   (SELECT k, it.priority, it.year, a, b, c, sum(y - mu) AS g0, sum((y - mu) * lp) AS g1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * lp) AS h01, sum(mu * (1 - mu) * lp * lp) AS h11, sum(y - nu) AS o0, sum(nu * (1 - nu)) AS oh FROM
    (SELECT it.*, cal.y, lp, 1 / (1 + exp(-(a + b * lp))) AS mu, 1 / (1 + exp(-(c + lp))) AS nu FROM it JOIN cal ON it.priority = cal.priority AND it.year = cal.year WHERE k < 15) AS it GROUP BY ALL))),
groups AS (SELECT DISTINCT priority, year FROM cal)
SELECT g.priority, g.year, CASE WHEN it.a IS NULL THEN 'one_class' ELSE 'converged' END AS fit_status, it.a AS intercept, b AS slope, sqrt(va) AS intercept_se, sqrt(vb) AS slope_se, c AS citl
FROM groups g LEFT JOIN it ON it.priority = g.priority AND it.year = g.year AND it.k = 15"""


@query("calibration_by_key", "M05 M11 M41", "priority:s year:l fit_status:s intercept:f slope:f intercept_se:f slope_se:f citl:f", with_scores(KEYED_NEWTON_SQL).replace("WITH", "WITH RECURSIVE", 1))
def _(t):
    return evaluate.calibration_measures(scored(t), ["priority", "year"])


@query("metric_bundle", "M11 M12", POINTS + " auroc:f ap:f intercept:f slope:f citl:f", with_newton(", " + runs_sql("scored") + f"""
SELECT pm.*, rm.*, a AS intercept, b AS slope, citl FROM (SELECT {POINTS_SQL} FROM scored) pm, (SELECT {AUROC} AS auroc, {AP} AS ap FROM runs) rm, fin, fin0"""))
def _(t):
    return evaluate.metric_bundle(scored(t))


@query("grouped_calibration", "M07 M08 W08", "grp:l n:l events:l mean_predicted:f min_predicted:f max_predicted:f observed_rate:f ci_low:f ci_high:f", with_scores("""
g AS (SELECT grp, count(*) AS n, sum(y) AS events, avg(p) AS mean_predicted, min(p) AS min_predicted, max(p) AS max_predicted, avg(y) AS o
 FROM (SELECT *, ntile(20) OVER (ORDER BY p, row_key) AS grp FROM scored) GROUP BY grp)
SELECT *, o AS observed_rate, greatest(0, o - 1.959963984540054 * sqrt(o * (1 - o) / n)) AS ci_low, least(1, o + 1.959963984540054 * sqrt(o * (1 - o) / n)) AS ci_high FROM g"""))
def _(t):
    return evaluate.grouped_calibration(scored(t), "row_key", 20)


@query("deciles_by_position", "W09", "decile:l n:l events:l mean_predicted:f observed_rate:f", with_scores("""
SELECT floor((rn - 1) * 7 / n) + 1 AS decile, count(*) AS n, sum(y) AS events, avg(p) AS mean_predicted, avg(y) AS observed_rate
FROM (SELECT *, row_number() OVER (ORDER BY p, row_key) AS rn, count(*) OVER () AS n FROM scored) GROUP BY 1"""))
def _(t):
    return evaluate.risk_deciles(scored(t), "row_key", 7).withColumnRenamed("grp", "decile")


THRESH_SQL = "(SELECT unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in THRESHOLDS) + "]) AS threshold)"
CONF_SQL = f"""conf AS (SELECT threshold, status, CAST(count_if(p >= threshold AND y = 1) AS DOUBLE) AS tp, CAST(count_if(p >= threshold AND y = 0) AS DOUBLE) AS fp,
 CAST(count_if(p < threshold AND y = 1) AS DOUBLE) AS fn, CAST(count_if(p < threshold AND y = 0) AS DOUBLE) AS tn FROM lscored, {THRESH_SQL} GROUP BY ALL)"""


@query("threshold_table", "L07 M10 P46", "status:s threshold:f " + RATES_SPEC + " f1:f net_benefit:f", with_scores(CONF_SQL + f""" SELECT *, {RATES},
 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn + tn) - fp / (tp + fp + fn + tn) * threshold / (1 - threshold) AS net_benefit FROM conf"""))
def _(t):
    return evaluate.threshold_metrics(scored_lines(t), THRESHOLDS, ["status"])


@query("decision_curve", "M10", "status:s threshold:f model:f treat_all:f treat_none:f standardised:f", with_scores(CONF_SQL + """,
nb AS (SELECT *, (tp + fn) / (tp + fp + fn + tn) AS prev, tp / (tp + fp + fn + tn) - fp / (tp + fp + fn + tn) * threshold / (1 - threshold) AS model FROM conf)
SELECT status, threshold, model, prev - (1 - prev) * threshold / (1 - threshold) AS treat_all, 0 AS treat_none, model / prev AS standardised FROM nb"""))
def _(t):
    return evaluate.decision_curve(scored_lines(t), THRESHOLDS, ["status"])


RUN_CONF = "SELECT p AS threshold, cum_pos AS tp, cum_neg AS fp, tot_pos - cum_pos AS fn, tot_neg - cum_neg AS tn FROM runs"


@query("exhaustive_thresholds", "L06", "threshold:f " + RATES_SPEC, with_scores(runs_sql("scored") + f", c AS ({RUN_CONF}) SELECT *, {RATES} FROM c"))
def _(t):
    return evaluate.exhaustive_thresholds(scored(t))


@query("grid_thresholds", "L06", "threshold:f tp:l fp:l fn:l tn:l", with_scores(runs_sql("scored") + """
SELECT p AS threshold, cum_pos AS tp, cum_neg AS fp, tot_pos - cum_pos AS fn, tot_neg - cum_neg AS tn FROM runs
WHERE floor(((cum_pos + cum_neg) / (tot_pos + tot_neg) + 1e-12) / 0.05) > floor(((cum_pos + cum_neg - pos - neg) / (tot_pos + tot_neg) + 1e-12) / 0.05)"""))
def _(t):
    return evaluate.grid_thresholds(scored(t), 0.05)


@query("operating_points", "L05", "model:s target:f threshold:f " + RATES_SPEC + " degenerate:b", with_scores(MODELS_SQL + ", " + runs_sql("mlong", keys="model") + f""",
hit AS (SELECT model, target, max(p) AS threshold FROM runs, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.6, 0.7, 0.8]) AS target) WHERE cum_pos / tot_pos >= target - 1e-12 GROUP BY ALL),
c AS (SELECT h.model, target, threshold, cum_pos AS tp, cum_neg AS fp, tot_pos - cum_pos AS fn, tot_neg - cum_neg AS tn FROM hit h JOIN runs r ON h.model = r.model AND h.threshold = r.p)
SELECT *, {RATES}, fn + tn = 0 AS degenerate FROM c"""))
def _(t):
    return evaluate.operating_points(models_long(t), TARGETS, ["model"])


@query("curve_points", "M21", "threshold:f tpr:f fpr:f precision:f", with_scores(runs_sql("scored", p="p_ref") + """
SELECT p AS threshold, cum_pos / tot_pos AS tpr, cum_neg / tot_neg AS fpr, cum_pos / (cum_pos + cum_neg) AS precision FROM runs
WHERE floor((cum_pos + cum_neg) * 49 / (tot_pos + tot_neg)) > floor((cum_pos + cum_neg - pos - neg) * 49 / (tot_pos + tot_neg))"""))
def _(t):
    return evaluate.curve_points(scored(t).withColumn("p", F.col("p_ref")), 50)


@query("risk_histogram", "M21", "bin:l events:l non_events:l", with_scores("""
SELECT least(floor(p / top * 40), 39) AS bin, sum(y) AS events, sum(1 - y) AS non_events FROM lscored, (SELECT quantile_cont(p, 0.995) AS top FROM lscored) GROUP BY 1"""))
def _(t):
    return evaluate.risk_histogram(scored_lines(t))


# ------------------------------------------------------------------ capacity
@query("top_fraction_mask", "W10 W11", "row_key:l flagged:b", with_scores("""
SELECT row_key, row_number() OVER (ORDER BY p DESC, row_key) <= greatest(1, ceil(0.1 * count(*) OVER ())) AS flagged FROM scored"""))
def _(t):
    return capacity.top_mask(scored(t), "row_key", 0.1)


CUTS_SQL = "(SELECT unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in FRACTIONS) + "]) AS capacity)"
CAP_SQL = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, row_key) AS rn, count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS ev FROM mlong),
c AS (SELECT model, capacity, CAST(count_if(y = 1 AND rn <= greatest(1, ceil(capacity * n))) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND rn <= greatest(1, ceil(capacity * n))) AS DOUBLE) AS fp,
 CAST(count_if(y = 1 AND rn > greatest(1, ceil(capacity * n))) AS DOUBLE) AS fn, CAST(count_if(y = 0 AND rn > greatest(1, ceil(capacity * n))) AS DOUBLE) AS tn FROM rk, {CUTS_SQL} GROUP BY ALL)"""


@query("capacity_table", "L01 M20", "model:s capacity:f " + RATES_SPEC, with_scores(f"{MODELS_SQL}, {CAP_SQL} SELECT *, {RATES} FROM c"))
def _(t):
    return capacity.capacity_table(models_long(t), "row_key", FRACTIONS, ["model"])


@query("concentration_lift", "W11 M20", "model:s capacity:f event_share:f prevalence_in_top:f lift:f", with_scores(f"""{MODELS_SQL}, {CAP_SQL}
SELECT model, capacity, tp / (tp + fn) AS event_share, tp / (tp + fp) AS prevalence_in_top, (tp / (tp + fp)) / ((tp + fn) / (tp + fp + fn + tn)) AS lift FROM c"""))
def _(t):
    c = capacity.capacity_table(models_long(t), "row_key", FRACTIONS, ["model"])
    return c.select("model", "capacity", F.col("sensitivity").alias("event_share"), F.col("ppv").alias("prevalence_in_top"), "lift")


@query("frozen_cutoffs", "L03", "model:s capacity:f cutoff:f", with_scores(f"""{MODELS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC) AS rn, count(*) OVER (PARTITION BY model) AS n FROM mlong)
SELECT model, capacity, max(p) FILTER (WHERE rn = greatest(1, ceil(capacity * n))) AS cutoff FROM rk, {CUTS_SQL} GROUP BY ALL"""))
def _(t):
    return capacity.frozen_cutoffs(models_long(t), FRACTIONS, ["model"])


FROZEN_SQL = f"""cutoffs AS (SELECT capacity, max(p) FILTER (WHERE rn = greatest(1, ceil(capacity * n))) AS cutoff FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM scored WHERE year < 1999), {CUTS_SQL} GROUP BY ALL)"""


@query("capacity_with_frozen_cutoffs", "L02 L04", "priority:s capacity:f cutoff:f " + RATES_SPEC, with_scores(FROZEN_SQL + f""",
c AS (SELECT priority, capacity, cutoff, CAST(count_if(p >= cutoff AND y = 1) AS DOUBLE) AS tp, CAST(count_if(p >= cutoff AND y = 0) AS DOUBLE) AS fp,
 CAST(count_if(p < cutoff AND y = 1) AS DOUBLE) AS fn, CAST(count_if(p < cutoff AND y = 0) AS DOUBLE) AS tn FROM scored, cutoffs WHERE year >= 1999 GROUP BY ALL)
SELECT *, {RATES} FROM c"""))
def _(t):
    s = scored(t)
    return capacity.apply_cutoffs(s.where("year >= 1999"), capacity.frozen_cutoffs(s.where("year < 1999"), FRACTIONS), ["priority"])


@query("gains_curve", "W12", "point:l k:l event_share:f", with_scores("""
r AS (SELECT rn, n, sum(y) OVER (ORDER BY rn) AS tp, sum(y) OVER () AS ev FROM (SELECT y, row_number() OVER (ORDER BY p DESC, row_key) AS rn, count(*) OVER () AS n FROM scored))
SELECT point, rn AS k, tp / ev AS event_share FROM r, (SELECT unnest(generate_series(1, 100)) AS point) WHERE rn = greatest(1, point * n // 100)"""))
def _(t):
    return capacity.gains_curve(scored(t), "row_key")


PM_SQL = "(SELECT unnest([" + ", ".join(map(str, PERMILLES)) + "]) AS permille)"
ALLOC_SQL = f"""sizes AS (SELECT model, fold, count(*) AS size, sum(y) AS fold_events FROM mlong GROUP BY ALL),
grid AS (SELECT *, sum(size) OVER (PARTITION BY model, permille) AS population FROM sizes, {PM_SQL}),
tot AS (SELECT *, CAST((2 * permille * population + 1000) // 2000 AS BIGINT) AS total FROM grid),
al AS (SELECT *, CAST(total * size // population AS BIGINT) AS base, CAST(total * size % population AS BIGINT) AS rem FROM tot),
al2 AS (SELECT *, row_number() OVER (PARTITION BY model, permille ORDER BY rem DESC, fold) AS place, total - sum(base) OVER (PARTITION BY model, permille) AS left_over FROM al),
alloc AS (SELECT *, least(base + CASE WHEN place <= left_over THEN 1 ELSE 0 END, size) AS k FROM al2)"""


@query("largest_remainder_allocation", "L09", "model:s permille:l fold:l size:l k:l", with_scores(f"{MODELS_SQL}, {ALLOC_SQL} SELECT model, permille, fold, size, k FROM alloc"))
def _(t):
    return capacity.fold_cuts(models_long(t), ["model"], PERMILLES).withColumnRenamed("cut", "permille")


FOLD_SQL = f"""{MODELS_SQL}, {ALLOC_SQL},
fr AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY p DESC, row_key) AS rn, lead(p) OVER (PARTITION BY model, fold ORDER BY p DESC, row_key) AS nxt FROM mlong),
fold_rows AS (SELECT a.model, a.permille, a.fold, a.population, a.size AS fold_size, a.k AS selected, CAST(count_if(rn <= k AND y = 1) AS DOUBLE) AS tp, CAST(count_if(rn <= k AND y = 0) AS DOUBLE) AS fp,
 CAST(count_if(rn > k AND y = 1) AS DOUBLE) AS fn, CAST(count_if(rn > k AND y = 0) AS DOUBLE) AS tn, bool_or(rn = k AND p = nxt) AS tie_split
 FROM alloc a JOIN fr ON a.model = fr.model AND a.fold = fr.fold GROUP BY ALL)"""


@query("fold_capacity_rows", "W13 L10", "model:s permille:l fold:l fold_size:l selected:l tp:l fp:l fn:l tn:l tie_split:b",
       with_scores(f"{FOLD_SQL} SELECT *, coalesce(tie_split, false) AS ts FROM fold_rows"))
def _(t):
    return capacity.fold_rows(models_long(t), ["model"], PERMILLES, "row_key")


CURVE_SQL = f"""{FOLD_SQL}, cs AS (SELECT model, permille, population, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, bool_or(tie_split) AS tie_split FROM fold_rows GROUP BY ALL),
curve AS (SELECT *, tp / (tp + fn) AS sens, NOT (tp BETWEEN 1 AND 9) AND NOT (fp BETWEEN 1 AND 9) AND NOT (fn BETWEEN 1 AND 9) AND NOT (tn BETWEEN 1 AND 9) AS cells_safe FROM cs)"""


@query("fold_capacity_curve", "L10 L11", "model:s permille:l population:l tie_split:b cells_safe:b " + RATES_SPEC, with_scores(f"{CURVE_SQL} SELECT *, {RATES} FROM curve"))
def _(t):
    return capacity.fold_capacity(models_long(t), ["model"], PERMILLES, "row_key")


@query("pooled_capacity", "L10 L04", "model:s permille:l tp:l fp:l", with_scores(f"""{MODELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, row_key) AS rn, count(*) OVER (PARTITION BY model) AS n FROM mlong)
SELECT model, permille, count_if(y = 1 AND rn <= (2 * permille * n + 1000) // 2000) AS tp, count_if(y = 0 AND rn <= (2 * permille * n + 1000) // 2000) AS fp FROM r, {PM_SQL} GROUP BY ALL"""))
def _(t):
    df = models_long(t)
    totals = df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    cuts = totals.withColumn("cut", F.explode(F.array(*[F.lit(v) for v in PERMILLES]))).select("model", "cut", capacity.n_selected(F.col("cut"), F.col("n")).alias("k"))
    return capacity.top_k_events(df, cuts, ["model"], "row_key").select("model", F.col("cut").alias("permille"), "tp", (F.col("k") - F.col("tp")).alias("fp"))


@query("capacity_safe_points", "L11", "permille:l safe:b", with_scores(f"{CURVE_SQL} SELECT permille, bool_and(cells_safe) AS safe FROM curve GROUP BY 1"))
def _(t):
    return capacity.safe_points(capacity.fold_capacity(models_long(t), ["model"], PERMILLES, "row_key"))


@query("capacity_grid_step", "L11", "year:l n:l step:l", with_scores("""SELECT year, count(*) AS n, CASE WHEN count(*) / 1000 >= 10 THEN 1 WHEN 2 * count(*) / 1000 >= 10 THEN 2 WHEN 5 * count(*) / 1000 >= 10 THEN 5 ELSE 10 END AS step FROM lscored GROUP BY 1"""))
def _(t):
    return scored_lines(t).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("step", capacity.grid_step(F.col("n")))


@query("smallest_capacity_for_target", "C27", "model:s target:f permille:l tp:l fp:l", with_scores(f"""{CURVE_SQL}, w AS (SELECT model, target, min(permille) FILTER (WHERE sens >= target) AS permille FROM curve, (SELECT unnest([CAST(0.05 AS DOUBLE), 0.2, 0.3]) AS target) GROUP BY ALL)
SELECT w.model, w.target, w.permille, tp, fp FROM w LEFT JOIN curve c ON w.model = c.model AND w.permille = c.permille"""))
def _(t):
    return capacity.smallest_capacity(capacity.fold_capacity(models_long(t), ["model"], PERMILLES, "row_key"), ["model"], [0.05, 0.2, 0.3])


@query("capacity_headline", "C24", "permille:l tp_a:l tp_b:l fp_a:l fp_b:l extra_captures:l fewer_false_alerts:l extra_captures_per_10000:f", with_scores(f"""{CURVE_SQL}
SELECT a.permille, a.tp AS tp_a, b.tp AS tp_b, a.fp AS fp_a, b.fp AS fp_b, b.tp - a.tp AS extra_captures, a.fp - b.fp AS fewer_false_alerts, 10000 * (b.tp - a.tp) / a.population AS extra_captures_per_10000
FROM curve a JOIN curve b ON a.permille = b.permille AND a.model = 'ref' AND b.model = 'new'"""))
def _(t):
    return capacity.capacity_headline(capacity.fold_capacity(models_long(t), ["model"], PERMILLES, "row_key"), "model", "ref", "new")


# ------------------------------------------------------------------ subgroups, bounds
HM = """greatest(0, auc - 1.959964 * se) AS auroc_low, least(1, auc + 1.959964 * se) AS auroc_high"""


@query("subgroup_performance", "M17 M14 A68", "stratifier:s level:s n:l events:l oe_ratio:f auroc:f auroc_low:f auroc_high:f", with_scores("""
lg AS (SELECT 'status' AS stratifier, status AS level, y, p FROM lscored UNION ALL SELECT 'year', CAST(year AS VARCHAR), y, p FROM lscored),
""" + runs_sql("lg", keys="stratifier, level") + f""",
a AS (SELECT stratifier, level, max(tot_pos) AS events, max(tot_neg) AS n0, {AUROC} AS auc, sum((pos + neg) * p) AS ex FROM runs GROUP BY ALL),
s AS (SELECT *, events >= 10 AND n0 >= 10 AS ok, sqrt(greatest((auc * (1 - auc) + (events - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (events * n0), 0)) AS se FROM a),
x AS (SELECT *, {HM} FROM s)
SELECT stratifier, level, events + n0 AS n, events, events / ex AS oe_ratio, CASE WHEN ok THEN auc END AS auroc, CASE WHEN ok THEN auroc_low END AS auroc_low, CASE WHEN ok THEN auroc_high END AS auroc_high FROM x"""))
def _(t):
    return evaluate.subgroup_performance(scored_lines(t), ["status", "year"])


@query("subgroup_at_threshold", "M18", "stratifier:s level:s powered:b " + RATES_SPEC, with_scores(f"""
lg AS (SELECT 'priority' AS stratifier, priority AS level, y, p FROM scored UNION ALL SELECT 'year', CAST(year AS VARCHAR), y, p FROM scored),
c AS (SELECT stratifier, level, CAST(count_if(p >= 0.4 AND y = 1) AS DOUBLE) AS tp, CAST(count_if(p >= 0.4 AND y = 0) AS DOUBLE) AS fp,
 CAST(count_if(p < 0.4 AND y = 1) AS DOUBLE) AS fn, CAST(count_if(p < 0.4 AND y = 0) AS DOUBLE) AS tn FROM lg GROUP BY ALL)
SELECT *, {RATES}, tp + fn >= 20 AS powered FROM c"""))
def _(t):
    return evaluate.subgroup_at_threshold(scored(t), ["priority", "year"], 0.4)


@query("subset_performance", "M19", "n1:l n0:l auroc:f logit_se:f", with_scores("sub AS (SELECT * FROM scored WHERE priority = '1-URGENT' AND year >= 1998), " + runs_sql("sub") + f""",
pl AS (SELECT *, (tot_neg - cum_neg + neg / 2) / tot_neg AS v10, (cum_pos - pos / 2) / tot_pos AS v01 FROM runs),
s AS (SELECT max(tot_pos) AS n1, max(tot_neg) AS n0, {AUROC} AS auroc FROM runs)
SELECT n1, n0, auroc, sqrt((SELECT sum(pos * pow(v10 - auroc, 2)) FROM pl) / (n1 - 1) / n1 + (SELECT sum(neg * pow(v01 - auroc, 2)) FROM pl) / (n0 - 1) / n0) / (auroc * (1 - auroc)) AS logit_se FROM s"""))
def _(t):
    return evaluate.delong(scored(t).where("priority = '1-URGENT' AND year >= 1998"))


@query("error_groups", "M22", "error_group:s n:l mean_p:f mean_price:f4", with_scores("""
r AS (SELECT *, row_number() OVER (ORDER BY p, row_key) / count(*) OVER () AS pos FROM scored)
SELECT CASE WHEN pos > 0.8 THEN 'high' ELSE 'low' END || CASE WHEN y = 1 THEN '_event' ELSE '_non_event' END AS error_group, count(*) AS n, avg(p) AS mean_p, avg(price) AS mean_price
FROM r WHERE pos > 0.8 OR pos <= 0.5 GROUP BY 1"""))
def _(t):
    g = evaluate.error_groups(scored(t), "row_key")
    return g.groupBy("error_group").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("price").alias("mean_price"))


BOUND_SQL = """bl AS (SELECT 'adverse' AS mode, y, CASE WHEN y = 1 THEN lo ELSE hi END AS p FROM scored UNION ALL SELECT 'favourable', y, CASE WHEN y = 1 THEN hi ELSE lo END FROM scored)"""


@query("adverse_favourable_bounds", "M25 C20", "mode:s auroc:f ap:f brier:f oe_ratio:f", with_scores(BOUND_SQL + ", " + runs_sql("bl", keys="mode") + f"""
SELECT a.mode, auroc, ap, brier, oe_ratio FROM (SELECT mode, {AUROC} AS auroc, {AP} AS ap FROM runs GROUP BY 1) a JOIN (SELECT mode, avg((p - y) * (p - y)) AS brier, sum(y) / sum(p) AS oe_ratio FROM bl GROUP BY 1) b ON a.mode = b.mode"""))
def _(t):
    b = evaluate.adverse_favourable(scored(t).select("y", "lo", "hi"))
    return evaluate.ranking_metrics(b, ["mode"]).join(evaluate.point_metrics(b, ["mode"]), "mode")


@query("prediction_summary", "M32", "model:s y:l n:l mean:f p10:f p50:f p90:f", with_scores(MODELS_SQL + """
SELECT model, y, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.9) AS p90 FROM mlong GROUP BY ALL"""))
def _(t):
    return evaluate.prediction_summary(models_long(t), ["model", "y"])


@query("per_fold_metrics", "M14 R22 W18", "fold:l auroc_new:f auroc_ref:f delta:f", with_scores(MODELS_SQL + ", " + runs_sql("mlong", keys="model, fold") + f""",
m AS (SELECT model, fold, {AUROC} AS auroc FROM runs GROUP BY ALL)
SELECT a.fold, a.auroc AS auroc_new, b.auroc AS auroc_ref, a.auroc - b.auroc AS delta FROM m a JOIN m b ON a.fold = b.fold AND a.model = 'new' AND b.model = 'ref'"""))
def _(t):
    m = evaluate.ranking_metrics(models_long(t), ["model", "fold"])
    wide = m.groupBy("fold").agg(F.max(F.when(F.col("model") == "new", F.col("auroc"))).alias("auroc_new"), F.max(F.when(F.col("model") == "ref", F.col("auroc"))).alias("auroc_ref"))
    return wide.withColumn("delta", F.col("auroc_new") - F.col("auroc_ref"))


@query("recalibrated_risk", "P36 P39", "row_key:l lp:f shifted:f scaled:f", with_scores("""
SELECT row_key, ln(p) - ln(1 - p) AS lp, 1 / (1 + exp(-(ln(p) - ln(1 - p) - 0.25))) AS shifted, 1 / (1 + exp(-(-0.1 + 0.8 * (ln(p) - ln(1 - p))))) AS scaled FROM scored"""))
def _(t):
    lp = stats.logit(F.col("p"))
    return scored(t).select("row_key", lp.alias("lp"), stats.expit(lp - 0.25).alias("shifted"), stats.expit(-0.1 + 0.8 * lp).alias("scaled"))


@query("performance_summary", "M13", "metric:s value:f", with_newton(", " + runs_sql("scored") + f""",
s AS (SELECT {AUROC} AS auroc, {AP} AS pr_auc FROM runs)
SELECT 'auroc' AS metric, auroc AS value FROM s UNION ALL SELECT 'pr_auc', pr_auc FROM s UNION ALL SELECT 'brier', avg((p - y) * (p - y)) FROM scored UNION ALL SELECT 'calibration_slope', b FROM fin UNION ALL
SELECT 'citl', citl FROM fin0 UNION ALL SELECT 'net_benefit@0.4', count_if(p >= 0.4 AND y = 1) / count(*) - count_if(p >= 0.4 AND y = 0) / count(*) * CAST(0.4 AS DOUBLE) / CAST(0.6 AS DOUBLE) FROM scored"""))
def _(t):
    return evaluate.performance_summary(scored(t), ["auroc", "pr_auc", "brier", "calibration_slope", "citl", "net_benefit@0.4"])


@query("model_rows_stacked", "U05", "model:s n:l events:l brier:f", with_scores(MODELS_SQL + " SELECT model, count(*) AS n, sum(y) AS events, avg((p - y) * (p - y)) AS brier FROM mlong GROUP BY 1"))
def _(t):
    s = scored(t)
    parts = [evaluate.point_metrics(s.withColumn("model", F.lit(m)), ["model"], p=c) for m, c in (("new", "p"), ("ref", "p_ref"))]
    return parts[0].unionByName(parts[1])
