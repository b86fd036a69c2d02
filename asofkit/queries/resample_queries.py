"""Splits, folds and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import hashing
from asofkit.functions.hashing import content_sql, hash_uniform_sql, poisson_one_sql
from asofkit.operators import evaluate, resample, splits
from asofkit.queries.registry import query
from asofkit.queries.scores import AP, AUROC, runs_sql, scored, with_scores

B, SEED = 200, 2024
MODELS = {"a": "p_ref", "b": "p"}
U_BOOT = f"CAST('0x' || substr(sha256('{SEED}|' || CAST((b - 1) // 8 AS VARCHAR) || '|' || CAST(entity_id AS VARCHAR)), 1 + 8 * ((b - 1) % 8), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
DRAW_SQL = f"""draws AS (SELECT entity_id, b, {poisson_one_sql('u')} AS w FROM (SELECT entity_id, b, {U_BOOT} AS u FROM (SELECT DISTINCT entity_id FROM scored), (SELECT unnest(generate_series(1, {B})) AS b))),
reps AS (SELECT s.*, d.b, d.w FROM scored s JOIN draws d ON s.entity_id = d.entity_id WHERE w > 0),
rlong AS (SELECT b, w, y, row_key, fold, 'a' AS model, p_ref AS p FROM reps UNION ALL SELECT b, w, y, row_key, fold, 'b', p FROM reps)"""
REP_SQL = f"""{DRAW_SQL}, {runs_sql('rlong', keys='b, model', w='w')},
rm AS (SELECT b, model, {AUROC} AS auroc, {AP} AS ap FROM runs GROUP BY ALL),
pm AS (SELECT b, model, sum(w * (p - y) * (p - y)) / sum(w) AS brier, -sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w) AS logloss, sum(w * y) / sum(w * p) AS oe_ratio FROM rlong GROUP BY ALL),
m AS (SELECT rm.b, rm.model, auroc, ap, brier, logloss, oe_ratio FROM rm JOIN pm ON rm.b = pm.b AND rm.model = pm.model)"""
METRICS = ("auroc", "ap", "brier", "logloss", "oe_ratio")


@query("bootstrap_weights", "R10", "entity_id:l b:l w:l", with_scores(f"{DRAW_SQL} SELECT entity_id, b, w FROM draws"))
def _(t):
    e = scored(t).select("entity_id").distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B))))
    return e.withColumn("w", resample.replicate_weight("entity_id", SEED))


@query("bootstrap_replicates", "R10 R13", "b:l model:s auroc:f ap:f brier:f logloss:f oe_ratio:f", with_scores(f"{REP_SQL} SELECT * FROM m"))
def _(t):
    return resample.replicate_metrics(scored(t), MODELS, "entity_id", B, SEED)


POINT_LONG = f"""olong AS (SELECT y, 'a' AS model, p_ref AS p FROM scored UNION ALL SELECT y, 'b', p FROM scored), {runs_sql('olong', name='oruns', keys='model')},
orm AS (SELECT model, {AUROC} AS auroc, {AP} AS ap FROM oruns GROUP BY 1),
opm AS (SELECT model, avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss, sum(y) / sum(p) AS oe_ratio FROM olong GROUP BY 1),
o AS (SELECT orm.model, auroc, ap, brier, logloss, oe_ratio FROM orm JOIN opm ON orm.model = opm.model)"""


@query("bootstrap_intervals", "R10 M26", "model:s metric:s estimate:f n_valid:l ci_low:f ci_high:f", with_scores(f"""{REP_SQL}, {POINT_LONG},
ml AS (UNPIVOT m ON auroc, ap, brier, logloss, oe_ratio INTO NAME metric VALUE v), ol AS (UNPIVOT o ON auroc, ap, brier, logloss, oe_ratio INTO NAME metric VALUE estimate),
ci AS (SELECT model, metric, count(v) AS n_valid, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM ml GROUP BY ALL)
SELECT ci.*, estimate FROM ci JOIN ol ON ci.model = ol.model AND ci.metric = ol.metric"""))
def _(t):
    return resample.metric_intervals(scored(t), MODELS, "entity_id", B, SEED)


@query("paired_bootstrap_difference", "R11 R12 R14 M23 M24", "metric:s estimate:f n_valid:l ci_low:f ci_high:f share_above_0:f", with_scores(f"""{REP_SQL}, {POINT_LONG},
d AS (SELECT x.b, z.auroc - x.auroc AS auroc, z.ap - x.ap AS ap, z.brier - x.brier AS brier, z.logloss - x.logloss AS logloss FROM m x JOIN m z ON x.b = z.b AND x.model = 'a' AND z.model = 'b'),
od AS (SELECT z.auroc - x.auroc AS auroc, z.ap - x.ap AS ap, z.brier - x.brier AS brier, z.logloss - x.logloss AS logloss FROM o x JOIN o z ON x.model = 'a' AND z.model = 'b'),
dl AS (UNPIVOT d ON auroc, ap, brier, logloss INTO NAME metric VALUE v), ol AS (UNPIVOT od ON auroc, ap, brier, logloss INTO NAME metric VALUE estimate)
SELECT metric, any_value(estimate) AS estimate, count(v) AS n_valid, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, count_if(v > 0) / count(v) AS share_above_0
FROM dl JOIN ol USING (metric) GROUP BY 1"""))
def _(t):
    return resample.paired_difference(scored(t), "p_ref", "p", "entity_id", B, SEED)


@query("bootstrap_operating_points", "R14", "b:l model:s target:f flagged_share:f false_alert_share:f", with_scores(f"""{DRAW_SQL}, {runs_sql('rlong', keys='b, model', w='w')},
hit AS (SELECT b, model, target, max(p) AS p FROM runs, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.7]) AS target) WHERE cum_pos / tot_pos >= target - 1e-12 GROUP BY ALL)
SELECT h.b, h.model, target, (cum_pos + cum_neg) / (tot_pos + tot_neg) AS flagged_share, cum_neg / (cum_pos + cum_neg) AS false_alert_share FROM hit h JOIN runs r ON h.b = r.b AND h.model = r.model AND h.p = r.p"""))
def _(t):
    return resample.operating_replicates(scored(t), MODELS, [0.5, 0.7], "entity_id", B, SEED)


CLIP = "greatest(least(k - (cw - w), w), 0)"


@query("bootstrap_capture", "R12 W14", "b:l model:s k:l tp:l capture:f", with_scores(f"""{DRAW_SQL},
c AS (SELECT *, sum(w) OVER (PARTITION BY b, model ORDER BY p DESC, row_key ROWS UNBOUNDED PRECEDING) AS cw, greatest(1, ceil(0.1 * sum(w) OVER (PARTITION BY b, model))) AS k, sum(w * y) OVER (PARTITION BY b, model) AS ev FROM rlong)
SELECT b, model, max(k) AS k, sum({CLIP} * y) AS tp, sum({CLIP} * y) / max(ev) AS capture FROM c GROUP BY ALL"""))
def _(t):
    return resample.capture_replicates(scored(t), MODELS, 0.1, "row_key", "entity_id", B, SEED)


@query("capacity_bootstrap", "R15 W14", "b:l model:s tp:l selected:l", with_scores(f"""{DRAW_SQL},
sz0 AS (SELECT b, fold, sum(w) AS size FROM reps GROUP BY ALL), sz AS (SELECT *, sum(size) OVER (PARTITION BY b) AS grand FROM sz0),
tt AS (SELECT (2 * 50 * count(*) + 1000) // 2000 AS total FROM scored),
al AS (SELECT b, fold, size, total, total * size // grand AS base, total * size % grand AS rem FROM sz, tt),
al2 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY rem DESC, fold) AS place, total - sum(base) OVER (PARTITION BY b) AS left_over FROM al),
alloc AS (SELECT b, fold, least(base + CASE WHEN place <= left_over THEN 1 ELSE 0 END, size) AS k FROM al2),
c AS (SELECT r.*, k, sum(w) OVER (PARTITION BY r.b, model, r.fold ORDER BY p DESC, row_key ROWS UNBOUNDED PRECEDING) AS cw FROM rlong r JOIN alloc a ON r.b = a.b AND r.fold = a.fold),
s AS (SELECT b, model, sum({CLIP} * y) AS tp FROM c GROUP BY ALL)
SELECT s.b, s.model, tp, (SELECT sum(k) FROM alloc a WHERE a.b = s.b) AS selected FROM s"""))
def _(t):
    return resample.capacity_bootstrap(scored(t), MODELS, 50, "row_key", "entity_id", B, SEED)


NEWTON_B = """
it AS (SELECT 0 AS k, b, ln(sum(w * y) / sum(w * (1 - y))) AS ia, CAST(0.0 AS DOUBLE) AS ib FROM cal GROUP BY b
 UNION ALL SELECT k + 1, b, ia + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), ib + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
  (SELECT k, b, ia, ib, sum(w * (y - mu)) AS g0, sum(w * (y - mu) * lp) AS g1, sum(w * mu * (1 - mu)) AS h00, sum(w * mu * (1 - mu) * lp) AS h01, sum(w * mu * (1 - mu) * lp * lp) AS h11 FROM
   (SELECT it.k, it.b, ia, ib, w, y, lp, 1 / (1 + exp(-(ia + ib * lp))) AS mu FROM it JOIN cal ON it.b = cal.b WHERE k < 12) GROUP BY k, b, ia, ib)),
it0 AS (SELECT 0 AS k, b, ln(sum(w * y) / sum(w * (1 - y))) - sum(w * lp) / sum(w) AS ia FROM cal GROUP BY b
 UNION ALL SELECT k + 1, b, ia + g0 / h00 FROM (SELECT k, b, ia, sum(w * (y - mu)) AS g0, sum(w * mu * (1 - mu)) AS h00 FROM
   (SELECT it0.k, it0.b, ia, w, y, 1 / (1 + exp(-(ia + lp))) AS mu FROM it0 JOIN cal ON it0.b = cal.b WHERE k < 12) GROUP BY k, b, ia))"""


@query("calibration_bootstrap", "R16", "b:l slope:f intercept:f citl:f oe_ratio:f brier:f brier_skill:f", with_scores(f"""{DRAW_SQL},
cal AS (SELECT b, w, y, p, ln(p) - ln(1 - p) AS lp FROM reps), {NEWTON_B},
pm AS (SELECT b, sum(w * y) / sum(w * p) AS oe_ratio, sum(w * (p - y) * (p - y)) / sum(w) AS brier, sum(w * y) / sum(w) AS prev FROM cal GROUP BY b)
SELECT pm.b, it.ib AS slope, it.ia AS intercept, it0.ia AS citl, oe_ratio, brier, 1 - brier / (prev * (1 - prev)) AS brier_skill FROM pm JOIN it ON pm.b = it.b AND it.k = 12 JOIN it0 ON pm.b = it0.b AND it0.k = 12""").replace("WITH", "WITH RECURSIVE", 1))
def _(t):
    return resample.calibration_bootstrap(scored(t), "entity_id", B, SEED)


@query("cluster_resample", "R17", "row_key:l copy:l", with_scores(f"""{DRAW_SQL} SELECT row_key, unnest(generate_series(1, w)) AS copy FROM reps WHERE b = 1"""))
def _(t):
    return resample.resample_clusters(scored(t), "entity_id", SEED)


@query("out_of_bag_rows", "U04", "row_key:l entity_id:l", with_scores(f"{DRAW_SQL} SELECT row_key, s.entity_id FROM scored s JOIN draws d ON s.entity_id = d.entity_id AND b = 1 AND w = 0"))
def _(t):
    return resample.out_of_bag(scored(t), "entity_id", SEED)


# ------------------------------------------------------------------ splits
PLAN = splits.TemporalSplit("2000-06-30", "2001-03-31", window_days=180)
TSPLIT_SQL = """
s0 AS (SELECT *, CASE WHEN index_date <= DATE '2000-06-30' THEN 'train' WHEN index_date <= DATE '2001-03-31' THEN 'validation' ELSE 'test' END AS split FROM scored),
fd AS (SELECT min(index_date) FILTER (WHERE split = 'validation') AS v, min(index_date) FILTER (WHERE split = 'test') AS t FROM s0),
s1 AS (SELECT s0.*, CASE WHEN split = 'train' AND index_date + 179 >= v THEN 'embargo' WHEN split = 'validation' AND index_date + 179 >= t THEN 'embargo' END AS r1 FROM s0, fd),
s2 AS (SELECT *, CASE WHEN r1 IS NULL AND split <> 'test' AND entity_id IN (SELECT entity_id FROM s1 WHERE split = 'test' AND r1 IS NULL) THEN 'entity_overlap' END AS r2 FROM s1),
s3 AS (SELECT *, coalesce(r1, r2, CASE WHEN split = 'train' AND entity_id IN (SELECT entity_id FROM s2 WHERE split = 'validation' AND r1 IS NULL AND r2 IS NULL) THEN 'entity_overlap' END) AS removed FROM s2)"""


def tsplit(t):
    return splits.temporal_split(scored(t), PLAN)


@query("temporal_split", "R01 J08", "split:s removed:s rows:l entities:l events:l", with_scores(TSPLIT_SQL + """
SELECT split, coalesce(removed, 'kept') AS removed, count(*) AS rows, count(DISTINCT entity_id) AS entities, sum(y) AS events FROM s3 GROUP BY ALL"""))
def _(t):
    return tsplit(t).groupBy("split", F.coalesce("removed", F.lit("kept")).alias("removed")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"), F.sum("y").alias("events"))


@query("split_assignments", "S17 R01", "row_key:l index_date:d split:s", with_scores(TSPLIT_SQL + " SELECT row_key, index_date, split FROM s3 WHERE removed IS NULL"))
def _(t):
    return tsplit(t).where("removed IS NULL").select("row_key", "index_date", "split")


@query("split_summary", "S17 A69", "split:s rows:l entities:l events:l prevalence:f first_date:d last_date:d", with_scores(TSPLIT_SQL + """
SELECT split, count(*) AS rows, count(DISTINCT entity_id) AS entities, sum(y) AS events, avg(y) AS prevalence, min(index_date) AS first_date, max(index_date) AS last_date FROM s3 WHERE removed IS NULL GROUP BY 1"""))
def _(t):
    return splits.split_summary(tsplit(t).where("removed IS NULL"))


@query("split_disjointness", "U02", "entities:l shared:l", with_scores(TSPLIT_SQL + """
SELECT count(*) AS entities, count_if(n > 1) AS shared FROM (SELECT entity_id, count(DISTINCT split) AS n FROM s3 WHERE removed IS NULL GROUP BY 1)"""))
def _(t):
    return splits.entity_overlap(tsplit(t).where("removed IS NULL"))


@query("group_holdout", "R02", "priority:s split:s rows:l events:l", with_scores("""
SELECT priority, CASE WHEN priority = '5-LOW' THEN 'test' WHEN priority = '2-HIGH' THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, sum(y) AS events FROM scored GROUP BY ALL"""))
def _(t):
    return splits.group_holdout(scored(t), "priority", ["2-HIGH"], ["5-LOW"]).groupBy("priority", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("events"))


U_ENTITY = hash_uniform_sql(f"'{SEED}|' || CAST(entity_id AS VARCHAR)")
GR_SQL = f"""pe AS (SELECT entity_id, max(y) AS st, {U_ENTITY} AS u FROM scored GROUP BY entity_id),
pr AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY u, entity_id) AS rn, count(*) OVER (PARTITION BY st) AS n FROM pe),
ps AS (SELECT entity_id, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' WHEN rn <= floor(n * 0.2 + 0.5) + floor(n * 0.15 + 0.5) THEN 'validation' ELSE 'train' END AS split FROM pr)"""


@query("grouped_random_split", "R03", "entity_id:l split:s rows:l", with_scores(GR_SQL + " SELECT entity_id, split, count(*) AS rows FROM scored JOIN ps USING (entity_id) GROUP BY ALL"))
def _(t):
    return splits.grouped_random_split(scored(t), "entity_id", 0.15, 0.2, SEED).groupBy("entity_id", "split").agg(F.count(F.lit(1)).alias("rows"))


U_SALT = hash_uniform_sql("'salt|' || CAST(entity_id AS VARCHAR)")
HP_SQL = f"hp AS (SELECT entity_id, {U_SALT} AS u, CASE WHEN {U_SALT} < 0.6 THEN 'train' WHEN {U_SALT} < CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT entity_id FROM scored))"


@query("hash_partition", "R04", "entity_id:l u:f9 split:s", with_scores(HP_SQL + " SELECT * FROM hp"))
def _(t):
    e = scored(t).select("entity_id").distinct()
    return e.select("entity_id", hashing.hash_uniform(F.lit("salt"), "entity_id").alias("u"), splits.hash_partition("entity_id", "salt", 0.6, 0.2).alias("split"))


@query("balanced_grouped_folds", "R05 R06", "entity_id:l size:l fold:l", with_scores(f"""
g AS (SELECT entity_id, count(*) AS size, {U_ENTITY} AS u FROM scored GROUP BY entity_id),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, u, entity_id) AS rn FROM g),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS entity_id, CAST(0 AS BIGINT) AS size, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, 0 AS fold
 UNION ALL SELECT o.rn, o.entity_id, o.size, list_transform(w.load, lambda x, i: CASE WHEN i = list_position(w.load, list_min(w.load)) THEN x + o.size ELSE x END),
  list_position(w.load, list_min(w.load)) - 1 FROM walk w JOIN o ON o.rn = w.rn + 1)
SELECT entity_id, size, fold FROM walk WHERE rn > 0""").replace("WITH", "WITH RECURSIVE", 1))
def _(t):
    return splits.balanced_folds(scored(t), "entity_id", 5, SEED)


U_ROW = hash_uniform_sql(f"'{SEED}|' || CAST(row_key AS VARCHAR)")


@query("stratified_folds", "R07 R08", "row_key:l y:l fold:l", with_scores(f"""
SELECT row_key, y, (row_number() OVER (PARTITION BY y ORDER BY u, row_key) - 1) % 5 AS fold FROM (SELECT *, {U_ROW} AS u FROM scored)"""))
def _(t):
    return splits.stratified_folds(scored(t).drop("fold"), "row_key", 5, SEED)


CONTENT = content_sql("row_key", "index_date")


@query("test_rows_content", "R09 A69", "rows:l content:s", with_scores(TSPLIT_SQL + f" SELECT count(*) AS rows, CAST(sum({CONTENT}) AS VARCHAR) AS content FROM s3 WHERE removed IS NULL AND split = 'test'"))
def _(t):
    return splits.test_rows_number(tsplit(t).where("removed IS NULL"), ["row_key", "index_date"])


@query("forbidden_rows", "J09", "split:s rows:l", with_scores(TSPLIT_SQL + """
SELECT split, count(*) AS rows FROM s3 WHERE entity_id IN (SELECT entity_id FROM s3 WHERE split = 'test' AND removed IS NULL) GROUP BY 1"""))
def _(t):
    rows = tsplit(t)
    return splits.forbidden_rows(rows, rows.where("split = 'test' AND removed IS NULL"), ["entity_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("learning_curve_subsets", "R25", "fraction:f entities:l rows:l events:l", with_scores(f"""
pe AS (SELECT entity_id, max(y) AS st, {U_ENTITY} AS u FROM scored GROUP BY entity_id),
pr AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY u, entity_id) AS rn, count(*) OVER (PARTITION BY st) AS n FROM pe)
SELECT f AS fraction, count(DISTINCT s.entity_id) AS entities, count(*) AS rows, sum(y) AS events FROM scored s JOIN pr USING (entity_id), (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5]) AS f) WHERE rn <= ceil(n * f) GROUP BY 1"""))
def _(t):
    s = scored(t)
    parts = [splits.nested_fraction(s, "entity_id", f, SEED).agg(F.lit(f).alias("fraction"), F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("rows"), F.sum("y").alias("events")) for f in (0.25, 0.5)]
    return parts[0].unionByName(parts[1])


@query("out_of_fold_completeness", "R27", "rows:l once:l wrong:l", with_scores("SELECT count(*) AS rows, count_if(n = 1) AS once, count_if(n <> 1) AS wrong FROM (SELECT entity_id, count(p) AS n FROM scored GROUP BY 1)"))
def _(t):
    return splits.fold_complete(scored(t), "entity_id")


@query("fold_thresholds_applied", "R28", "fold:l threshold:f flagged:l tp:l", with_scores(runs_sql("scored", keys="fold") + """,
th AS (SELECT fold, max(p) AS threshold FROM runs WHERE cum_pos / tot_pos >= 0.7 - 1e-12 GROUP BY 1)
SELECT s.fold, any_value(threshold) AS threshold, count_if(p >= threshold) AS flagged, count_if(p >= threshold AND y = 1) AS tp FROM scored s JOIN th ON th.fold = (s.fold + 1) % 5 GROUP BY 1"""))
def _(t):
    s = scored(t)
    th = evaluate.operating_points(s, [0.7], ["fold"]).select(F.pmod(F.col("fold") + 4, F.lit(5)).alias("fold"), "threshold")
    hit = F.col("p") >= F.col("threshold")
    return s.join(th, "fold").groupBy("fold").agg(F.max("threshold").alias("threshold"), F.count_if(hit).alias("flagged"), F.count_if(hit & (F.col("y") == 1)).alias("tp"))
