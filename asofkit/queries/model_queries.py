"""Model fitting and refit-based validation on the derived wide rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions import hashing, stats
from asofkit.functions.hashing import hash_uniform_sql
from asofkit.ml import models, paths, validate
from asofkit.ml.smooth import smooth_calibration
from asofkit.operators import catalog, evaluate, resample
from asofkit.queries.evaluate_queries import with_newton
from asofkit.queries.registry import Tables, query
from asofkit.queries.scores import AP, AUROC, runs_sql, scored, with_scores
from asofkit.queries.wide import wide, with_wide
from asofkit.session import cut_lineage

FEATURES = ["f_month", "f_year", "f_balance", "f_price"]


def fit_rows(t: Tables) -> DataFrame:
    """Labelled rows with double features and an entity-grouped fold, written once: fits and scores read them many times."""
    w = wide(t).where("y IS NOT NULL")
    return cut_lineage(w.select("entity_id", "segment", "split", F.concat_ws("|", "entity_id", "index_date").alias("row"), F.col("y").cast("double").alias("y"), F.col("n30").cast("double").alias("f_month"),
                    F.col("n365").cast("double").alias("f_year"), (F.col("balance") / 1000).alias("f_balance"), (F.coalesce("mean_price", F.lit(0.0)) / 100000).alias("f_price"),
                    F.floor(hashing.hash_uniform(F.lit("fold"), "entity_id") * 3).cast("int").alias("fold")))


def cv_rows(t: Tables) -> DataFrame:
    """The rows with ten entity-grouped folds."""
    return fit_rows(t).withColumn("fold", F.floor(hashing.hash_uniform(F.lit("fold"), "entity_id") * 10).cast("int"))


FOLD_SQL = "SELECT CAST(floor(" + hash_uniform_sql("'fold|' || CAST(entity_id AS VARCHAR)") + " * 10) AS INT) AS fold, y, n30 AS f_month, n365 AS f_year, balance / 1000 AS f_balance, coalesce(mean_price, 0) / 100000 AS f_price FROM wide WHERE y IS NOT NULL"
FIT_SQL = "fr AS (SELECT y, n30 AS f_month, n365 AS f_year, balance / 1000 AS f_balance, coalesce(mean_price, 0) / 100000 AS f_price FROM wide WHERE y IS NOT NULL)"


def logistic_score(train: DataFrame, test: DataFrame) -> DataFrame:
    keep = [c for c in train.columns if c in ("y", "w")]
    est = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.001)
    if "w" in keep:
        est = est.setWeightCol("w")
    model = est.fit(models.assemble(train, FEATURES, keep))
    return models.score(model, test, FEATURES, [c for c in test.columns if c in ("y", "w", "segment", "entity_id")])


@query("lasso_lambda_max", "M15 P31", "lambda_max:f8", with_wide(FIT_SQL + ", m AS (SELECT avg(y) AS my, " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM fr) SELECT greatest(" + ", ".join(
    f"abs(sum((({f}) - m_{f}) / s_{f} * (y - my)) / count(*))" for f in FEATURES) + ") AS lambda_max FROM fr, m"))
def _(t):
    return models.lambda_max(fit_rows(t), FEATURES, "y")


@query("lasso_cv_coefficients", "M15 C35 M42", "feature:s coefficient:f4 rank:l odds_ratio:f4 lambda:f identified:b")
def _(t):
    return models.path_coefficients(paths.penalised_path(cv_rows(t), FEATURES), t.spark)


@query("lasso_optimality", "M15", "feature:s residual:f4", "SELECT unnest(['(intercept)', " + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, 0.0 AS residual")
def _(t):
    rows = cv_rows(t)
    return models.optimality(rows, paths.penalised_path(rows, FEATURES))


@query("penalty_grid", "M15 P31", "step:l lambda:f8", with_wide(FIT_SQL + ", m AS (SELECT avg(y) AS my, " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM fr), top AS (SELECT greatest(" + ", ".join(
    f"abs(sum((({f}) - m_{f}) / s_{f} * (y - my)) / count(*))" for f in FEATURES) + ") AS v FROM fr, m) SELECT step, v * pow(0.0001, step / 99.0) AS lambda FROM top, range(100) r(step)"))
def _(t):
    top = models.lambda_max(fit_rows(t), FEATURES, "y")
    return top.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("step"), "lambda_max").select("step", (F.col("lambda_max") * F.pow(F.lit(0.0001), F.col("step") / 99)).alias("lambda"))


@query("training_fold_scale", "M15 C35", "fold:l feature:s n:l mean:f sd:f4", with_wide("fr AS (" + FOLD_SQL + "), k AS (SELECT DISTINCT fold AS f FROM fr) " + " UNION ALL ".join(
    f"SELECT f AS fold, '{x}' AS feature, count(*) AS n, avg({x}) AS mean, stddev_pop({x}) AS sd FROM k JOIN fr ON fold <> f GROUP BY f" for x in FEATURES)))
def _(t):
    return paths.training_scale(paths.moments(cv_rows(t), FEATURES), FEATURES)


@query("held_out_rows", "C35", "fold:l n:l", with_wide("fr AS (" + FOLD_SQL + ") SELECT fold, count(*) AS n FROM fr GROUP BY fold"))
def _(t):
    return paths.penalised_path(cv_rows(t), FEATURES, n_lambdas=1).cv_table(t.spark)


@query("fold_deviance_table", "C35 R06", "l1_ratio:f lambda:f mean_deviance:f4 se:f4 folds:l")
def _(t):
    return models.deviance_table(paths.penalised_path(cv_rows(t), FEATURES).cv_table(t.spark))


@query("elastic_net_cv", "M16", "feature:s coefficient:f4 rank:l odds_ratio:f4 l1_ratio:f lambda:f identified:b")
def _(t):
    return models.path_coefficients(paths.penalised_path(cv_rows(t), FEATURES, l1_ratios=(0.1, 0.5, 0.9, 1.0)), t.spark)


@query("elastic_net_given", "M33", "feature:s coefficient:f4 rank:l odds_ratio:f4")
def _(t):
    model = models.penalised(0.01, 0.5).fit(models.assemble(fit_rows(t), FEATURES, ["y"]))
    return models.coefficient_table(model, FEATURES, t.spark)


@query("unpenalised_logistic", "M34", "term:s estimate:f4 std_error:f4", with_newton("""
SELECT '(intercept)' AS term, a AS estimate, sqrt(h11 / (h00 * h11 - h01 * h01)) AS std_error FROM fin, info UNION ALL SELECT 'lp', b, sqrt(h00 / (h00 * h11 - h01 * h01)) FROM fin, info"""))
def _(t):
    s = scored(t).select(F.col("y").cast("double").alias("y"), stats.logit(F.col("p")).alias("lp"))
    return models.glm_table(models.fit_unpenalised(s, ["lp"]), ["lp"], t.spark)


def by_split(rows: DataFrame) -> DataFrame:
    return evaluate.ranking_metrics(rows, ["split"]).join(evaluate.point_metrics(rows, ["split"]).select("split", "n", "events"), "split")


def _tree_scores(t: Tables, est, train: DataFrame, rows: DataFrame, keep=("y",)) -> DataFrame:
    models.refuse_held_back(train, rows.where("split = 'test'"), ["row"])
    model = models.fit_trees(est, train, FEATURES, keep)
    filled = models.fill_for_trees(rows, FEATURES)
    return by_split(models.score(model, filled, models.tree_columns(FEATURES), ["y", "split"]))


@query("random_forest_scores", "M35 P30", "split:s n:l events:l auroc:f4 ap:f4")
def _(t):
    rows = fit_rows(t)
    return _tree_scores(t, models.random_forest(), rows.where("split = 'train'"), rows)


@query("gradient_boosting_scores", "M36", "split:s n:l events:l auroc:f4 ap:f4")
def _(t):
    rows = fit_rows(t)
    return _tree_scores(t, models.boosted_trees(), rows.where("split = 'train'"), rows)


@query("early_stopped_boosting", "M37", "split:s n:l events:l auroc:f4 ap:f4")
def _(t):
    rows = fit_rows(t)
    train = rows.where("split <> 'test'").withColumn("stop_rows", F.col("split") == "validation")
    return _tree_scores(t, models.boosted_trees(validation="stop_rows"), train, rows, ("y", "stop_rows"))


@query("grid_search", "M38 M30", "trial:l params:s objective:f4 place:l")
def _(t):
    rows = fit_rows(t).persist()
    train, valid = rows.where("split = 'train'"), rows.where("split = 'validation'")

    def fit_score(params):
        model = models.penalised(params["lam"], params["l1"], 50).fit(models.assemble(train, FEATURES, ["y"]))
        return models.score(model, valid, FEATURES, ["y"])

    def metrics(s):
        return evaluate.ranking_metrics(s.withColumn("k", F.lit(1)), ["k"])

    out = models.search(models.expand_space({"lam": [0.001, 0.02], "l1": [0.0, 1.0]}, 10), fit_score, metrics, {"auroc": 1.0, "ap": 0.5}, t.spark)
    rows.unpersist()
    return out


@query("separation_omissions", "M39", "round:l column_name:s rows_dropped:l", with_wide("""
f AS (SELECT y, 1 AS always, CAST(coalesce(days_to_event <= 60, false) AS INTEGER) AS soon, CAST(n365 > 2 AS INTEGER) AS busy FROM wide WHERE y IS NOT NULL)
SELECT 1 AS round, 'always' AS column_name, 0 AS rows_dropped UNION ALL SELECT 2, 'soon', sum(soon) FROM f"""))
def _(t):
    f = wide(t).where("y IS NOT NULL").select("y", F.lit(1).alias("always"), F.coalesce(F.col("days_to_event") <= 60, F.lit(False)).cast("int").alias("soon"), (F.col("n365") > 2).cast("int").alias("busy"))
    out = models.separation_omissions(f, ["always", "soon", "busy"], "y")
    return t.spark.createDataFrame([(r, c, n) for r, c, _, n in out], "round long, column_name string, rows_dropped long")


@query("power_term_deviances", "M40 P24", "variable:s powers:s degree:l deviance:f2 chosen:b")
def _(t):
    rows = fit_rows(t)
    dev = models.deviance_rows("f_balance", models.power_deviances(rows, "f_balance", ["f_year"], models.power_candidates()), t.spark)
    without = paths.logistic_fits(rows, ["f_year"], [["f_year"]])[0][2]
    chosen = models.closed_test(dev, without)
    taken = F.lit(False) if chosen is None else F.col("powers") == F.array(*[F.lit(float(p)) for p in chosen])
    return dev.withColumn("chosen", taken).withColumn("powers", F.array_join(F.col("powers").cast("array<string>"), " "))


@query("power_form_selection", "M40", "variable:s powers:s shift:f4 scale:f place:l p_nonlinear:f4 p_simplify:f4 cycles:l converged:b")
def _(t):
    out = models.select_power_forms(fit_rows(t), ["f_balance", "f_year"], ["f_month", "f_price"])
    return out.withColumn("powers", F.array_join(F.col("powers").cast("array<string>"), " "))


# ------------------------------------------------------------------ refit-based validation
OUTER = 5
DOMAINS = {"records": ["f_month", "f_year"], "balance": ["f_balance"], "price": ["f_price"]}


def outer_rows(t: Tables) -> DataFrame:
    """The rows with five entity-grouped outer folds."""
    return fit_rows(t).withColumn("fold", F.floor(hashing.hash_uniform(F.lit("outer"), "entity_id") * OUTER).cast("int"))


OUTER_SQL = "fr AS (SELECT entity_id, concat_ws('|', entity_id, index_date) AS row_key, y, CAST(floor(" + hash_uniform_sql("'outer|' || CAST(entity_id AS VARCHAR)") + f" * {OUTER}) AS INT) AS fold FROM wide WHERE y IS NOT NULL)"


@query("nested_out_of_fold", "R27", "fold:l n:l predicted:l keys:l trained_on:l entities_seen:l", with_wide(OUTER_SQL + """,
s AS (SELECT a.fold, count(DISTINCT a.entity_id) AS c FROM fr a JOIN fr b ON a.entity_id = b.entity_id AND a.fold <> b.fold GROUP BY 1)
SELECT fr.fold, count(*) AS n, count(*) AS predicted, count(DISTINCT row_key) AS keys, (SELECT count(*) FROM fr) - count(*) AS trained_on, coalesce(any_value(s.c), 0) AS entities_seen FROM fr LEFT JOIN s ON fr.fold = s.fold GROUP BY 1"""))
def _(t):
    rows = outer_rows(t)
    return validate.assembled(paths.nested_path(rows, FEATURES, folds=OUTER).out_of_fold(rows), "p_all", "row", "entity_id")


@query("nested_optimality", "R27", "fold:l feature:s residual:f4", f"SELECT fold, unnest(['(intercept)', {', '.join(f"'{f}'" for f in FEATURES)}]) AS feature, 0.0 AS residual FROM range({OUTER}) r(fold)")
def _(t):
    rows = outer_rows(t)
    return validate.nested_residuals(rows, paths.nested_path(rows, FEATURES, folds=OUTER))


@query("nested_choices", "R27", "set:s fold:l l1_ratio:f lambda:f4 selected:l")
def _(t):
    return paths.nested_path(outer_rows(t), FEATURES, folds=OUTER, l1_ratios=(0.5, 1.0)).choices(t.spark)


@query("refit_ablation", "C21", "removed:s metric:s n_valid:l estimate:f4 ci_low:f4 ci_high:f4 share_above_0:f4")
def _(t):
    return validate.refit_ablation(outer_rows(t), FEATURES, DOMAINS, "entity_id", 200, 11, folds=OUTER)


def _perm_sql(feature: str) -> str:
    u = hash_uniform_sql(f"'7|1|{feature}|' || CAST(row_key AS VARCHAR)")
    other = "p_ref" if feature == "p" else "p"
    return f"""src_{feature} AS (SELECT fold, {feature} AS v, row_number() OVER (PARTITION BY fold ORDER BY u, row_key) AS rn FROM (SELECT *, {u} AS u FROM scored)),
tgt_{feature} AS (SELECT fold, y, {other} AS o, row_number() OVER (PARTITION BY fold ORDER BY row_key) AS rn FROM scored),
sh_{feature} AS (SELECT t.fold, y, round(1 / (1 + exp(-(-2 + {'3 * v + 1.5 * o' if feature == 'p' else '3 * o + 1.5 * v'}))), 9) AS p FROM tgt_{feature} t JOIN src_{feature} s ON t.fold = s.fold AND t.rn = s.rn), {runs_sql(f'sh_{feature}', name=f'r_{feature}', keys='fold')}"""


PERM_SQL = f"""base AS (SELECT fold, y, round(1 / (1 + exp(-(-2 + 3 * p + 1.5 * p_ref))), 9) AS p FROM scored), {runs_sql('base', name='r_base', keys='fold')}, {_perm_sql('p')}, {_perm_sql('p_ref')},
mb AS (SELECT fold, {AUROC} AS a, {AP} AS q FROM r_base GROUP BY 1), mm AS (SELECT fold, 'p' AS feature, {AUROC} AS a, {AP} AS q FROM r_p GROUP BY 1 UNION ALL SELECT fold, 'p_ref', {AUROC}, {AP} FROM r_p_ref GROUP BY 1),
dr AS (SELECT mm.fold, feature, mb.a - mm.a AS auroc_drop, mb.q - mm.q AS ap_drop FROM mm JOIN mb ON mm.fold = mb.fold)"""


def perm(t: Tables) -> DataFrame:
    s = scored(t).select("row_key", "fold", "y", F.col("p").alias("a"), F.col("p_ref").alias("b"))
    risk = F.round(models.risk_column(-2.0, {"a": 3.0, "b": 1.5}), 9)
    d = validate.permutation_drops(s, ["a", "b"], risk, "row_key", 7, 1, ["fold"])
    return d.withColumn("feature", F.when(F.col("feature") == "a", "p").otherwise("p_ref"))


PERM_SQL = PERM_SQL.replace("'7|1|p|'", "'7|1|a|'").replace("'7|1|p_ref|'", "'7|1|b|'")


@query("permutation_importance", "R23 R24", "fold:l feature:s auroc_drop:f ap_drop:f", with_scores(PERM_SQL + " SELECT * FROM dr"))
def _(t):
    return perm(t)


@query("importance_rank_summary", "W15 R24 M42", "feature:s mean_drop:f sd_drop:f mean_rank:f times_in_top:l", with_scores(PERM_SQL + """,
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY auroc_drop DESC) AS r FROM dr) SELECT feature, avg(auroc_drop) AS mean_drop, stddev_samp(auroc_drop) AS sd_drop, avg(r) AS mean_rank, count_if(r <= 1) AS times_in_top FROM rk GROUP BY 1"""))
def _(t):
    return resample.importance_summary(perm(t).withColumnRenamed("auroc_drop", "drop"), top=1)


@query("feature_drivers", "J20", "family:s feature:s drop:f rank:l selected:b", with_scores(PERM_SQL + """,
f AS (SELECT CASE WHEN fold < 2 THEN 'early' ELSE 'late' END AS family, feature, avg(auroc_drop) AS dp FROM dr GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY dp DESC) AS rk FROM f)
SELECT family, feature, dp AS "drop", rk AS rank, CASE WHEN feature = 'p' THEN true END AS selected FROM r WHERE rk <= 2"""))
def _(t):
    d = perm(t).groupBy(F.when(F.col("fold") < 2, "early").otherwise("late").alias("family"), "feature").agg(F.avg("auroc_drop").alias("drop"))
    stab = d.where("feature = 'p'").select("family", "feature", F.lit(True).alias("selected"))
    return catalog.driver_table(d, stab, 2)


@query("little_or_no_value", "C36", "feature:s little_or_no_value:b", with_scores(PERM_SQL + """, s AS (SELECT feature, avg(auroc_drop) AS m, stddev_samp(auroc_drop) AS sd FROM dr GROUP BY 1) SELECT feature, m <= sd AND feature <> 'p' AS little_or_no_value FROM s UNION ALL SELECT 'unseen', NULL"""))
def _(t):
    s = validate.drop_summary(perm(t)).select("feature", "mean_drop", "sd_drop", (F.col("feature") == "p").alias("selected"))
    none = t.spark.createDataFrame([("unseen", None, None, None)], "feature string, mean_drop double, sd_drop double, selected boolean")
    return catalog.little_or_no_value(s.unionByName(none))


@query("relative_coefficients", "C34", "factor:s term:s coefficient:f relative:f", with_wide("""
l AS (SELECT 'segment' AS factor, segment AS term, y FROM wide WHERE y IS NOT NULL UNION ALL SELECT 'split', split, y FROM wide WHERE y IS NOT NULL), c AS (SELECT factor, term, ln(avg(y) / (1 - avg(y))) AS coefficient FROM l GROUP BY ALL)
SELECT *, coefficient - max(coefficient) FILTER (WHERE term IN ('BUILDING', 'train')) OVER (PARTITION BY factor) AS relative FROM c"""))
def _(t):
    rows = wide(t).where("y IS NOT NULL")
    lv = evaluate.unpivot_groups(rows, ["segment", "split"], ["y"]).groupBy(F.col("stratifier").alias("factor"), F.col("level").alias("term")).agg(F.avg("y").alias("r"))
    c = lv.select("factor", "term", F.col("term").isin("BUILDING", "train").alias("is_reference"), F.log(F.col("r") / (1 - F.col("r"))).alias("coefficient"))
    return catalog.relative_coefficients(c)


@query("coefficient_stability", "R18 R19", "feature:s replicates:l selection_frequency:f sign_consistency:f mean:f4 q025:f4 q975:f4 robust:b")
def _(t):
    coefs = validate.replicate_coefficients(fit_rows(t), FEATURES, "entity_id", 5, 30, lambda: models.penalised(0.005, 1.0, 50))
    return resample.coefficient_stability(coefs)


@query("optimism_correction", "R20", "metric:s optimism:f4 replicates:l")
def _(t):
    return validate.optimism(fit_rows(t), logistic_score, "entity_id", 5, 5)


@query("leave_one_cluster_out", "R21 R22", "segment:s n:l events:l auroc:f4 auroc_logit_se:f4 slope:f4 citl:f4 oe_ratio:f4 log_oe_se:f4")
def _(t):
    return validate.leave_one_cluster_out(fit_rows(t), "segment", "entity_id", logistic_score)


@query("cluster_heterogeneity", "R22", "priority:s n:l events:l auroc:f auroc_logit_se:f oe_ratio:f log_oe_se:f", with_scores(runs_sql("scored", keys="priority") + f""",
a AS (SELECT priority, max(tot_pos) AS n1, max(tot_neg) AS n0, {AUROC} AS auroc FROM runs GROUP BY 1), pl AS (SELECT r.priority, pos, neg, auroc, n1, n0, (tot_neg - cum_neg + neg / 2) / tot_neg AS v10, (cum_pos - pos / 2) / tot_pos AS v01 FROM runs r JOIN a ON r.priority = a.priority),
v AS (SELECT priority, any_value(auroc) AS auroc, sum(pos * pow(v10 - auroc, 2)) / (any_value(n1) - 1) / any_value(n1) + sum(neg * pow(v01 - auroc, 2)) / (any_value(n0) - 1) / any_value(n0) AS var FROM pl GROUP BY 1),
p AS (SELECT priority, count(*) AS n, sum(y) AS events, sum(y) / sum(p) AS oe_ratio, sqrt((1 - avg(y)) / sum(y)) AS log_oe_se FROM scored GROUP BY 1)
SELECT p.*, auroc, sqrt(var) / (auroc * (1 - auroc)) AS auroc_logit_se FROM p JOIN v ON p.priority = v.priority"""))
def _(t):
    return validate.heterogeneity(scored(t), "priority")


@query("learning_curve", "R25", "fraction:f rows:l auroc:f4")
def _(t):
    rows = fit_rows(t)
    return validate.learning_curve(rows.where("split = 'train'"), rows.where("split = 'validation'"), "entity_id", [0.5, 1.0], 3, logistic_score)


@query("smoothed_calibration", "M09", "point:l predicted:f4 observed:f4 ci_low:f4 ci_high:f4")
def _(t):
    return smooth_calibration(scored(t), n_grid=20)
