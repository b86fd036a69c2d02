"""Comparisons of prediction tables, runs, cohorts and feature evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def same_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Keys only in one table and shared keys whose outcome differs; all must be 0 for a paired comparison."""
    left = a.select(*keys, F.col(y).alias("_ya"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.col(y).alias("_yb"), F.lit(True).alias("_b"))
    t = left.join(right, list(keys), "full")
    return t.agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
                 F.count_if(F.col("_a") & F.col("_b") & ~F.col("_ya").eqNullSafe(F.col("_yb"))).alias("outcome_differs"))


def paired_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate and reference risks on identical keys."""
    return a.select(*keys, "y", F.col("p").alias("p_a")).join(b.select(*keys, F.col("p").alias("p_b")), list(keys))


def cohort_overlap(earlier: DataFrame, later: DataFrame, entity: str) -> DataFrame:
    a = earlier.select(entity).distinct().withColumn("_a", F.lit(True))
    b = later.select(entity).distinct().withColumn("_b", F.lit(True))
    return a.join(b, entity, "full").agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_earlier"),
                                         F.count_if(F.col("_a").isNull()).alias("only_later"))


def seen_before(later: DataFrame, earlier: DataFrame, entity: str) -> DataFrame:
    """Later rows with a flag: the entity was in the earlier cohort."""
    seen = earlier.select(entity).distinct().withColumn("_s", F.lit(True))
    return later.join(seen, entity, "left").withColumn("seen_before", F.coalesce("_s", F.lit(False))).drop("_s")


def differing_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Shared rows, rows only in either, and per shared column the number of differing values (NULL-safe)."""
    left = a.select(*keys, F.struct(*cols).alias("_a"))
    right = b.select(*keys, F.struct(*cols).alias("_b"))
    t = left.join(right, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    items = [F.struct(F.lit(c).alias("item"), F.count_if(both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias("n")) for c in cols]
    items += [F.struct(F.lit(n).alias("item"), F.count_if(x).alias("n")) for n, x in (("(shared rows)", both), ("(only a)", F.col("_b").isNull()), ("(only b)", F.col("_a").isNull()))]
    return t.agg(F.array(*items).alias("x")).select(F.explode("x").alias("e")).select("e.*")



def alignment_check(scores: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    a = scores.select(key, F.lit(True).alias("_a"))
    b = outcomes.select(key, F.lit(True).alias("_b"))
    return a.join(b, key, "full").agg(F.count("_a").alias("scores"), F.count("_b").alias("outcomes"), F.count_if(F.col("_a") & F.col("_b")).alias("aligned"))


# ------------------------------------------------------------------ runs
def variant_rows(runs: DataFrame) -> DataFrame:
    """Nested run metrics (map split -> map variant -> map metric -> value) to one row per run, split, variant, metric."""
    by_split = runs.select("run_id", "created", "data_hash", "rows_hash", F.explode("performance").alias("split", "_v"))
    by_variant = by_split.select("run_id", "created", "data_hash", "rows_hash", "split", F.explode("_v").alias("variant", "_m"))
    return by_variant.select("run_id", "created", "data_hash", "rows_hash", "split", "variant", F.explode("_m").alias("metric", "value"))


def flag_comparable(runs: DataFrame) -> DataFrame:
    """A run is comparable when it has the most frequent (data, rows) hash pair; the lowest pair breaks ties."""
    n = F.count(F.lit(1)).over(Window.partitionBy("data_hash", "rows_hash"))
    t = runs.withColumn("_n", n)
    best = t.agg(F.max_by(F.struct("data_hash", "rows_hash"), F.struct("_n", "data_hash", "rows_hash"))).scalar()
    return t.withColumn("_b", best).withColumn("comparable", (F.col("data_hash") == F.col("_b.data_hash")) & (F.col("rows_hash") == F.col("_b.rows_hash"))).drop("_n", "_b")


def best_runs(models: DataFrame, *, auroc_margin: float, brier_margin: float, slope: tuple[float, float]) -> DataFrame:
    """Per model row (model, complexity, auroc, brier, slope, net_benefit, treat_all): best discrimination, best calibrated,
    and simplest within the margins. One row per model, so the ordering windows are small."""
    top = models.agg(F.struct(F.max("auroc").alias("a"), F.min("brier").alias("b"))).scalar()
    t = models.withColumn("_t", top)
    err = F.abs(F.col("slope") - 1)
    ok = ((F.col("auroc") >= F.col("_t.a") - auroc_margin - 1e-12) & (F.col("brier") <= F.col("_t.b") + brier_margin + 1e-12)
          & F.col("slope").between(*slope) & (F.col("net_benefit") > F.greatest(F.col("treat_all"), F.lit(0.0))))
    t = t.withColumn("_err", err).withColumn("within_margin", F.coalesce(ok, F.lit(False)))
    first = lambda *order: F.row_number().over(Window.orderBy(*order)) == 1
    return t.select(
        *models.columns, "within_margin", first(F.col("auroc").desc(), "model").alias("best_discrimination"), first("_err", "model").alias("best_calibrated"),
        (F.col("within_margin") & first(F.col("within_margin").desc(), "complexity", "_err", F.col("auroc").desc(), "model")).alias("simplest_within_margin"))


def step_changes(steps: DataFrame, order: str, metrics: Sequence[str], baseline: str) -> DataFrame:
    """Change of each metric against the previous step and the baseline step (one row per step)."""
    w = Window.orderBy(order)
    base = steps.where(F.col("name") == baseline).select(F.struct(*metrics).alias("b")).scalar()
    t = steps.withColumn("_b", base)
    return t.select(*steps.columns, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_vs_previous") for m in metrics],
                    *[(F.col(m) - F.col(f"_b.{m}")).alias(f"{m}_vs_baseline") for m in metrics])


def reproduction_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Metric rows (keys, value) of two runs: reproduced, differs, or missing on one side."""
    t = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), list(keys), "full")
    status = (F.when(F.col("a").isNull() & F.col("b").isNull(), "ok").when(F.col("a").isNull() | F.col("b").isNull(), "missing")
              .when(F.abs(F.col("a") - F.col("b")) > tolerance, "differs").otherwise("ok"))
    return t.withColumn("status", status)


def latest_reference(runs: DataFrame, kind: str, data_hash: str, rows_hash: str) -> DataFrame:
    """Latest run of a kind with the same data and rows."""
    return (runs.where((F.col("kind") == kind) & (F.col("data_hash") == data_hash) & (F.col("rows_hash") == rows_hash))
            .agg(F.max_by("run_id", "created").alias("run_id"), F.max_by("auroc", "created").alias("auroc")))


# ------------------------------------------------------------------ rules
def decision(row: DataFrame, *, slope: tuple[float, float], max_intercept: float) -> DataFrame:
    """Five pre-declared criteria over one comparison row (B minus A) and the verdict."""
    c1 = (F.col("delta_fas") < 0) & F.coalesce(F.col("delta_fas_desc") < 0, F.lit(False))
    c2 = (F.col("fas_high") < 0) & F.coalesce(F.col("fas_desc_high") < 0, F.lit(False))
    c3 = (F.size("fold_deltas") > 0) & F.forall("fold_deltas", lambda v: v < 0)
    c4 = F.when(F.col("safe_same"), c1).otherwise(F.coalesce(F.col("delta_fas_safe") < 0, F.lit(False)))
    ok = F.col("slope_b").between(*slope) & (F.abs("intercept_b") <= max_intercept)
    no_worse = (F.abs(F.col("slope_b") - 1) <= F.abs(F.col("slope_a") - 1) + 1e-12) & (F.abs("intercept_b") <= F.abs("intercept_a") + 1e-12)
    c5 = (ok | no_worse) & ~(F.col("brier_low") > 0)
    t = row.withColumns({"lower_share": c1, "interval_below_zero": c2, "every_fold_improves": c3, "not_timing_dependent": c4, "calibration_kept": c5})
    every = F.col("lower_share") & F.col("interval_below_zero") & F.col("every_fold_improves") & F.col("not_timing_dependent") & F.col("calibration_kept")
    verdict = (F.when(every, "USEFUL").when(F.col("lower_share") & (F.col("interval_below_zero") | F.col("every_fold_improves")), "PROMISING_NOT_ROBUST").otherwise("NO_ROBUST_GAIN"))
    return t.withColumn("verdict", verdict)


def composite(metrics: Mapping[str, float]) -> Column:
    """Weighted sum of metric columns, NULL when any is NULL."""
    return sum((F.col(m) * F.lit(float(w)) for m, w in metrics.items()), F.lit(0.0))


def best_trial(trials: DataFrame, *, tie: float) -> DataFrame:
    """Trials ordered by flagged share and false-alert share (rounded to ``tie``), then exact share, AP, Brier, complexity."""
    r = lambda c: F.round(F.col(c) / tie) * tie
    order = [r("flagged_share").asc_nulls_last(), r("false_alert_share").asc_nulls_last(), F.col("flagged_share").asc_nulls_last(), F.col("ap").desc_nulls_last(),
             F.col("brier").asc_nulls_last(), F.col("complexity").asc(), F.col("trial").asc()]
    return trials.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def select_model(models: DataFrame, *, reference: str, min_ap_gain: float, max_logloss_ratio: float, slope: tuple[float, float], margin: float) -> DataFrame:
    """Simplest model within ``margin`` of the best AP among those that pass the limits against the reference."""
    ref = models.where(F.col("model") == reference).select(F.struct("ap", "logloss").alias("r")).scalar()
    t = models.withColumn("_r", ref)
    passes = ((F.col("ap") - F.col("_r.ap") >= min_ap_gain) & (F.col("logloss") <= max_logloss_ratio * F.col("_r.logloss")) & F.col("slope").between(*slope))
    t = t.withColumn("passes", F.coalesce(passes, F.lit(False)) & (F.col("model") != reference))
    best = F.max(F.when(F.col("passes"), F.col("ap"))).over(Window.partitionBy())
    t = t.withColumn("candidate", F.col("passes") & (F.col("ap") >= best - margin))
    pick = F.row_number().over(Window.orderBy(F.col("candidate").desc(), "complexity", F.col("ap").desc(), "model")) == 1
    return t.withColumn("selected", F.col("candidate") & pick).drop("_r")


def trial_gain(increments: DataFrame, *, min_gain: float) -> DataFrame:
    """Plateau: the gain from one learning-curve fraction to the next is below ``min_gain`` or its interval includes 0."""
    return increments.withColumn("plateau", (F.col("gain") < min_gain) | (F.col("gain_low") <= 0))
