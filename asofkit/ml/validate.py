"""Refit-based validation: permutation importance, optimism, stability, leave-one-cluster-out, learning curves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.hashing import hash_uniform
from asofkit.ml import paths
from asofkit.ml.models import assemble
from asofkit.operators.contracts import ContractError
from asofkit.operators.evaluate import calibration_measures, delong, point_metrics, ranking_metrics
from asofkit.operators.ordering import even_bounds, range_count, rank_spread, value_bounds
from asofkit.operators.resample import paired_differences, replicate_weight
from asofkit.operators.splits import nested_fraction

FitScore = Callable[[DataFrame, DataFrame], DataFrame]
"""Fits on the first table and returns the second with its risk ``p``."""


def shuffled(df: DataFrame, features: Sequence[str], key: str, seed: int, repeats: int, keys: Sequence[str] = ()) -> DataFrame:
    """The table once per (feature, repeat) with that feature permuted inside ``keys``.

    The value at place i of a hashed order goes to the row at place i by key: two distributed
    rankings (one for all features and repeats together) and one equi join.
    """
    keys = list(keys)
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col(f).cast("double").alias("value")) for f in features for r in range(1, repeats + 1)]))
    long = df.select(*keys, key, items.alias("_e")).select(*keys, key, "_e.feature", "_e.repeat", F.col("_e.value").alias("_value"))
    by_hash = long.withColumn("_u", hash_uniform(F.lit(str(seed)), F.col("repeat"), F.col("feature"), F.col(key)))
    source = rank_spread(by_hash, "_u", key, [*keys, "feature", "repeat"], bounds=even_bounds(df)).select(*keys, "feature", "repeat", "rn", "_value")
    target = rank_spread(df, key, key, keys)
    mixed = target.join(source, [*keys, "rn"])
    return mixed.select("feature", "repeat", *[F.when(F.col("feature") == c, F.col("_value")).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def permutation_drops(df: DataFrame, features: Sequence[str], risk: Column, key: str, seed: int, repeats: int, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC and AP drop per (keys, feature, repeat) when one raw feature is shuffled; ``risk`` scores a row from its features."""
    keys = list(keys)
    link = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    scored = base.withColumn("p", risk)
    bounds = value_bounds(scored, "p", range_count(df))  # shuffled risks spread over the same range
    b = ranking_metrics(scored, link, bounds=bounds).select(*link, F.col("auroc").alias("_a"), F.col("ap").alias("_p"))
    m = ranking_metrics(shuffled(base, features, key, seed, repeats, link).withColumn("p", risk), [*link, "feature", "repeat"], bounds=bounds)
    return m.join(b, link).select(*keys, "feature", "repeat", (F.col("_a") - F.col("auroc")).alias("auroc_drop"), (F.col("_p") - F.col("ap")).alias("ap_drop"))


def drop_summary(drops: DataFrame) -> DataFrame:
    return drops.groupBy("feature").agg(F.avg("auroc_drop").alias("mean_drop"), F.stddev("auroc_drop").alias("sd_drop"), F.count(F.lit(1)).alias("repeats"))


def weighted_resample(df: DataFrame, cluster: str, seed: int, b: int) -> DataFrame:
    """Rows of replicate ``b`` with a weight column ``w`` for estimators that take one."""
    return df.withColumn("b", F.lit(b)).withColumn("w", replicate_weight(cluster, seed).cast("double")).where("w > 0").drop("b")


ROWS_A_PART = 1_000_000


def in_few_parts(kept: DataFrame) -> DataFrame:
    """Cached rows in as many parts as there are cores, more where a part would exceed ``ROWS_A_PART``: every pass of every fit sends one result a part to the driver."""
    return kept.coalesce(max(kept.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // ROWS_A_PART)))


def replicate_coefficients(df: DataFrame, features: Sequence[str], cluster: str, seed: int, n_boot: int, make: Callable[[], object]) -> DataFrame:
    """Coefficients of a weighted refit per replicate: (replicate, feature, coefficient)."""
    rows = []
    kept = df.select(cluster, "y", *features).persist()
    try:
        few = in_few_parts(kept)
        for b in range(1, n_boot + 1):
            model = make().setWeightCol("w").fit(assemble(weighted_resample(few, cluster, seed, b), features, ["y", "w"]))
            rows += [(b, f, float(c)) for f, c in zip(features, model.coefficients)]
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(rows, "replicate int, feature string, coefficient double")


def optimism(df: DataFrame, fit_score: FitScore, cluster: str, seed: int, n_boot: int) -> DataFrame:
    """Mean of (metric on the resample - metric on the original rows) over refits, per metric."""
    rows = []
    df = df.persist()
    try:
        for b in range(1, n_boot + 1):
            boot = weighted_resample(df, cluster, seed, b)
            own = _metrics(fit_score(boot, boot), weight="w")
            orig = _metrics(fit_score(boot, df))
            rows += [(b, m, float(own[m] - orig[m])) for m in ("auroc", "brier")]
    finally:
        df.unpersist()
    t = df.sparkSession.createDataFrame(rows, "replicate int, metric string, optimism double")
    return t.groupBy("metric").agg(F.avg("optimism").alias("optimism"), F.count(F.lit(1)).alias("replicates"))


def _metrics(scored: DataFrame, weight: str | None = None) -> dict[str, float]:
    base = scored.withColumn("_all", F.lit(1))
    return ranking_metrics(base, ["_all"], weight=weight).join(point_metrics(base, ["_all"], weight=weight), "_all").first().asDict()


def leave_one_cluster_out(df: DataFrame, cluster: str, entity: str, fit_score: FitScore, *, min_events: int = 10) -> DataFrame:
    """Metrics per cluster predicted by a model fitted without it; entities that straddle clusters stop the job."""
    straddle = df.groupBy(entity).agg(F.count_distinct(cluster).alias("_n")).where("_n > 1")
    if not straddle.isEmpty():
        raise ValueError("entities have rows in several clusters")
    sizes = df.groupBy(cluster).agg(F.sum("y").alias("events")).where(F.col("events") >= min_events).orderBy(cluster).collect()
    parts = None
    for r in sizes:
        scored = fit_score(df.where(F.col(cluster) != r[cluster]), df.where(F.col(cluster) == r[cluster])).withColumn(cluster, F.lit(r[cluster]))
        parts = scored if parts is None else parts.unionByName(scored)
    return heterogeneity(parts, cluster)


def heterogeneity(scored: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: AUROC, calibration slope and in-the-large with their standard errors, O/E with the SE of its log."""
    d = delong(scored, [cluster]).select(cluster, "auroc", F.col("logit_se").alias("auroc_logit_se"))
    c = calibration_measures(scored, [cluster]).select(cluster, "slope", "slope_se", "citl", "citl_se")
    p = point_metrics(scored, [cluster]).select(cluster, "n", "events", "oe_ratio", "log_oe_se")
    return p.join(d, cluster).join(c, cluster)


def learning_curve(train: DataFrame, validation: DataFrame, entity: str, fractions: Sequence[float], seed: int, fit_score: FitScore) -> DataFrame:
    """Validation AUROC after refitting on nested stratified entity subsets."""
    rows = []
    train, validation = train.persist(), validation.persist()
    try:
        for f in fractions:
            part = nested_fraction(train, entity, f, seed).persist()
            try:
                m = _metrics(fit_score(part, validation))
                rows.append((float(f), part.count(), float(m["auroc"])))
            finally:
                part.unpersist()
    finally:
        train.unpersist()
        validation.unpersist()
    return train.sparkSession.createDataFrame(rows, "fraction double, rows long, auroc double")


def refit_ablation(df: DataFrame, features: Sequence[str], domains: Mapping[str, Sequence[str]], cluster: str, n_boot: int, seed: int, **nested) -> DataFrame:
    """Per removed domain and metric: full minus ablated, with a paired interval.

    The full model and one model without each domain are tuned and refitted in every outer fold
    (``paths.nested_path``, shared passes), and compared on the pooled out-of-fold predictions.
    """
    sets = {"full": tuple(features), **{d: tuple(f for f in features if f not in set(gone)) for d, gone in domains.items()}}
    if len(sets) != len(domains) + 1:
        raise ContractError("a domain is named full")
    rows = paths.nested_path(df, features, sets=sets, **nested).out_of_fold(df)
    out = paired_differences(rows, "p_full", {d: f"p_{d}" for d in domains}, cluster, n_boot, seed)
    return out.withColumnRenamed("model", "removed")


def assembled(rows: DataFrame, p: str, key: str, entity: str) -> DataFrame:
    """Per outer fold: rows, predictions, distinct keys, rows its model trained on, and entities that its model has met.

    A complete assembly has n = predicted = keys and meets no entity.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    shared = rows.groupBy(entity).agg(F.collect_set("fold").alias("folds")).where(F.size("folds") > 1).select(F.explode("folds").alias("fold"))
    met = shared.groupBy("fold").agg(F.count(F.lit(1)).alias("entities_seen"))
    own = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count(p).alias("predicted"), F.count_distinct(key).alias("keys")).withColumn("trained_on", total - F.col("n"))
    return own.join(met, "fold", "left").withColumn("entities_seen", F.coalesce("entities_seen", F.lit(0)))


def nested_residuals(rows: DataFrame, nested: paths.Nested, which: int = 0) -> DataFrame:
    """(fold, feature, residual): how far each outer fold's model is from its optimality conditions, computed from the rows outside the fold."""
    folds = nested.lam.shape[1]
    out = lambda c, k: F.avg(F.when(F.col("fold") != k, c))
    scale = rows.agg(*[F.struct(*[s for f in nested.features for s in (out(F.col(f), k).alias(f"m_{f}"), F.stddev_pop(F.when(F.col("fold") != k, F.col(f))).alias(f"s_{f}"))]).alias(f"_{k}") for k in range(folds)]).first()
    sums = []
    for k in range(folds):
        c = nested.coefficients[which, k]
        eta = F.lit(float(c[0]))
        for f, b in zip(nested.features, c[1:], strict=True):
            eta = eta + F.lit(float(b)) * F.col(f)
        r = 1 / (1 + F.exp(-eta)) - F.col("y")
        sums.append(F.struct(out(r, k).alias("(intercept)"), *[out(r * (F.col(f) - scale[f"_{k}"][f"m_{f}"]) / scale[f"_{k}"][f"s_{f}"], k).alias(f) for f in nested.features]).alias(f"_{k}"))
    g = rows.agg(*sums).first()
    found = []
    for k in range(folds):
        lam, a = nested.lam[which, k], nested.l1_ratio[which, k]
        found.append((k, "(intercept)", abs(g[f"_{k}"]["(intercept)"])))
        for f, b in zip(nested.features, nested.coefficients[which, k, 1:], strict=True):
            b = b * scale[f"_{k}"][f"s_{f}"]
            slope = g[f"_{k}"][f] + lam * (1 - a) * b
            residual = max(abs(slope) - lam * a, 0.0) if abs(b) < paths.ZERO_SPREAD else abs(slope + lam * a * (1 if b > 0 else -1))
            found.append((k, f, float(residual)))
    return rows.sparkSession.createDataFrame(found, "fold int, feature string, residual double")
