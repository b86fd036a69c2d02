"""Bootstrap by hashed Poisson(1) weights.

A cluster's weight in replicate ``b`` is a pure function of (seed, b, cluster): no
random state, the same for every model and for every retry of a task. All replicates of
a row travel as one vector (``replicates``), so the number of replicates changes neither
the rows that are shuffled nor the number of scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.functions.hashing import poisson_one
from asofkit.operators import replicates
from asofkit.operators.evaluate import newton_step, point_aggregates, ranking_metrics
from asofkit.operators.replicates import PER_DIGEST

MIN_VALID_SHARE = 0.8


def replicate_weight(cluster: str, seed: int) -> Column:
    """Weight of a row's cluster in replicate column ``b``: 32 bits of SHA-256, eight replicates to a digest."""
    at = F.col("b").cast("int") - 1
    text = F.concat_ws("|", F.lit(str(seed)), F.floor(at / PER_DIGEST).cast("string"), F.col(cluster).cast("string"))
    digits = F.substring(F.sha2(text, 256), 1 + 8 * (at % PER_DIGEST), F.lit(8))
    return poisson_one(F.conv(digits, 16, 10).cast("long") / F.lit(2.0**32))


def resample_clusters(df: DataFrame, cluster: str, seed: int, b: int = 1) -> DataFrame:
    """Rows of one resample: a cluster drawn k times gives its rows k times (``copy`` numbers them)."""
    w = df.withColumn("b", F.lit(b)).withColumn("_w", replicate_weight(cluster, seed))
    return w.where("_w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w", "b")


def out_of_bag(df: DataFrame, cluster: str, seed: int, b: int = 1) -> DataFrame:
    """Rows whose cluster was not drawn."""
    w = df.withColumn("b", F.lit(b)).withColumn("_w", replicate_weight(cluster, seed))
    return w.where("_w = 0").drop("_w", "b")


def unpivot_models(df: DataFrame, models: Mapping[str, str], carry: Sequence[str]) -> DataFrame:
    """Long form of several score columns: ``model`` and ``p``."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()]))
    return df.select(*carry, each.alias("_m")).select(*carry, "_m.model", "_m.p")


def _table(spark: SparkSession, columns: Mapping[str, str], rows: list[tuple]) -> DataFrame:
    """Result rows (replicates x keys) with NaN as NULL."""
    clean = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, ", ".join(f"{c} {t}" for c, t in columns.items()))


def _dealt(df: DataFrame, models: Mapping[str, str], carry: Sequence[str], cluster: str, n_boot: int, seed: int, tie: str | None = None) -> DataFrame:
    long = unpivot_models(df, models, list(dict.fromkeys([cluster, "y", *carry, *([tie] if tie else [])])))
    return replicates.deal(long, ["model", *carry], cluster, n_boot, seed, tie)


def replicate_metrics(df: DataFrame, models: Mapping[str, str], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """One row per (b, model): AUROC, AP, Brier, log loss, O/E; NULL in a single-class replicate."""
    dealt = _dealt(df, models, [], cluster, n_boot, seed)
    linked = replicates.chains(dealt, ["model"], n_boot)
    ranks = replicates.ranking(dealt, ["model"], linked, n_boot)
    rows = []
    for key, chain in linked.items():
        events, others = chain.totals
        with np.errstate(divide="ignore", invalid="ignore"):
            brier, logloss, predicted = chain.points / np.array([events + others, events + others, np.ones(n_boot)])
            values = np.stack([*ranks[key], brier, logloss, events / predicted])
        values[:, (events == 0) | (others == 0)] = np.nan
        rows += [(b + 1, *key, *column) for b, column in enumerate(values.T.tolist())]
    names = ("auroc", "ap", "brier", "logloss", "oe_ratio")
    return _table(df.sparkSession, {"b": "long", "model": "string", **dict.fromkeys(names, "double")}, rows)


def percentile_ci(values: DataFrame, metrics: Sequence[str], keys: Sequence[str], n_boot: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval per key and metric; NULL below 80% valid replicates. Also the share of replicates above 0."""
    row = values.groupBy(*keys).agg(*[F.struct(
        F.lit(m).alias("metric"), F.count(m).alias("n_valid"), F.percentile(m, alpha / 2).alias("lo"), F.percentile(m, 1 - alpha / 2).alias("hi"),
        stats.ratio(F.count_if(F.col(m) > 0), F.count(m)).alias("share_above_0")).alias(f"_{i}") for i, m in enumerate(metrics)])
    long = row.select(*keys, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(metrics))])).alias("e")).select(*keys, "e.*")
    ok = F.col("n_valid") >= MIN_VALID_SHARE * n_boot
    return long.select(*keys, "metric", "n_valid", F.when(ok, F.col("lo")).alias("ci_low"), F.when(ok, F.col("hi")).alias("ci_high"), "share_above_0")


def metric_intervals(df: DataFrame, models: Mapping[str, str], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Point estimate and percentile interval per model and metric."""
    metrics = ("auroc", "ap", "brier", "logloss", "oe_ratio")
    reps = replicate_metrics(df, models, cluster, n_boot, seed)
    return percentile_ci(reps, metrics, ["model"], n_boot).join(_points(df, models, metrics), ["model", "metric"])


def _points(df: DataFrame, models: Mapping[str, str], metrics: Sequence[str]) -> DataFrame:
    cells = df.groupBy("y", *models.values()).agg(F.count(F.lit(1)).alias("w"))
    long = unpivot_models(cells, models, ["y", "w"])
    both = (long.groupBy("model").agg(*stats.columns(point_aggregates(w=F.col("w"))))
            .join(ranking_metrics(long, ["model"], weight="w"), "model"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("estimate")) for m in metrics]))
    return both.select("model", each.alias("e")).select("model", "e.metric", "e.estimate")


def paired_difference(df: DataFrame, a: str, b: str, cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Metric differences B - A with identical weights for both score columns."""
    metrics = ("auroc", "ap", "brier", "logloss")
    models = {"a": a, "b": b}
    reps = replicate_metrics(df, models, cluster, n_boot, seed)
    diff = reps.groupBy("b").agg(*[(F.max(F.when(F.col("model") == "b", F.col(m))) - F.max(F.when(F.col("model") == "a", F.col(m)))).alias(m) for m in metrics])
    points = _points(df, models, metrics).groupBy("metric").agg(
        (F.max(F.when(F.col("model") == "b", F.col("estimate"))) - F.max(F.when(F.col("model") == "a", F.col("estimate")))).alias("estimate"))
    return percentile_ci(diff, metrics, [], n_boot).join(points, "metric")


def paired_differences(df: DataFrame, base: str, others: Mapping[str, str], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Metric differences base - other for several score columns at once: every replicate weighs all of them alike."""
    metrics = ("auroc", "ap", "brier", "logloss")
    models = {"": base, **others}
    reps = replicate_metrics(df, models, cluster, n_boot, seed)
    whole = reps.where("model = ''").select("b", *[F.col(m).alias(f"_{m}") for m in metrics])
    diff = reps.where("model <> ''").join(whole, "b").select("b", "model", *[(F.col(f"_{m}") - F.col(m)).alias(m) for m in metrics])
    points = _points(df, models, metrics)
    own = points.where("model = ''").select("metric", F.col("estimate").alias("_whole"))
    points = points.where("model <> ''").join(own, "metric").select("model", "metric", (F.col("_whole") - F.col("estimate")).alias("estimate"))
    return percentile_ci(diff, metrics, ["model"], n_boot).join(points, ["model", "metric"])


def operating_replicates(df: DataFrame, models: Mapping[str, str], targets: Sequence[float], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Per (b, model, target): share flagged and false-alert share at the highest threshold reaching the target."""
    dealt = _dealt(df, models, [], cluster, n_boot, seed)
    linked = replicates.chains(dealt, ["model"], n_boot)
    found = replicates.first_reaching(dealt, ["model"], linked, targets, n_boot)
    rows = []
    for key, chain in linked.items():
        n = chain.totals.sum(axis=0)
        for i, t in enumerate(targets):
            tp, fp = found[key][2 * i], found[key][2 * i + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = np.stack([(tp + fp) / n, fp / (tp + fp)])
            rows += [(b + 1, *key, float(t), *own) for b, own in enumerate(shares.T.tolist())]
    return _table(df.sparkSession, {"b": "long", "model": "string", "target": "double", "flagged_share": "double", "false_alert_share": "double"}, rows)


def capture_replicates(df: DataFrame, models: Mapping[str, str], fraction: float, tie: str, cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Per (b, model): events captured by the ceil(fraction * N_b) highest resampled copies and the share captured."""
    dealt = _dealt(df, models, [], cluster, n_boot, seed, tie)
    linked = replicates.chains(dealt, ["model"], n_boot)
    sizes = {key: np.maximum(1, np.ceil(fraction * chain.totals.sum(axis=0))) for key, chain in linked.items()}
    hits = replicates.top_events(dealt, ["model"], linked, sizes, n_boot)
    rows = []
    for key, chain in linked.items():
        with np.errstate(divide="ignore", invalid="ignore"):
            share = hits[key] / chain.totals[0]
        rows += [(b + 1, *key, int(k), int(tp), float(x)) for b, (k, tp, x) in enumerate(zip(sizes[key], hits[key], share, strict=True))]
    return _table(df.sparkSession, {"b": "long", "model": "string", "k": "long", "tp": "long", "capture": "double"}, rows)


def largest_remainders(sizes: np.ndarray, total: int) -> np.ndarray:
    """``total`` split over the folds (rows, lowest fold first) of each replicate (columns) in proportion to their sizes; never more than a fold's size."""
    grand = np.maximum(sizes.sum(axis=0), 1)
    base, rest = total * sizes // grand, total * sizes % grand
    place = np.argsort(np.argsort(-rest, axis=0, kind="stable"), axis=0, kind="stable")
    return np.minimum(base + (place < total - base.sum(axis=0)), sizes)


def capacity_bootstrap(df: DataFrame, models: Mapping[str, str], permille: int, tie: str, cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Captured events per (b, model) when the capacity is re-allocated over the resampled fold sizes and re-selected inside folds."""
    total = (2 * permille * df.count() + 1000) // 2000  # half up, as in capacity.n_selected
    dealt = _dealt(df, models, ["fold"], cluster, n_boot, seed, tie)
    linked = replicates.chains(dealt, ["model", "fold"], n_boot)
    sizes = {}
    for m in models:
        folds = sorted((k for k in linked if k[0] == m), key=lambda k: (k[1] is not None, k[1]))
        if folds:
            split = largest_remainders(np.stack([linked[k].totals.sum(axis=0) for k in folds]).astype(np.int64), total)
            sizes |= dict(zip(folds, split, strict=True))
    hits = replicates.top_events(dealt, ["model", "fold"], linked, sizes, n_boot)
    rows = []
    for m in {k[0] for k in linked}:
        tp, k = (sum(t[x] for x in linked if x[0] == m) for t in (hits, sizes))
        rows += [(b + 1, m, int(x), int(y)) for b, (x, y) in enumerate(zip(tp, k, strict=True))]
    return _table(df.sparkSession, {"b": "long", "model": "string", "tp": "long", "selected": "long"}, rows)


def _newton_terms(state: np.ndarray):
    """Per replicate and fit (full, offset only): the two gradients, three second derivatives and the log likelihood."""

    def terms(columns: list[np.ndarray], w: np.ndarray) -> np.ndarray:
        y, x = columns[0][:, None], columns[1][:, None]
        out = []
        for a, b in state:
            eta = a + b * x
            mu = 1 / (1 + np.exp(-eta))
            v, g = w * mu * (1 - mu), w * (y - mu)
            ll = w * (y * eta - np.logaddexp(0, eta))
            out += [g.sum(0), (g * x).sum(0), v.sum(0), (v * x).sum(0), (v * x * x).sum(0), ll.sum(0)]
        return np.stack(out)

    return terms


def calibration_bootstrap(df: DataFrame, cluster: str, n_boot: int, seed: int, max_iter: int = 50, tol: float = 1e-10, max_coef: float = 50.0) -> DataFrame:
    """Slope, intercept, calibration-in-the-large, O/E and Brier per replicate.

    Each Newton step of all replicates is one scan without a shuffle of rows; undefined fits are NULL.
    """
    p, y = F.col("p"), F.col("y")
    lp = stats.logit(p)

    def first(columns, w):
        y, x, p = columns
        return np.stack([w.sum(0), y @ w, x @ w, p @ w, ((p - y) ** 2) @ w])

    n, events, sum_lp, sum_p, square = replicates.weighted_sums(df, cluster, [y, lp, p], n_boot, seed, first)
    state, done = {}, {}
    for b in range(n_boot):
        for fit in (0, 1):
            if 0 < events[b] < n[b]:
                start = np.log(events[b] / (n[b] - events[b]))
                state[b, fit] = [start - (sum_lp[b] / n[b] if fit else 0.0), 1.0 if fit else 0.0, -np.inf, 1.0, 0.0, 0.0]
            else:
                done[b, fit] = None
    for _ in range(max_iter):
        if not state:
            break
        now = np.zeros((2, 2, n_boot))
        for (b, fit), s in state.items():
            now[fit, :, b] = s[:2]
        sums = replicates.weighted_sums(df, cluster, [y, lp], n_boot, seed, _newton_terms(now))
        for b, fit in list(state):
            newton_step((b, fit), sums[6 * fit : 6 * fit + 6, b].tolist(), state, done, bool(fit), tol, max_coef)
    rows = []
    for b in range(n_boot):
        full, large = done.get((b, 0)), done.get((b, 1))
        ratio = lambda x, z: float(x / z) if z else None
        prevalence, brier = ratio(events[b], n[b]), ratio(square[b], n[b])
        skill = 1 - brier / (prevalence * (1 - prevalence)) if prevalence and prevalence < 1 else None
        rows.append((b + 1, full and full[1], full and full[0], large and large[0], ratio(events[b], sum_p[b]), brier, skill))
    names = ("slope", "intercept", "citl", "oe_ratio", "brier", "brier_skill")
    return _table(df.sparkSession, {"b": "long", **dict.fromkeys(names, "double")}, [tuple(None if v is None else v if i == 0 else float(v) for i, v in enumerate(r)) for r in rows])


def coefficient_stability(coefs: DataFrame, *, selected_share: float = 0.8, sign_share: float = 0.9) -> DataFrame:
    """Per feature over replicate fits: selection frequency, sign consistency, quantiles and a robust flag."""
    out = coefs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg((F.col("coefficient") != 0).cast("double")).alias("selection_frequency"),
        F.count_if(F.col("coefficient") > 0).alias("_pos"), F.count_if(F.col("coefficient") < 0).alias("_neg"),
        F.avg("coefficient").alias("mean"), F.percentile("coefficient", 0.025).alias("q025"), F.percentile("coefficient", 0.975).alias("q975"))
    sign = stats.ratio(F.greatest("_pos", "_neg"), F.col("_pos") + F.col("_neg"))
    return out.withColumn("sign_consistency", sign).withColumn(
        "robust", (F.col("selection_frequency") >= selected_share) & F.coalesce(F.col("sign_consistency") >= sign_share, F.lit(False))).drop("_pos", "_neg")


def importance_summary(drops: DataFrame, top: int = 10) -> DataFrame:
    """Per feature over folds: mean and SD of the metric drop, mean rank and times in the top ``top`` (rank within fold)."""
    ranked = drops.withColumn("rank", F.rank().over(Window.partitionBy("fold").orderBy(F.col("drop").desc())))
    return ranked.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev("drop").alias("sd_drop"), F.avg("rank").alias("mean_rank"),
                                         F.count_if(F.col("rank") <= top).alias("times_in_top"))
