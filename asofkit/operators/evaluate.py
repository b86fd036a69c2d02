"""Score evaluation: tables with a 0/1 outcome ``y`` and a risk ``p``, optionally weighted and split by keys.

Ranking metrics read one table of running counts per distinct score (``score_runs``);
everything else is a single grouped aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators.grouped_fit import fit_by_key
from asofkit.operators.ordering import prefix_sums, quantiles, rank_rows


def score_runs(df: DataFrame, keys: Sequence[str] = (), *, weight: str | None = None, p: str = "p", bounds: Column | None = None) -> DataFrame:
    """Distinct scores, highest first, with events ``pos`` and non-events ``neg``, running sums and totals."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return prefix_sums(df.select(*keys, F.col(p).alias("p"), (w * F.col("y")).alias("_pos"), (w * (1 - F.col("y"))).alias("_neg")),
                       "p", {"pos": F.col("_pos"), "neg": F.col("_neg")}, keys, bounds=bounds)


def auroc_of_runs() -> Column:
    """Concordance with ties half, as an aggregate over ``score_runs``."""
    pairs = F.sum(F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2))
    return F.when((F.max("tot_pos") > 0) & (F.max("tot_neg") > 0), pairs / (F.max("tot_pos").cast("double") * F.max("tot_neg")))


def ap_of_runs() -> Column:
    """Step-wise average precision, as an aggregate over ``score_runs``."""
    flagged = F.col("cum_pos") + F.col("cum_neg")
    return F.when(F.max("tot_pos") > 0, F.sum(stats.ratio(F.col("pos"), F.col("tot_pos")) * stats.ratio(F.col("cum_pos"), flagged)))


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), *, weight: str | None = None, p: str = "p", bounds: Column | None = None) -> DataFrame:
    """AUROC and average precision per key; ``bounds`` as in ``prefix_sums``."""
    return score_runs(df, keys, weight=weight, p=p, bounds=bounds).groupBy(*keys).agg(auroc_of_runs().alias("auroc"), ap_of_runs().alias("ap"))


def delong(df: DataFrame, keys: Sequence[str] = (), *, p: str = "p") -> DataFrame:
    """AUROC with its DeLong variance and the SE of logit(AUROC), from placement values per distinct score."""
    runs = score_runs(df, keys, p=p)
    pos, neg, tp, tn = (F.col(c).cast("double") for c in ("pos", "neg", "tot_pos", "tot_neg"))
    v10 = stats.ratio(tn - F.col("cum_neg") + neg / 2, tn)
    v01 = stats.ratio(F.col("cum_pos") - pos / 2, tp)
    sums = runs.groupBy(*keys).agg(
        F.max("tot_pos").alias("n1"), F.max("tot_neg").alias("n0"), auroc_of_runs().alias("auroc"),
        F.sum(pos * v10).alias("s1"), F.sum(pos * v10 * v10).alias("q1"), F.sum(neg * v01).alias("s0"), F.sum(neg * v01 * v01).alias("q0"))
    n1, n0 = F.col("n1"), F.col("n0")
    var = ((F.col("q1") - F.col("s1") * F.col("s1") / n1) / (n1 - 1) / n1) + ((F.col("q0") - F.col("s0") * F.col("s0") / n0) / (n0 - 1) / n0)
    out = sums.withColumn("variance", F.when((n1 >= 2) & (n0 >= 2), var))
    c = F.col("auroc")
    return out.select(*keys, "n1", "n0", "auroc", "variance",
                      F.when((c > 0) & (c < 1), F.sqrt("variance") / (c * (1 - c))).alias("logit_se"))


def point_aggregates(y: Column | None = None, p: Column | None = None, w: Column | None = None) -> dict[str, Column]:
    """Metrics that need no order, as aggregates."""
    y, p = (F.col("y") if y is None else y), (F.col("p") if p is None else p)
    w = F.lit(1) if w is None else w
    n, events, q = F.sum(w), F.sum(w * y), stats.clip(p, 1e-15, 1 - 1e-15)
    brier = F.sum(w * (p - y) * (p - y)) / n
    prev = events / n
    null = prev * (1 - prev)
    return {
        "n": n, "events": events, "prevalence": prev, "mean_predicted": F.sum(w * p) / n, "brier": brier,
        "brier_skill": F.when(null > 0, 1 - brier / null),
        "logloss": -F.sum(w * (y * F.log(q) + (1 - y) * F.log(1 - q))) / n,
        "oe_ratio": stats.ratio(events, F.sum(w * p)),
        "log_oe_se": F.when(events > 0, F.sqrt((1 - prev) / events)),
    }


def point_metrics(df: DataFrame, keys: Sequence[str] = (), *, weight: str | None = None, p: str = "p") -> DataFrame:
    parts = point_aggregates(p=F.col(p), w=F.col(weight) if weight else None)
    return df.groupBy(*keys).agg(*stats.columns(parts))


SCALAR_METRICS = ("auroc", "pr_auc", "brier", "calibration_slope", "calibration_intercept", "citl", "oe_ratio")  # fixed names


def parse_metric(name: str) -> tuple[str, float | None]:
    """A scalar metric name, or ``net_benefit@t`` with 0 < t < 1."""
    if name in SCALAR_METRICS:
        return name, None
    head, _, t = name.partition("@")
    if head != "net_benefit" or not t or not 0.0 < float(t) < 1.0:
        raise ValueError(f"unknown metric {name!r}")
    return head, float(t)


def performance_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per named metric; only the parts the names need are computed."""
    parsed = {n: parse_metric(n) for n in names}
    benefit = {n: stats.net_benefit(F.sum(F.when(F.col("p") >= t, F.col("y")).otherwise(0)), F.sum(F.when(F.col("p") >= t, 1 - F.col("y")).otherwise(0)), F.count(F.lit(1)), F.lit(t))
               for n, (head, t) in parsed.items() if head == "net_benefit"}
    points = point_aggregates()
    wanted = {n: points[n] for n in ("brier", "oe_ratio") if n in parsed}
    parts = [df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in {**wanted, **benefit}.items()])]
    if {"auroc", "pr_auc"} & set(parsed):
        parts.append(ranking_metrics(df).withColumnRenamed("ap", "pr_auc"))
    if {"calibration_slope", "calibration_intercept", "citl"} & set(parsed):
        parts.append(calibration_measures(df).select(F.col("slope").alias("calibration_slope"), F.col("intercept").alias("calibration_intercept"), "citl"))
    out = side_by_side(parts, [])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]))
    return out.select(each.alias("e")).select("e.*")


# ------------------------------------------------------------------ calibration by Newton steps
def fit_calibration(df: DataFrame, keys: Sequence[str] = (), *, lp: str = "lp", weight: str | None = None, offset_only: bool = False,
                    max_iter: int = 50, tol: float = 1e-10, max_coef: float = 50.0) -> DataFrame:
    """Maximum-likelihood ``logit P(y) = a + b*lp`` per key; with ``offset_only`` b is fixed at 1 (``grouped_fit.fit_by_key``).

    Undefined fits are NULL; ``fit_status`` says why.
    """
    return fit_by_key(df, keys, lp=lp, weight=weight, offset_only=[offset_only], max_iter=max_iter, tol=tol, max_coef=max_coef).drop("offset_only")


def newton_step(k, sums, state, done, offset_only, tol, max_coef) -> None:
    g0, g1, h00, h01, h11, ll = sums
    s = state[k]
    a, b, best, scale, da, db = s
    if ll < best - 1e-9 * abs(best) and scale > 1e-8:  # the last step went too far: halve it
        s[0], s[1], s[3] = a - scale * da / 2, b - scale * db / 2, scale / 2
        return
    if offset_only:
        if h00 <= 0:
            done[k] = None
            del state[k]
            return
        da, db, var_a, var_b = g0 / h00, 0.0, 1 / h00, None
    else:
        det = h00 * h11 - h01 * h01
        if det <= 1e-12 * max(h00 * h11, 1e-300):
            done[k] = None
            del state[k]
            return
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        var_a, var_b = h11 / det, h00 / det
    if max(abs(da), abs(db)) < tol * (1 + max(abs(a), abs(b))):
        done[k] = (a, b, math.sqrt(var_a), math.sqrt(var_b) if var_b is not None else None)
        del state[k]
        return
    if max(abs(a + da), abs(b + db)) > max_coef:
        done[k] = None
        del state[k]
        return
    state[k] = [a + da, b + db, ll, 1.0, da, db]


def side_by_side(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Metric tables joined on their keys; one-row tables without keys become scalars of the first."""
    out = parts[0]
    for i, part in enumerate(parts[1:]):
        if keys:
            out = out.join(part, list(keys))
        else:
            one = part.select(F.struct(*part.columns)).scalar()
            out = out.withColumn(f"_s{i}", one).select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(f"_s{i}.`{c}`").alias(c) for c in part.columns])
    return out


def calibration_measures(df: DataFrame, keys: Sequence[str] = (), *, p: str = "p", weight: str | None = None) -> DataFrame:
    """Slope and intercept, and calibration-in-the-large, per key, both fits in shared steps; ``fit_status`` is the first fit's."""
    fits = fit_by_key(df.withColumn("lp", stats.logit(F.col(p))), keys, weight=weight, offset_only=[False, True])
    large = F.col("offset_only")
    parts = {c: F.when(~large, F.col(c)) for c in ("intercept", "slope", "intercept_se", "slope_se", "fit_status")}
    parts |= {"citl": F.when(large, F.col("intercept")), "citl_se": F.when(large, F.col("intercept_se"))}
    return fits.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in parts.items()])


def metric_bundle(df: DataFrame, keys: Sequence[str] = (), *, p: str = "p") -> DataFrame:
    """Ranking, accuracy and calibration metrics in one row per key."""
    keys = list(keys)
    return side_by_side([point_metrics(df, keys, p=p), ranking_metrics(df, keys, p=p), calibration_measures(df, keys, p=p)], keys)


# ------------------------------------------------------------------ calibration tables
def equal_groups(rn: Column, n: Column, k: int) -> Column:
    """1-based group of position ``rn``: k groups whose sizes differ by at most one, larger groups first."""
    i, q, r = rn - 1, F.floor(n / k), n % k
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / q)) + 1


def position_decile(rn: Column, n: Column, q: int) -> Column:
    return F.floor((rn - 1) * q / n) + 1


def grouped_calibration(df: DataFrame, tie: str, groups: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean risk against observed rate in groups of equal size by risk, with the Wald interval cut to [0, 1]."""
    ranked = rank_rows(df, "p", tie, keys=keys, descending=False)
    out = (ranked.groupBy(*keys, equal_groups(F.col("rn"), F.col("tot_n"), groups).alias("grp"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.avg("p").alias("mean_predicted"),
                F.min("p").alias("min_predicted"), F.max("p").alias("max_predicted")))
    rate = F.col("events") / F.col("n")
    half = 1.959963984540054 * F.sqrt(rate * (1 - rate) / F.col("n"))
    return out.select("*", rate.alias("observed_rate"), F.greatest(F.lit(0.0), rate - half).alias("ci_low"),
                      F.least(F.lit(1.0), rate + half).alias("ci_high"))


def risk_deciles(df: DataFrame, tie: str, q: int = 10) -> DataFrame:
    ranked = rank_rows(df, "p", tie, descending=False)
    return (ranked.groupBy(position_decile(F.col("rn"), F.col("tot_n"), q).alias("decile"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate")))


# ------------------------------------------------------------------ thresholds
def threshold_counts(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at each threshold (flagged when p >= t).

    Rows are counted once per slot between thresholds; the small slot table then gives every threshold.
    """
    ts = sorted(thresholds)
    cuts = F.array(*[F.lit(float(t)) for t in ts])
    slot = F.size(F.filter(cuts, lambda c: c <= F.col("p")))
    slots = (df.groupBy(*keys, slot.alias("_slot")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    hits = slots.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_slot") > i, F.col("pos")).otherwise(0)).alias(f"_tp{i}") for i in range(len(ts))],
        *[F.sum(F.when(F.col("_slot") > i, F.col("neg")).otherwise(0)).alias(f"_fp{i}") for i in range(len(ts))],
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(ts)]))
    return (hits.select(*keys, "_p", "_n", each.alias("e"))
            .select(*keys, "e.threshold", "e.tp", "e.fp", (F.col("_p") - F.col("e.tp")).alias("fn"), (F.col("_n") - F.col("e.fp")).alias("tn")))


def with_rates(counts: DataFrame) -> DataFrame:
    rates = stats.confusion_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[c.alias(n) for n, c in rates.items() if n not in counts.columns])


def threshold_metrics(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    t = with_rates(threshold_counts(df, thresholds, keys))
    f1 = stats.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return t.select("*", f1.alias("f1"), stats.net_benefit(F.col("tp"), F.col("fp"), F.col("n"), F.col("threshold")).alias("net_benefit"))


def decision_curve(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    t = threshold_metrics(df, thresholds, keys)
    prev = F.col("events") / F.col("n")
    th = F.col("threshold")
    return t.select(*keys, "threshold", F.col("net_benefit").alias("model"), (prev - (1 - prev) * th / (1 - th)).alias("treat_all"),
                    F.lit(0.0).alias("treat_none"), stats.ratio(F.col("net_benefit"), prev).alias("standardised"))


def run_counts(runs: DataFrame) -> DataFrame:
    """Confusion counts when every score >= the run's score is flagged."""
    return runs.withColumns({"tp": F.col("cum_pos"), "fp": F.col("cum_neg"),
                             "fn": F.col("tot_pos") - F.col("cum_pos"), "tn": F.col("tot_neg") - F.col("cum_neg")})


def exhaustive_thresholds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score used as threshold."""
    return with_rates(run_counts(score_runs(df, keys)).select(*keys, F.col("p").alias("threshold"), "tp", "fp", "fn", "tn"))


def grid_thresholds(df: DataFrame, step: float, keys: Sequence[str] = ()) -> DataFrame:
    """Only the thresholds at which the flagged share first reaches a new multiple of ``step``."""
    runs = score_runs(df, keys)
    n = F.col("tot_pos") + F.col("tot_neg")
    k, own = F.col("cum_pos") + F.col("cum_neg"), F.col("pos") + F.col("neg")

    def level(flagged):
        return F.floor((flagged / n + 1e-12) / step)

    hit = run_counts(runs.where(level(k) > level(k - own)))
    return with_rates(hit.select(*keys, F.col("p").alias("threshold"), "tp", "fp", "fn", "tn"))


def operating_points(df: DataFrame, targets: Sequence[float], keys: Sequence[str] = (), *, weight: str | None = None) -> DataFrame:
    """HIGHEST threshold whose sensitivity reaches each target; tied scores are flagged together."""
    runs = run_counts(score_runs(df, keys, weight=weight))
    at = F.struct("p", "tp", "fp", "fn", "tn")
    reached = [F.max(F.when(stats.ratio(F.col("cum_pos"), F.col("tot_pos")) >= t - 1e-12, at)) for t in targets]
    row = runs.groupBy(*keys).agg(*[c.alias(f"_t{i}") for i, c in enumerate(reached)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("at")) for i, t in enumerate(targets)]))
    flat = row.select(*keys, each.alias("e")).select(*keys, "e.target", F.col("e.at.p").alias("threshold"), "e.at.tp", "e.at.fp", "e.at.fn", "e.at.tn")
    return with_rates(flat).withColumn("degenerate", F.col("fn") + F.col("tn") == 0)


# ------------------------------------------------------------------ curves
def curve_points(df: DataFrame, max_points: int = 300) -> DataFrame:
    """ROC and precision-recall coordinates, thinned evenly by flagged share to at most ``max_points`` (plus the last)."""
    runs = run_counts(score_runs(df))
    n = F.col("tot_pos") + F.col("tot_neg")
    k, own = F.col("tp") + F.col("fp"), F.col("pos") + F.col("neg")
    keep = F.floor(k * (max_points - 1) / n) > F.floor((k - own) * (max_points - 1) / n)
    return runs.where(keep).select(F.col("p").alias("threshold"), stats.ratio(F.col("tp"), F.col("tot_pos")).alias("tpr"),
                                   stats.ratio(F.col("fp"), F.col("tot_neg")).alias("fpr"), (F.col("tp") / k).alias("precision"))


def risk_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Counts by class in equal bins from 0 to the 99.5th percentile; higher risks share the last bin."""
    top = quantiles(df, "p", [0.995]).select("q0").scalar()
    b = F.least(F.floor(F.coalesce(stats.ratio(F.col("p"), F.col("_top")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return (df.withColumn("_top", top).groupBy(b.alias("bin")).agg(F.sum("y").alias("events"), F.sum(1 - F.col("y")).alias("non_events")))


def prediction_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and deciles of the risk per key (model, outcome)."""
    q = quantiles(df, "p", [0.1, 0.5, 0.9], keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean")).join(q, list(keys)).select(
        *keys, "n", "mean", F.col("q0").alias("p10"), F.col("q1").alias("p50"), F.col("q2").alias("p90"))


def unpivot_groups(df: DataFrame, groups: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Long form (stratifier, level) of several grouping columns; NULL becomes 'unknown'."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("stratifier"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("level")) for g in groups]))
    return df.select(*carry, each.alias("_g")).select("_g.stratifier", "_g.level", *carry)


def subgroup_performance(df: DataFrame, groups: Sequence[str], *, min_events: int = 10) -> DataFrame:
    """Metrics per level of each stratifier; AUROC with its interval only from ``min_events`` events and non-events.

    Rows are first counted per (group columns, score), so unpivoting multiplies counts, not rows.
    """
    cells = df.groupBy(*groups, "p").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"))
    long = unpivot_groups(cells, groups, ["p", "_pos", "_neg"])
    runs = prefix_sums(long, "p", {"pos": F.col("_pos"), "neg": F.col("_neg")}, ["stratifier", "level"])
    out = runs.groupBy("stratifier", "level").agg(
        F.max("tot_pos").alias("events"), F.max("tot_neg").alias("non_events"), auroc_of_runs().alias("_auc"),
        F.sum((F.col("pos") + F.col("neg")) * F.col("p")).alias("expected"))
    ok = (F.col("events") >= min_events) & (F.col("non_events") >= min_events)
    ci = stats.hanley_mcneil(F.col("_auc"), F.col("events"), F.col("non_events"))
    return out.select("stratifier", "level", (F.col("events") + F.col("non_events")).alias("n"), "events",
                      stats.ratio(F.col("events"), F.col("expected")).alias("oe_ratio"), *[F.when(ok, c).alias(n) for n, c in ci.items()])


def subgroup_at_threshold(df: DataFrame, groups: Sequence[str], threshold: float, *, powered_events: int = 20) -> DataFrame:
    """The overall threshold applied inside every subgroup."""
    hit = F.col("p") >= threshold
    cells = df.groupBy(*groups).agg(
        F.sum(F.when(hit, F.col("y")).otherwise(0)).alias("tp"), F.sum(F.when(hit, 1 - F.col("y")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("y")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, 1 - F.col("y")).otherwise(0)).alias("tn"))
    long = unpivot_groups(cells, groups, ["tp", "fp", "fn", "tn"]).groupBy("stratifier", "level").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return with_rates(long).withColumn("powered", F.col("events") >= powered_events)


def error_groups(df: DataFrame, tie: str, *, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """Rows labelled by risk position and outcome: high_event, high_non_event, low_event, low_non_event (others NULL)."""
    ranked = rank_rows(df, "p", tie, descending=False)
    pos = F.col("rn") / F.col("tot_n")
    side = F.when(pos > high, "high").when(pos <= low, "low")
    return ranked.withColumn("error_group", F.concat_ws("_", side, F.when(F.col("y") == 1, "event").otherwise("non_event"))).where(side.isNotNull())


def adverse_favourable(df: DataFrame) -> DataFrame:
    """Risk intervals (lo, hi) resolved against and in favour of the model: column ``mode`` and ``p``."""
    event = F.col("y") == 1
    adverse = F.when(event, F.col("lo")).otherwise(F.col("hi"))
    favourable = F.when(event, F.col("hi")).otherwise(F.col("lo"))
    return df.withColumn("_m", F.explode(F.array(F.struct(F.lit("adverse").alias("mode"), adverse.alias("p")),
                                                 F.struct(F.lit("favourable").alias("mode"), favourable.alias("p"))))).select(*df.columns, "_m.mode", "_m.p")
