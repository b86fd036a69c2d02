"""Reference profiles, population stability and shift between two samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators.ordering import quantiles
from asofkit.operators.profile import unpivot
from asofkit.session import cut_lineage

FLOOR = 1e-4
SEVERITY = ("ok", "warn", "alert")


def decile_edges(df: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Distinct interior quantile edges per column: (column_name, edges)."""
    long = unpivot(df, cols).where("value IS NOT NULL")
    probs = [i / n_bins for i in range(1, n_bins)]
    q = quantiles(long, "value", probs, ["column_name"])
    return q.select("column_name", F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(len(probs))]))).alias("edges"))


def bin_shares(df: DataFrame, cols: Sequence[str], edges: DataFrame) -> DataFrame:
    """Share of ALL rows per bin [edge, next edge), with a bin of its own for NULL; empty bins are present with 0.

    The edge table has one row per column and is sent to every task, so the join adds one small array to
    each value and only bin counts are shuffled.
    """
    values = unpivot(df, cols)
    slot = F.when(F.col("value").isNull(), F.lit("missing")).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("value"))).cast("string"))
    got = values.join(F.broadcast(edges), "column_name").groupBy("column_name", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    names = F.concat(F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: i.cast("string")), F.array(F.lit("missing")))
    every = edges.select("column_name", F.explode(names).alias("bin"))
    full = every.join(got, ["column_name", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("column_name"))  # one row per bin
    return full.select("column_name", "bin", "n", stats.ratio(F.col("n"), total).alias("share"))


def level_shares(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of all rows per declared level, NULL as its own level."""
    counts = unpivot(df, list(levels), cast="string").groupBy("column_name", F.coalesce("value", F.lit("missing")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    declared = [F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("bin")) for c, vs in levels.items() for v in (*vs, "missing")]
    spark = df.sparkSession
    every = spark.range(1).select(F.explode(F.array(*declared)).alias("e")).select("e.*")
    total = counts.groupBy("column_name").agg(F.sum("n").alias("_t"))
    return (every.join(counts, ["column_name", "bin"], "left").join(total, "column_name")
            .select("column_name", "bin", F.coalesce("n", F.lit(0)).alias("n"), stats.ratio(F.coalesce("n", F.lit(0)), F.col("_t")).alias("share")))


def psi(expected: DataFrame, actual: DataFrame, *, renormalise: bool = True) -> DataFrame:
    """Population stability index per column from two share tables (column_name, bin, share)."""
    both = (expected.select("column_name", "bin", F.greatest("share", F.lit(FLOOR)).alias("e"))
            .join(actual.select("column_name", "bin", F.greatest("share", F.lit(FLOOR)).alias("a")), ["column_name", "bin"]))
    e, a = F.col("e"), F.col("a")
    # sum (a/A - e/E) ln((a/A)/(e/E)): the constant ln(E/A) is multiplied by 1 - 1 and drops out
    s = both.groupBy("column_name").agg(F.sum("e").alias("E"), F.sum("a").alias("A"), F.sum(a * F.log(a / e)).alias("x"), F.sum(e * F.log(a / e)).alias("y"),
                                        F.sum((a - e) * F.log(a / e)).alias("plain"))
    value = F.col("x") / F.col("A") - F.col("y") / F.col("E")
    return s.select("column_name", (value if renormalise else F.col("plain")).alias("psi"))


def status(value: Column, warn: float, alert: float, extra_warn: Column | None = None) -> Column:
    chain = F.when(value >= alert - 1e-12, "alert").when(value >= warn - 1e-12, "warn")
    if extra_warn is not None:
        chain = chain.when(extra_warn, "warn")
    return chain.otherwise("ok")


def worst(statuses: Column) -> Column:
    """Worst status as an aggregate."""
    order = F.array(*[F.lit(s) for s in SEVERITY])
    return F.element_at(order, F.max(F.array_position(order, statuses)).cast("int"))


def feature_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str], *, warn: float = 0.1, alert: float = 0.25, missing_warn: float = 0.05) -> DataFrame:
    """Per feature: stability index on the reference's decile bins, missing rates, status."""
    edges = cut_lineage(decile_edges(reference, cols))
    ref, cur = cut_lineage(bin_shares(reference, cols, edges)), cut_lineage(bin_shares(current, cols, edges))
    miss = [t.where("bin = 'missing'").select("column_name", F.col("share").alias(n)) for t, n in ((ref, "missing_reference"), (cur, "missing_current"))]
    out = psi(ref, cur).join(miss[0], "column_name").join(miss[1], "column_name")
    moved = F.abs(F.col("missing_current") - F.col("missing_reference")) >= missing_warn - 1e-12
    return out.withColumn("status", status(F.col("psi"), warn, alert, moved))


def performance_drift(reference: DataFrame, current: DataFrame, metrics: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One-row metric tables compared: absolute change against (warn, alert) per metric."""
    items = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e")).select("e.*")
    both = items(reference).withColumnRenamed("v", "reference").join(items(current).withColumnRenamed("v", "current"), "metric")
    change = F.abs(F.col("current") - F.col("reference"))
    chain = F.lit("ok")
    for m, (w, a) in metrics.items():
        chain = F.when(F.col("metric") == m, status(change, w, a)).otherwise(chain)
    return both.withColumn("change", F.col("current") - F.col("reference")).withColumn("status", chain)


def shift_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = unpivot(df, cols)
    q = quantiles(long, "value", [0.05, 0.25, 0.5, 0.75, 0.95], ["column_name"]).drop("n_observed")
    v = F.col("value")
    s = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                                        F.avg((v != 0).cast("double")).alias("share_nonzero"), (F.min(v) == F.max(v)).alias("constant"))
    return s.join(q, "column_name", "left")


def predictor_shift(old: DataFrame, new: DataFrame, kinds: Mapping[str, str], *, unit_ratio: float = 5.0, min_share: float = 0.01,
                    missing_pp: float = 10.0, warn_psi: float = 0.25) -> DataFrame:
    """Old against new extract per feature: standardised difference, stability index (no renormalising), STOP / WARN / OK verdict."""
    cols = list(kinds)
    a = shift_stats(old, cols).select("column_name", F.struct("*").alias("a"))
    b = shift_stats(new, cols).select("column_name", F.struct("*").alias("b"))
    edges = cut_lineage(decile_edges(old, cols))
    p = psi(_observed_shares(bin_shares(old, cols, edges)), _observed_shares(bin_shares(new, cols, edges)), renormalise=False)
    t = a.join(b, "column_name").join(p, "column_name", "left")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("column_name"))
    pooled = F.sqrt((F.col("a.sd") * F.col("a.sd") + F.col("b.sd") * F.col("b.sd")) / 2)
    smd = F.when(pooled > 0, (F.col("b.mean") - F.col("a.mean")) / pooled)
    ref = lambda s: F.when(kind == "continuous", F.col(f"{s}.q2")).otherwise(F.col(f"{s}.q4"))
    observed = F.col("a.n") / F.col("a.rows")
    stop = F.concat_ws("; ",
                       F.when((observed >= min_share) & (F.col("b.n") == 0), "absent"),
                       F.when((kind == "binary") & (F.col("a.share_nonzero") >= min_share) & (F.col("b.share_nonzero") == 0), "never set"),
                       F.when(~F.col("a.constant") & F.col("b.constant"), "constant"),
                       F.when((kind != "binary") & (ref("a") > 0) & (ref("b") > 0) & ((ref("b") / ref("a") > unit_ratio) | (ref("a") / ref("b") > unit_ratio)), "unit ratio"))
    missing = lambda s: 1 - F.col(f"{s}.n") / F.col(f"{s}.rows")
    warn = F.concat_ws("; ", F.when(F.abs(missing("b") - missing("a")) * 100 > missing_pp, "missingness"), F.when(F.col("psi") > warn_psi, "stability index"))
    return t.select("column_name", kind.alias("kind"), F.col("a.mean").alias("mean_old"), F.col("b.mean").alias("mean_new"), F.col("a.q2").alias("p50_old"), F.col("b.q2").alias("p50_new"),
                    smd.alias("smd"), "psi", F.when(stop != "", "STOP").when(warn != "", "WARN").otherwise("OK").alias("verdict"), F.concat_ws("; ", F.nullif(stop, F.lit("")), F.nullif(warn, F.lit(""))).alias("reason"))


def _observed_shares(t: DataFrame) -> DataFrame:
    """Shares among observed rows only."""
    seen = t.where("bin <> 'missing'")
    total = seen.groupBy("column_name").agg(F.sum("n").alias("_t"))
    return seen.join(total, "column_name").select("column_name", "bin", "n", stats.ratio(F.col("n"), F.col("_t")).alias("share"))
