"""Profiles of wide tables.

Columns are unpivoted to (column_name, value) and aggregated by column, so the plan does
not grow with the number of statistics per column and one hot value is one counted row.
Quantiles come from running counts of distinct values (``ordering.quantiles``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import stats, suppress
from asofkit.operators.evaluate import auroc_of_runs
from asofkit.operators.ordering import prefix_sums, quantiles
from asofkit.session import cut_lineage


# ------------------------------------------------------------------ long form
def unpivot(df: DataFrame, cols: Sequence[str], carry: Sequence[str] = (), cast: str = "double", value: str = "value") -> DataFrame:
    """Long form: carry, column_name, value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias(value)) for c in cols]))
    return df.select(*carry, each.alias("_e")).select(*carry, "_e.column_name", f"_e.{value}")


def with_bases(df: DataFrame, bases: Mapping[str, Column]) -> DataFrame:
    """Rows repeated per population they belong to (column ``basis``)."""
    names = F.filter(F.array(*[F.when(m, F.lit(b)) for b, m in bases.items()]), lambda x: x.isNotNull())
    return df.withColumn("basis", F.explode(names))


# ------------------------------------------------------------------ counts
def value_counts(df: DataFrame, cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Rows per (column, level); NULL is a level of its own."""
    long = unpivot(df, cols, carry, "string")
    return long.groupBy(*carry, "column_name", F.coalesce("value", F.lit("NULL")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def top_levels(counts: DataFrame, k: int, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """The k most frequent levels per column (level name breaks ties)."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "level")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def categorical_profile(df: DataFrame, cols: Sequence[str], bases: Mapping[str, Column], *, allowed: Mapping[str, Sequence[str]], min_cell: int,
                        max_levels: int = 30) -> DataFrame:
    """Level counts per column and basis; the tail beyond ``max_levels`` is one merged row."""
    counts = value_counts(with_bases(df, bases), cols, ["basis"])
    keys = ["basis", "column_name"]
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "level")
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumn("place", F.row_number().over(w)).withColumn("rows", total)
    merged = (ranked.withColumn("level", F.when(F.col("place") <= max_levels, F.col("level")).otherwise(F.lit("(more levels)")))
              .groupBy(*keys, "level", "rows").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels_merged")))
    outside = F.lit(False)
    for c, levels in allowed.items():
        outside = outside | ((F.col("column_name") == c) & ~F.col("level").isin("NULL", "(more levels)", *levels))
    return merged.select(*keys, "level", "n", "levels_merged", (100.0 * F.col("n") / F.col("rows")).alias("pct"),
                         ((F.col("n") < min_cell) | (F.col("n") / F.col("rows") < 0.005)).alias("sparse"), outside.alias("out_of_list"))


def crosstab(df: DataFrame, a: str, b: str, min_cell: int) -> DataFrame:
    counts = df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("NULL")).alias("level_a"), F.coalesce(F.col(b).cast("string"), F.lit("NULL")).alias("level_b")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select("level_a", "level_b", suppress.cell(F.col("n"), min_cell).alias("n"), suppress.small(F.col("n"), min_cell).alias("suppressed"))


# ------------------------------------------------------------------ columns
def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Observed, missing, distinct, share of the top value and status per column.

    Reads the level counts, so distinct values are counted exactly without a distinct aggregate.
    """
    counts = value_counts(df, cols)
    real = F.col("level") != "NULL"
    out = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("observed"), F.count_if(real).alias("distinct"),
        F.max(F.when(real, F.col("n"))).alias("_top"))
    share = stats.ratio(F.col("_top"), F.col("observed"))
    status = (F.when(F.col("observed") == 0, "EMPTY").when(F.col("distinct") <= 1, "CONSTANT").when(share >= 0.995, "NEAR_CONSTANT").otherwise("VARIABLE"))
    return out.select("column_name", "rows", "observed", (F.col("rows") - F.col("observed")).alias("missing"), "distinct", share.alias("top_share"), status.alias("status"))


def numeric_profile(df: DataFrame, cols: Sequence[str], bases: Mapping[str, Column]) -> DataFrame:
    """Moments, quantiles, 3-IQR outliers, bias-corrected skewness and excess kurtosis per column and basis."""
    keys = ["basis", "column_name"]
    v, c = F.col("value"), F.col("_c")
    # The rows are read once; everything follows from counted values.
    cells = cut_lineage(unpivot(with_bases(df, bases), cols, ["basis"]).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c")))
    basic = cells.groupBy(*keys).agg(
        F.sum(c).alias("rows"), F.sum(F.when(v.isNotNull(), c).otherwise(0)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * c) / F.sum(F.when(v.isNotNull(), c))).alias("mean"),
        F.sum(F.when(v == 0, c).otherwise(0)).alias("zeros"), F.sum(F.when(v < 0, c).otherwise(0)).alias("negatives"))
    off = v - F.col("mean")
    spread = cells.join(basic.select(*keys, "mean"), keys).groupBy(*keys).agg(*[F.sum(c * F.pow(off, k)).alias(f"_m{k}") for k in (2, 3, 4)])
    size = F.col("n").cast("double")
    shape = F.when(F.col("_m2") > 0, size)
    moments = (basic.join(spread, keys).withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (size - 1))))
               .withColumn("_g1", F.sqrt(shape) * F.col("_m3") / F.pow("_m2", F.lit(1.5))).withColumn("_g2", shape * F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3))
    cells = cells.where(v.isNotNull())
    q = quantiles(cells, "value", [0.01, 0.25, 0.5, 0.75, 0.99], keys, weight="_c").select(
        *keys, *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p01", "p25", "p50", "p75", "p99"))])
    iqr = F.col("p75") - F.col("p25")
    tails = (cells.join(q, keys).groupBy(*keys).agg(
        F.sum(F.when((iqr > 0) & (v > F.col("p75") + 3 * iqr), F.col("_c")).otherwise(0)).alias("above_3iqr"),
        F.sum(F.when((iqr > 0) & (v < F.col("p25") - 3 * iqr), F.col("_c")).otherwise(0)).alias("below_3iqr"), F.count(F.lit(1)).alias("distinct")))
    n = F.col("n").cast("double")
    return (moments.join(q, keys, "left").join(tails, keys, "left")
            .select(*keys, "rows", "n", "min", "max", "mean", "sd", "p01", "p25", "p50", "p75", "p99", iqr.alias("iqr"), "zeros", "negatives",
                    stats.sample_skewness(n, F.col("_g1")).alias("skewness"), stats.sample_kurtosis(n, F.col("_g2")).alias("excess_kurtosis"),
                    "above_3iqr", "below_3iqr", "distinct"))


def transformation_hint(profile: DataFrame) -> DataFrame:
    """Text hints from zero share, skewness, and the maximum against p99."""
    zero = stats.ratio(F.col("zeros"), F.col("n"))
    hints = F.concat_ws("; ", F.when(zero >= 0.5, "zero-inflated"), F.when((F.col("skewness") > 1) & (F.col("min") >= 0), "right-skewed"),
                        F.when((F.col("max") > 0) & (F.col("p99") > 0) & (F.col("max") > 3 * F.col("p99")), "heavy upper tail"))
    text = (F.when(F.col("n") == 0, "no data").when(F.col("distinct") <= 2, "binary").when(hints == "", "none").otherwise(hints))
    return profile.select("basis", "column_name", text.alias("hint"))


def identical_columns(df: DataFrame, cols: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """Pairs of columns equal in every row including NULLs.

    Columns with equal order-free hash sums are candidates; each candidate pair is then verified by a count.
    """
    sums = [F.struct(F.count(c).alias("n"), F.sum(F.xxhash64(F.col(c).cast("string"), *row_key).cast("decimal(38,0)")).alias("h")).alias(f"_{i}") for i, c in enumerate(cols)]
    one = df.agg(*sums).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(cols):
        if one[i]["n"]:
            groups.setdefault((one[i]["n"], one[i]["h"]), []).append(c)
    pairs = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[i + 1:]]
    schema = "column_a string, column_b string, differing long"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*[F.count_if(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_{i}").alias("differing")) for i, (a, b) in enumerate(pairs)]))
    return counts.select(each.alias("e")).select("e.*").where("differing = 0")


# ------------------------------------------------------------------ NULLs
def null_classes(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str]]], default: Mapping[str, str], sentinels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Class of every NULL per column: the first rule (class, SQL condition) that holds, else the declared class; sentinels apart."""
    parts = []
    for c in default:
        chain = None
        for klass, cond in rules.get(c, ()):
            test = F.coalesce(F.expr(cond), F.lit(False))
            chain = F.when(test, klass) if chain is None else chain.when(test, klass)
        klass = F.lit(default[c]) if chain is None else chain.otherwise(default[c])
        value = F.when(F.col(c).isNull(), klass)
        if sentinels and c in sentinels:
            value = F.when(F.col(c).isin(*[F.lit(s).cast("date") for s in sentinels[c]]), F.lit("SENTINEL")).otherwise(value)
        parts.append(F.struct(F.lit(c).alias("column_name"), value.alias("null_class")))
    long = df.select(F.explode(F.array(*parts)).alias("e")).select("e.*")
    return long.where("null_class IS NOT NULL").groupBy("column_name", "null_class").agg(F.count(F.lit(1)).alias("n"))


def missing_bands(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing share per column with its band."""
    out = unpivot(df, cols, cast="string").groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"))
    pct = 100.0 * F.col("missing") / F.col("rows")
    band = F.when(pct > 99, ">99%").when(pct > 90, ">90%").when(pct > 50, ">50%").when(pct > 25, ">25%").when(F.col("missing") == 0, "0%").otherwise("<=25%")
    return out.select("column_name", "rows", "missing", pct.alias("missing_pct"), band.alias("band"))


def null_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per pattern of NULL columns ('1' = NULL): few rows however large the table."""
    pattern = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def co_missingness(df: DataFrame, cols: Sequence[str], *, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Phi correlation and Jaccard index of the NULL indicators of partly missing column pairs, from the pattern counts."""
    pats = null_patterns(df, cols)
    idx = range(len(cols))
    pairs = F.explode(F.array(*[F.struct(F.lit(cols[i]).alias("column_a"), F.lit(cols[j]).alias("column_b"), (F.substring("pattern", i + 1, 1) == "1").cast("int").alias("a"),
                                         (F.substring("pattern", j + 1, 1) == "1").cast("int").alias("b")) for i in idx for j in idx if i < j]))
    long = pats.select("n", pairs.alias("e")).select("n", "e.*")
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    s = long.groupBy("column_a", "column_b").agg(F.sum(n).alias("rows"), F.sum(n * a).alias("miss_a"), F.sum(n * b).alias("miss_b"), F.sum(n * a * b).alias("both"))
    rows, ma, mb, both = (F.col(c).cast("double") for c in ("rows", "miss_a", "miss_b", "both"))
    inside = (ma / rows).between(low, high) & (mb / rows).between(low, high)
    phi = (rows * both - ma * mb) / F.sqrt(ma * (rows - ma) * mb * (rows - mb))
    return s.where(inside).select("column_a", "column_b", phi.alias("phi"), stats.ratio(both, ma + mb - both).alias("jaccard"), F.col("both"))


def block_patterns(df: DataFrame, sources: Mapping[str, Sequence[str]], *, min_cell: int, top: int = 15) -> DataFrame:
    """Row patterns of wholly missing sources; patterns beyond the top or below the cell size are merged."""
    flags = []
    for cols in sources.values():
        all_null = F.lit(True)
        for c in cols:
            all_null = all_null & F.col(c).isNull()
        flags.append(F.when(all_null, F.lit("1")).otherwise(F.lit("0")))
    counts = df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    # At most 2^sources patterns reach this window.
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "pattern")))
    keep = (F.col("place") <= top) & (F.col("n") >= min_cell)
    return ranked.groupBy(F.when(keep, F.col("pattern")).otherwise(F.lit("(other)")).alias("pattern")).agg(F.sum("n").alias("n"))


def row_missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distribution of the per-row NULL share."""
    count = sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int"))
    cells = df.groupBy((count / len(cols)).alias("share")).agg(F.count(F.lit(1)).alias("c"))
    q = quantiles(cells, "share", [0.5, 0.9, 0.99], weight="c").select(F.struct("n_observed", "q0", "q1", "q2").alias("q")).scalar()
    return (cells.withColumn("q", q).groupBy("q").agg(
        F.sum(F.when(F.col("share") > 0.5, F.col("c")).otherwise(0)).alias("above_50"), F.sum(F.when(F.col("share") > 0.75, F.col("c")).otherwise(0)).alias("above_75"),
        F.sum(F.when(F.col("share") > F.col("q.q2"), F.col("c")).otherwise(0)).alias("above_p99"))
        .select(F.col("q.n_observed").alias("rows"), F.col("q.q0").alias("median_share"), F.col("q.q1").alias("p90_share"), F.col("q.q2").alias("p99_share"),
                "above_50", "above_75", "above_p99"))


def missing_against_outcome(df: DataFrame, cols: Sequence[str], y: str, *, min_share: float = 0.01) -> DataFrame:
    """Event rate of rows with the column missing against observed, with the ratio interval."""
    flags = [F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("m")) for c in cols]
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*flags)).alias("e")).select("y", "e.*")
    m = F.col("m")
    s = long.groupBy("column_name").agg(F.count_if(m).alias("n_missing"), F.sum(F.when(m, F.col("y")).otherwise(0)).alias("events_missing"),
                                        F.count_if(~m).alias("n_observed"), F.sum(F.when(~m, F.col("y")).otherwise(0)).alias("events_observed"))
    share = F.col("n_missing") / (F.col("n_missing") + F.col("n_observed"))
    pr = stats.prevalence_ratio(*[F.col(c) for c in ("events_missing", "n_missing", "events_observed", "n_observed")])
    return (s.where((share >= min_share) & (F.col("n_observed") > 0))
            .select("*", stats.ratio(F.col("events_missing"), F.col("n_missing")).alias("rate_missing"), stats.ratio(F.col("events_observed"), F.col("n_observed")).alias("rate_observed"), *stats.columns(pr)))


# ------------------------------------------------------------------ cohort tables
def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], *, entity: str, y: str) -> DataFrame:
    """Ordered steps, each a narrower mask: rows, entities, events, rows removed at the step.

    Each row carries the depth it reaches; entities are counted on their deepest row, so one
    aggregate by entity and one by depth replace a distinct count per step.
    """
    depth = F.lit(0)
    alive = F.lit(True)
    for _, mask in steps:
        alive = alive & F.coalesce(mask, F.lit(False))
        depth = depth + alive.cast("int")
    rows = df.select(entity, F.col(y).alias("_y"), depth.alias("_d"))
    by_row = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("rows"), F.sum("_y").alias("events"))
    by_entity = rows.groupBy(entity).agg(F.max("_d").alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("entities"))
    both = by_row.join(by_entity, "_d", "left")
    agg = both.agg(*[F.struct(F.coalesce(F.sum(F.when(F.col("_d") >= i, F.col("rows"))), F.lit(0)).alias("rows"),
                              F.coalesce(F.sum(F.when(F.col("_d") >= i, F.col("entities"))), F.lit(0)).alias("entities"),
                              F.coalesce(F.sum(F.when(F.col("_d") >= i, F.col("events"))), F.lit(0)).alias("events"),
                              F.coalesce(F.sum(F.when(F.col("_d") == i - 1, F.col("rows"))), F.lit(0)).alias("removed")).alias(f"_{i}") for i in range(len(steps) + 1)])
    names = ["all rows", *[n for n, _ in steps]]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"_{i}").alias("v")) for i, n in enumerate(names)]))
    return agg.select(each.alias("e")).select("e.step", "e.stage", "e.v.*")


def stratified_prevalence(df: DataFrame, strata: Sequence[str], y: str, *, min_cell: int) -> DataFrame:
    """n, events and Wilson interval per stratifier and level (plus overall), suppressed when a cell is small."""
    cells = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_e"))
    items = [F.struct(F.lit(s).alias("stratifier"), F.coalesce(F.col(s).cast("string"), F.lit("NULL")).alias("level")) for s in strata]
    items.append(F.struct(F.lit("overall").alias("stratifier"), F.lit("all").alias("level")))
    t = (cells.select("_n", "_e", F.explode(F.array(*items)).alias("g")).groupBy("g.stratifier", "g.level")
         .agg(F.sum("_n").alias("n"), F.sum("_e").alias("events")).withColumn("non_events", F.col("n") - F.col("events")))
    w = t.select("*", *stats.columns(stats.wilson(F.col("events"), F.col("n"))))
    return suppress.suppress_together(w, ["n", "events", "non_events"], ["rate", "ci_low", "ci_high"], min_cell)


def population_profile(df: DataFrame, cols: Sequence[str], bases: Mapping[str, Column], min_cell: int) -> DataFrame:
    """Level counts and shares of categorical variables for several populations."""
    counts = value_counts(with_bases(df, bases), cols, ["basis"])
    total = F.sum("n").over(Window.partitionBy("basis", "column_name"))
    return counts.select("basis", F.col("column_name").alias("variable"), "level", suppress.cell(F.col("n"), min_cell).alias("n"),
                         F.when(~suppress.small(F.col("n"), min_cell), 100.0 * F.col("n") / total).alias("pct"))


# ------------------------------------------------------------------ association with an outcome
def univariate_auroc(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Concordance of each numeric column with the outcome over its observed rows, with interval."""
    long = unpivot(df, cols, [y]).where("value IS NOT NULL")
    runs = prefix_sums(long.withColumnRenamed(y, "_y"), "value", {"pos": F.col("_y"), "neg": 1 - F.col("_y")}, ["column_name"])
    out = runs.groupBy("column_name").agg(auroc_of_runs().alias("_a"), F.max("tot_pos").alias("n1"), F.max("tot_neg").alias("n0"))
    return out.select("column_name", "n1", "n0", *stats.columns(stats.hanley_mcneil(F.col("_a"), F.col("n1"), F.col("n0"))))


def smd_by_class(df: DataFrame, cols: Sequence[str], group: Column) -> DataFrame:
    """Mean, sample variance and standardised mean difference of each column between group 1 and 0."""
    long = unpivot(df.withColumn("_g", group.cast("int")), cols, ["_g"])
    v = F.col("value")
    s = long.groupBy("column_name").agg(*[f for g in (1, 0) for f in (
        F.count(F.when(F.col("_g") == g, v)).alias(f"n{g}"), F.avg(F.when(F.col("_g") == g, v)).alias(f"mean{g}"),
        F.var_samp(F.when(F.col("_g") == g, v)).alias(f"var{g}"), F.count_if((F.col("_g") == g) & v.isNull()).alias(f"missing{g}"))])
    return s.withColumn("smd", stats.smd(F.col("mean1"), F.col("var1"), F.col("n1"), F.col("mean0"), F.col("var0"), F.col("n0")))


def numeric_by_outcome(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Per column: counts, means, median and quartiles by class, standardised difference, concordance."""
    base = smd_by_class(df, cols, F.col(y) == 1)
    long = unpivot(df, cols, [y]).where("value IS NOT NULL")
    q = quantiles(long, "value", [0.25, 0.5, 0.75], ["column_name", y])
    wide = q.groupBy("column_name").agg(*[F.max(F.when(F.col(y) == g, F.col(f"q{i}"))).alias(f"{n}_{g}") for g in (1, 0) for i, n in enumerate(("p25", "p50", "p75"))])
    return base.join(wide, "column_name").join(univariate_auroc(df, cols, y).drop("n1", "n0"), "column_name")


def categorical_by_outcome(df: DataFrame, cols: Sequence[str], y: str, *, min_cell: int, max_levels: int = 25) -> DataFrame:
    """Per level: rate with Wilson interval and ratio to the most frequent level; sparse and separated levels are flagged.

    The ``max_levels`` most frequent levels are listed; ``rows_left_out`` and ``levels_left_out`` say what a column has beyond them.
    """
    counts = (unpivot(df, cols, [y], "string").groupBy("column_name", F.coalesce("value", F.lit("NULL")).alias("level"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events")))
    ref = counts.groupBy("column_name").agg(F.max_by(F.struct("level", "n", "events"), F.struct("n", "level")).alias("ref"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("levels"))
    t = counts.join(ref, "column_name")
    n, e = F.col("n"), F.col("events")
    pr = stats.prevalence_ratio(e, n, F.col("ref.events"), F.col("ref.n"))
    top = top_levels(t, max_levels)
    sep = F.when((e == 0) & (n >= min_cell), "no events").when((e == n) & (n >= min_cell), "only events").otherwise("")
    listed = Window.partitionBy("column_name")  # max_levels rows
    return top.select("column_name", "level", (F.col("level") == F.col("ref.level")).alias("is_reference"), "n", "events", *stats.columns(stats.wilson(e, n)),
                      *stats.columns(pr), ((n < min_cell) | (n / F.col("rows") < 0.005)).alias("sparse"), sep.alias("separation"),
                      (F.col("rows") - F.sum("n").over(listed)).alias("rows_left_out"), (F.col("levels") - F.count(F.lit(1)).over(listed)).alias("levels_left_out"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cramer's V without correction for column pairs, over rows where both are observed."""
    items = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs]
    cells = (df.select(F.explode(F.array(*items)).alias("e")).select("e.*").where("a IS NOT NULL AND b IS NOT NULL")
             .groupBy("column_a", "column_b", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))
    key = ["column_a", "column_b"]
    ra, rb, tot = (F.sum("n").over(Window.partitionBy(*key, *k)) for k in (["a"], ["b"], []))
    m = cells.withColumn("_ra", ra).withColumn("_rb", rb).withColumn("_n", tot)
    # sum (o - e)^2 / e over all cells = n * (sum o^2 / (ra rb)) - n, so empty cells need no rows
    s = m.groupBy(*key).agg(F.sum(F.col("n") * F.col("n") / (F.col("_ra") * F.col("_rb"))).alias("_q"), F.max("_n").alias("n"),
                            F.count_distinct("a").alias("_r"), F.count_distinct("b").alias("_c"))
    k = F.least("_r", "_c") - 1
    return s.select(*key, "n", F.when(k > 0, F.sqrt(F.greatest(F.col("_q") - 1, F.lit(0.0)) / k)).alias("cramers_v"))


def baseline_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str) -> DataFrame:
    """Baseline characteristics by class: median and quartiles, or counts and shares, with standardised difference and missing."""
    num = numeric_by_outcome(df, numeric, y).select(
        F.col("column_name").alias("variable"), F.lit("median").alias("level"), F.col("p50_0").alias("non_event"), F.col("p50_1").alias("event"),
        F.col("smd"), (F.col("missing1") + F.col("missing0")).alias("missing"))
    counts = (unpivot(df, categorical, [y], "string").groupBy("column_name", F.coalesce("value", F.lit("missing")).alias("level"))
              .agg(F.sum(y).alias("k1"), F.sum(1 - F.col(y)).alias("k0")))
    w = Window.partitionBy("column_name")
    t = counts.withColumn("n1", F.sum("k1").over(w)).withColumn("n0", F.sum("k0").over(w))
    p1, p0 = F.col("k1") / F.col("n1"), F.col("k0") / F.col("n0")
    v1, v0 = p1 * (1 - p1) * F.col("n1") / (F.col("n1") - 1), p0 * (1 - p0) * F.col("n0") / (F.col("n0") - 1)
    cat = t.select(F.col("column_name").alias("variable"), "level", (100 * p0).alias("non_event"), (100 * p1).alias("event"),
                   stats.smd(p1, v1, F.col("n1"), p0, v0, F.col("n0")).alias("smd"), F.lit(None).cast("long").alias("missing"))
    return num.unionByName(cat)


# ------------------------------------------------------------------ correlation
def column_ranks(df: DataFrame, cols: Sequence[str], row_key: str) -> DataFrame:
    """The table with every column replaced by its average rank over that column's observed rows."""
    long = unpivot(df, cols, [row_key]).where("value IS NOT NULL")
    runs = prefix_sums(long, "value", {"n": F.lit(1).cast("long")}, ["column_name"], descending=False)
    ranks = runs.select("column_name", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    back = long.join(ranks, ["column_name", "value"])
    return back.groupBy(row_key).agg(*[F.max(F.when(F.col("column_name") == c, F.col("rank"))).alias(c) for c in cols])


def pairwise_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete sums (n, sx, sy, sxx, syy, sxy) for every column pair i < j.

    Each task multiplies its own Arrow batches into p x p partial matrices; only those matrices
    are shuffled, so the cost of the exchange does not depend on the number of rows.
    """
    names = list(cols)

    def partial(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            m = np.isfinite(x).astype("float64")
            z = np.where(m > 0, x, 0.0)
            parts = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
            total = parts if total is None else total + parts
        if total is None:
            return
        n, s, ss, xy = total
        i, j = np.triu_indices(len(names), 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "sxx": ss[i, j], "syy": ss[j, i], "sxy": xy[i, j]})

    out = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    label = F.array(*[F.lit(c) for c in names])
    return (out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
            .withColumn("column_a", F.element_at(label, F.col("i") + 1)).withColumn("column_b", F.element_at(label, F.col("j") + 1)).drop("i", "j"))


def correlation_pairs(df: DataFrame, cols: Sequence[str], *, min_pairs: int = 30) -> DataFrame:
    """Pearson correlation per pair over rows where both are observed (NULL below ``min_pairs``)."""
    s = pairwise_sums(df, cols)
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return s.select("column_a", "column_b", F.col("n").cast("long").alias("n"), F.when((n >= min_pairs) & (vx > 0) & (vy > 0), r).alias("r"))


def spearman_pairs(df: DataFrame, cols: Sequence[str], row_key: str, *, min_pairs: int = 100) -> DataFrame:
    """Correlation of per-column ranks, with the redundancy band."""
    r = correlation_pairs(column_ranks(df, cols, row_key).select(*cols), cols, min_pairs=min_pairs)
    a = F.abs("r")
    band = F.when(a >= 0.95, "CANDIDATE_DUPLICATE").when(a >= 0.8, "HIGHLY_REDUNDANT").when(a >= 0.5, "MODERATE").when(a >= 0.3, "WEAK")
    return r.withColumn("redundancy", band)


def redundancy_clusters(pairs: DataFrame, order: Sequence[str], threshold: float) -> DataFrame:
    """Anchored clusters without chaining, visiting features in ``order``.

    The pair table is as large as the number of feature pairs, never as the data, so the greedy
    pass runs on the driver.
    """
    strong: dict[str, dict[str, float]] = {}
    for r in pairs.where(F.abs("r") >= threshold).select("column_a", "column_b", "r").collect():
        strong.setdefault(r[0], {})[r[1]] = abs(r[2])
        strong.setdefault(r[1], {})[r[0]] = abs(r[2])
    free, rows, k = list(order), [], 0
    while free:
        head = free.pop(0)
        members = [f for f in free if f in strong.get(head, {})]
        if members:
            k += 1
            free = [f for f in free if f not in members]
            rows += [(k, head, m, 1.0 if m == head else strong[head][m]) for m in (head, *members)]
    return pairs.sparkSession.createDataFrame(rows, "cluster int, representative string, member string, abs_r double")


# ------------------------------------------------------------------ splits
def split_balance(df: DataFrame, cols: Sequence[str], split: str, reference: str = "train", *, limit: float = 0.1) -> DataFrame:
    """Mean and SD per split and the standardised difference to the reference split."""
    long = unpivot(df, cols, [split])
    s = long.groupBy("column_name", split).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    ref = s.where(F.col(split) == reference).select("column_name", F.struct("n", "mean", "var").alias("r"))
    d = stats.smd(F.col("mean"), F.col("var"), F.col("n"), F.col("r.mean"), F.col("r.var"), F.col("r.n"))
    return s.join(ref, "column_name").select("column_name", split, "n", "mean", F.sqrt("var").alias("sd"), d.alias("smd")).withColumn(
        "imbalanced", F.coalesce(F.abs("smd") > limit, F.lit(False)))


def missing_by_split(df: DataFrame, cols: Sequence[str], split: str) -> DataFrame:
    return unpivot(df, cols, [split], "string").groupBy("column_name", split).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def adequacy(df: DataFrame, features: Sequence[str], split: str, y: str, *, parameters: int, min_epp: float, min_events: int) -> DataFrame:
    """Rows, events, non-events per split, events per parameter, and READY / INSUFFICIENT."""
    s = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("events"), F.sum(1 - F.col(y)).alias("non_events"))
    epp = F.least("events", "non_events") / F.lit(float(parameters))
    ok = (F.col("events") >= min_events) & (F.col("non_events") >= min_events) & ((F.col(split) != "train") | (epp >= min_epp))
    return s.withColumn("events_per_parameter", epp).withColumn("verdict", F.when(ok, "READY").otherwise("INSUFFICIENT"))


def sparse_predictors(df: DataFrame, binary: Sequence[str], y: str, *, min_events: int) -> DataFrame:
    """Constant and sparse 0/1 predictors: cells of the 2 x 2 table with the outcome."""
    long = unpivot(df, binary, [y])
    one = F.col("value") == 1
    s = long.groupBy("column_name").agg(F.count_if(one).alias("n1"), F.sum(F.when(one, F.col(y)).otherwise(0)).alias("events1"),
                                        F.count_if(~one).alias("n0"), F.sum(F.when(~one, F.col(y)).otherwise(0)).alias("events0"))
    status = (F.when((F.col("n1") == 0) | (F.col("n0") == 0), "constant").when(F.least("events1", "events0") < min_events, "sparse").otherwise("ok"))
    sep = (F.col("events1") == 0) | (F.col("events0") == 0) | (F.col("events1") == F.col("n1")) | (F.col("events0") == F.col("n0"))
    return s.withColumn("status", status).withColumn("separation", sep)
