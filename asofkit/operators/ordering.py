"""Global order without a single-task window.

Ranking metrics need running sums over all rows in score order. A window without
partition keys would move every row to one task, so the order is cut into value
ranges first:

1. aggregate to one row per (keys, score), which also removes hot tied scores;
2. cut the scores into ranges at approximate quantiles of the distinct scores;
3. total each range; the running total over the (few) ranges gives each range's offset;
4. window inside (keys, range) and add the offset.

``rank_rows`` extends this to single rows: a block of equal scores is cut again
at quantiles of the tie-break key, so one score may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_count(df: DataFrame) -> int:
    """Value ranges to cut: as many as the session has shuffle partitions, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_bounds(df: DataFrame, col: str, n_ranges: int) -> Column:
    """Approximate quantiles of ``col`` over the rows, as a scalar subquery of one pruned column.

    The cuts only balance the work: any monotone cut gives the same result. A range holds about 1/n of the rows, so at most that many
    distinct values, whatever share of the rows a single value takes.
    """
    step = max(2, math.isqrt(n_ranges))
    probs = ", ".join(f"{i / n_ranges!r}D" for i in range(1, n_ranges))
    quantiles = df.selectExpr(f"coalesce(percentile_approx(cast(`{col}` AS double), array({probs}), {n_ranges * 10}), cast(array() AS array<double>)) AS q")
    return quantiles.selectExpr(f"struct(q AS all, filter(q, (x, i) -> (i + 1) % {step} = 0) AS steps, {step} AS step)").scalar()


def even_bounds(df: DataFrame) -> int:
    """Equal ranges of [0, 1) for a hashed order, by their number: no pass over the data and no list of bounds is needed."""
    return range_count(df)


def with_range(df: DataFrame, col: str, bounds: Column | int, name: str) -> DataFrame:
    """Add the 0-based index of the value range of ``col``: every ``step``-th bound first, then those in between.

    The index is never NULL and says so: a join on it would else test the whole search for NULL on every row below the aggregates.
    """
    value = F.col(col).cast("double")
    if isinstance(bounds, int):
        return df.withColumn(name, F.coalesce(F.floor(value * bounds).cast("int"), F.lit(0)))
    return (
        df.withColumn("_bounds", bounds)
        .withColumn("_first", F.size(F.filter("_bounds.steps", lambda b: b < value)) * F.col("_bounds.step"))
        .withColumn(name, F.coalesce(F.col("_first") + F.size(F.filter(F.slice("_bounds.all", F.col("_first") + 1, F.col("_bounds.step")), lambda b: b < value)), F.lit(0)))
        .drop("_bounds", "_first")
    )


def prefix_sums(df: DataFrame, order: str, sums: Mapping[str, Column], keys: Sequence[str] = (), *,
                descending: bool = True, bounds: Column | None = None) -> DataFrame:
    """One row per (keys, order) with own sums, inclusive running sums ``cum_*`` and key totals ``tot_*``.

    Keys and order must not be NULL. ``bounds`` may come from a smaller table with the same spread of values.
    """
    keys = list(keys)
    grouped = df.groupBy(*keys, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cut = with_range(grouped, order, value_bounds(df, order, range_count(df)) if bounds is None else bounds, "_range")
    return _running(cut, order, list(sums), keys, descending)


def _running(cut: DataFrame, order: str, names: list[str], keys: list[str], descending: bool) -> DataFrame:
    """Running sums of grouped rows that already carry ``_range``."""
    by = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    # At most range_count rows per key reach this window.
    before = Window.partitionBy(*keys).orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        cut.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_r_{n}") for n in names])
        .select(*keys, "_range",
                *[F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
                *[F.sum(f"_r_{n}").over(whole).alias(f"tot_{n}") for n in names])
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, "_range"])
        .select(*keys, order, *names,
                *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in names],
                *[f"tot_{n}" for n in names])
    )


def rank_rows(df: DataFrame, order: str, tie: str, sums: Mapping[str, Column] | None = None, keys: Sequence[str] = (), *,
              descending: bool = True) -> DataFrame:
    """Rows with their 1-based position ``rn`` by (order, tie) within keys, running sums ``cum_*`` and totals.

    ``tie`` is a numeric column that is unique among rows with equal keys and order.
    """
    keys = list(keys)
    sums = {"n": F.lit(1).cast("long"), **(sums or {})}
    names = list(sums)
    rows = with_range(df, tie, value_bounds(df, tie, range_count(df)), "_tie_range")
    for n, c in sums.items():
        rows = rows.withColumn(f"_v_{n}", c)
    blocks = rows.groupBy(*keys, order, "_tie_range").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    # At most range_count rows share a score here; the last one carries the score's own total.
    tied = Window.partitionBy(*keys, order)
    before = tied.orderBy("_tie_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(*keys, order, "_tie_range",
                           *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in names],
                           *[F.sum(n).over(tied).alias(n) for n in names])
    per_score = placed.groupBy(*keys, order).agg(*[F.first(n).alias(n) for n in names])
    scores = _running(with_range(per_score, order, value_bounds(df, order, range_count(df)), "_range"), order, names, keys, descending)
    offsets = (
        placed.drop(*names)
        .join(scores.select(*keys, order, *[(F.col(f"cum_{n}") - F.col(n)).alias(f"_s_{n}") for n in names],
                            *[f"tot_{n}" for n in names]), [*keys, order])
        .select(*keys, order, "_tie_range",
                *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(f"_o_{n}") for n in names], *[f"tot_{n}" for n in names])
    )
    inside = Window.partitionBy(*keys, order, "_tie_range").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(offsets, [*keys, order, "_tie_range"])
    return ranked.select(
        *df.columns,
        (F.col("_o_n") + F.sum("_v_n").over(inside)).alias("rn"),
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside)).alias(f"cum_{n}") for n in names if n != "n"],
        *[F.col(f"tot_{n}") for n in names],
    )


def rank_spread(df: DataFrame, order: str, tie: str, keys: Sequence[str] = (), *, bounds: Column | int | None = None) -> DataFrame:
    """Ascending positions ``rn`` and ``tot_n`` for an order column without hot values (a hash, a unique id).

    Cuts on the order column alone, so the rows are shuffled once. Use ``rank_rows`` for scores.
    """
    keys = list(keys)
    rows = with_range(df, order, value_bounds(df, order, range_count(df)) if bounds is None else bounds, "_range")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*keys)).alias("tot_n"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, tie))
    return rows.join(offsets, [*keys, "_range"]).select(*df.columns, (F.col("_o") + place).alias("rn"), "tot_n")


def midranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value (ascending), with its row count ``n``."""
    run = prefix_sums(df, value, {"n": F.lit(1).cast("long")}, keys, descending=False)
    return run.select(*keys, value, "n", "tot_n",
                      (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("midrank"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), *, weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles ``q0``, ``q1``, ... per key, from running counts of distinct values.

    Holds no value list in memory, so the number of distinct values may be anything.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    w = F.col(weight) if weight else F.lit(1).cast("long")
    runs = prefix_sums(rows.select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w")), "_v", {"n": F.col("_w")}, keys, descending=False)
    parts = []
    for i, p in enumerate(probs):
        h = (F.col("tot_n") - 1) * F.lit(float(p))
        parts += [F.min(F.when(F.col("cum_n") >= F.floor(h) + 1, F.col("_v"))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("cum_n") >= F.ceil(h) + 1, F.col("_v"))).alias(f"_hi{i}"),
                  F.max(h - F.floor(h)).alias(f"_f{i}")]
    out = runs.groupBy(*keys).agg(F.max("tot_n").alias("n_observed"), *parts)
    return out.select(*keys, "n_observed", *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(probs))])
