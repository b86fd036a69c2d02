"""Design columns whose constants are learned on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.ordering import quantiles, range_count, value_bounds, with_range
from asofkit.operators.profile import unpivot


def standardise(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Mean 0 and SD 1 with divisor N; a column without variance becomes 0. One aggregate, inlined as a scalar."""
    base = df if train is None else train
    m = base.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()
    out = df.withColumn("_m", m)
    return out.select(*df.columns, *[F.when(F.col(f"_m.s_{c}") > 0, (F.col(c) - F.col(f"_m.m_{c}")) / F.col(f"_m.s_{c}")).otherwise(0.0).alias(f"{c}__z") for c in cols])


def train_medians(train: DataFrame, cols: Sequence[str]) -> Column:
    """Map of exact medians of the training rows, as a scalar."""
    q = quantiles(unpivot(train, cols), "value", [0.5], ["column_name"])
    return q.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "q0")))).scalar()


def median_impute(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs filled with training medians, and a 0/1 missing column per feature."""
    out = df.withColumn("_med", train_medians(train, cols))
    flags = {f"{c}__missing": F.col(c).isNull().cast("int") for c in cols}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.element_at("_med", c)) for c in cols}
    return out.withColumns(flags).withColumns(filled).drop("_med")


def power_scaling(df: DataFrame, col: str) -> DataFrame:
    """Shift and scale of a fractional polynomial: shift = -min + smallest gap when min <= 0; scale = power of ten of the range.

    Gaps are taken between neighbours in value order: inside each value range, and across ranges from
    one range's minimum to the largest value below it.
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x")).distinct()
    cut = with_range(x, "_x", value_bounds(df.select(F.col(col).cast("double").alias("_x")), "_x", range_count(df)), "_range")
    inner = cut.withColumn("_g", F.col("_x") - F.lag("_x").over(Window.partitionBy("_range").orderBy("_x")))
    per = inner.groupBy("_range").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.min("_g").alias("g"))
    # One row per range from here on.
    step = per.withColumn("_b", F.col("lo") - F.lag("hi").over(Window.orderBy("_range")))
    s = step.agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.least(F.min("g"), F.min("_b")).alias("gap"))
    span = F.log10(F.col("high") - F.col("low"))
    return s.select(F.when(F.col("low") <= 0, -F.col("low") + F.col("gap")).otherwise(0.0).alias("shift"),
                    F.pow(F.lit(10.0), F.signum(span) * F.floor(F.abs(span))).alias("scale"), "low", "high", "gap")






def absent_terms(df: DataFrame, coefs: Mapping[str, float], unavailable: Sequence[str]) -> DataFrame:
    """Intercept shift sum(beta * mean) of terms that cannot be computed, and the share of score variance still available."""
    items = [F.struct(F.lit(float(b)).alias("beta"), F.lit(n in set(unavailable)).alias("gone"), F.avg(F.col(n).cast("double")).alias("m"), F.var_pop(F.col(n).cast("double")).alias("v")) for n, b in coefs.items()]
    t = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("e")).select("e.*")
    part = F.col("beta") * F.col("beta") * F.col("v")
    total = F.sum(part)
    return t.agg(F.sum(F.when(F.col("gone"), F.col("beta") * F.col("m")).otherwise(0.0)).alias("intercept_shift"),
                 F.when(total > 0, F.sum(F.when(~F.col("gone"), part).otherwise(0.0)) / total).alias("variance_share"), F.count_if("gone").alias("terms_absent"))
