"""Whole jobs composed of the operators: cohort build, rebuild check, extension, blind scoring, temporal evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import hashing, scalars, stats
from asofkit.operators import capacity, compare, contracts, evaluate, resample, splits
from asofkit.operators.ordering import quantiles


def build_cohort(wide: DataFrame, *, dates: Sequence[str], index: str, eligible: str, y: str, guards: Sequence[str], features: Mapping[str, Column], secret: str,
                 entity: str, drop_violations: bool = True) -> tuple[DataFrame, DataFrame]:
    """Modelling rows and the count of rows lost at each step: other date, not eligible, no label, record on or after the index day."""
    on_date = F.col(index).isin(*[F.lit(d).cast("date") for d in dates])
    viol = F.lit(False)
    for g in guards:
        viol = viol | F.coalesce(F.col(g) >= F.col(index), F.lit(False))
    lost = (F.when(~on_date, "other date").when(~F.coalesce(F.col(eligible) == 1, F.lit(False)), "not eligible").when(F.col(y).isNull(), "no label")
            .when(viol, "record on or after index"))
    rows = wide.withColumn("_lost", lost)
    report = rows.groupBy(F.coalesce("_lost", F.lit("kept")).alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    if not drop_violations and not rows.where("_lost = 'record on or after index'").isEmpty():
        raise contracts.ContractError("records on or after the index day")
    out = rows.where("_lost IS NULL").select(hashing.secret_key(secret, entity, 20).alias("entity_key"), entity, index, F.col(y).alias("y"), *[c.alias(n) for n, c in features.items()])
    return out, report


def rebuild_matches(rebuilt: DataFrame, stored: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Proof that a rebuilt cohort equals the stored one: every count of the result but the shared rows must be 0."""
    return compare.differing_columns(rebuilt, stored, keys, cols)


def extend_cohort(reference: DataFrame, excluded: DataFrame, entity: str, *, salt: str, train: float, validation: float) -> DataFrame:
    """Reference rows plus formerly excluded rows, hash-partitioned; their test share is dropped and no entity enters twice."""
    new = excluded.join(reference.select(entity).distinct(), entity, "left_anti").withColumn("split", splits.hash_partition(entity, salt, train, validation))
    kept = new.where("split <> 'test'")
    return reference.withColumn("origin", F.lit("reference")).unionByName(kept.withColumn("origin", F.lit("extension")), allowMissingColumns=True)



def blind_score(features: DataFrame, *, intercept: float, coefs: Mapping[str, float], entity: str, salt: str, cutoffs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Scores of a new extract without its outcomes: hashed row key, risk, flag per frozen cut-off, seen-before flag."""
    p = stats.expit(scalars.linear_predictor(intercept, coefs))
    arr = cutoffs.agg(F.array_sort(F.collect_list(F.struct("capacity", "cutoff")))).scalar()
    out = compare.seen_before(features, earlier, entity).withColumn("p", p).withColumn("_c", arr)
    flagged = F.transform(F.filter("_c", lambda c: F.col("p") >= c["cutoff"]), lambda c: c["capacity"])
    return out.select(hashing.secret_key(salt, entity, 24).alias("row_key"), entity, "p", "seen_before", flagged.alias("flagged_at"))


def temporal_evaluation(scored: DataFrame, *, populations: Mapping[str, Column], min_rows: int) -> DataFrame:
    """Adverse and favourable metrics of risk intervals per population (populations below ``min_rows`` are dropped by declaration)."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in populations.items()]), lambda x: x.isNotNull())
    long = evaluate.adverse_favourable(scored.select("y", "lo", "hi", F.explode(names).alias("population")))
    keys = ["population", "mode"]
    m = evaluate.point_metrics(long, keys).join(evaluate.ranking_metrics(long, keys), keys)
    return m.where(F.col("n") >= min_rows).select(*keys, "n", "events", "auroc", "ap", "brier", "oe_ratio")


def development_change(current: DataFrame, development: DataFrame) -> DataFrame:
    """Intervals of two periods per (model, metric): a change counts only when they do not overlap."""
    a = current.select("model", "metric", F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi"))
    b = development.select("model", "metric", F.col("ci_low").alias("lo0"), F.col("ci_high").alias("hi0"))
    return a.join(b, ["model", "metric"]).withColumn("verdict", stats.intervals_differ(F.col("lo"), F.col("hi"), F.col("lo0"), F.col("hi0")))


def candidate_columns(raw: DataFrame, kinds: Mapping[str, tuple[str, tuple[float, ...]]], *, max_unreadable: float) -> DataFrame:
    """New columns checked against their declared kind (binary, ordinal with levels, count): cells that do not fit, and the class."""
    items = []
    for c, (kind, levels) in kinds.items():
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        num = scalars.to_number(text)
        fits = {"binary": num.isin(0.0, 1.0), "ordinal": num.isin(*[float(v) for v in levels]) if levels else num.isNotNull(), "count": (num >= 0) & (num == F.floor(num))}[kind]
        items.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), text.isNotNull().alias("present"), (text.isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("bad"), F.coalesce(num != 0, F.lit(False)).alias("informative")))
    t = raw.select(F.explode(F.array(*items)).alias("e")).select("e.*").groupBy("column_name", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("present").alias("present"), F.count_if("bad").alias("unreadable"), F.count_if(F.col("informative") & ~F.col("bad")).alias("informative"))
    share = F.col("unreadable") / F.col("rows")
    return t.withColumn("class", F.when(share > max_unreadable, "INELIGIBLE_SEMANTICS").when(F.col("informative") == 0, "INELIGIBLE_DATA").otherwise("ELIGIBLE"))


def leave_one_out(scored: DataFrame, full: str, ablated: Mapping[str, str], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """Metric of the full score minus each ablated score, with paired intervals, one block per removed item."""
    out = None
    for name, column in ablated.items():
        d = resample.paired_difference(scored, column, full, cluster, n_boot, seed).withColumn("removed", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def validation_tables(df: DataFrame, tie: str, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Point metrics and capacity rows in one long table (keys, item, value)."""
    keys = list(keys)
    m = evaluate.point_metrics(df, keys).join(evaluate.ranking_metrics(df, keys), keys)
    names = ("prevalence", "brier", "oe_ratio", "auroc", "ap")
    long = m.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])).alias("e")).select(*keys, "e.*")
    cap = capacity.capacity_table(df, tie, fractions, keys).select(*keys, F.concat(F.lit("sensitivity@"), F.col("capacity").cast("string")).alias("item"), F.col("sensitivity").alias("value"))
    return long.unionByName(cap)


def partial_effect(df: DataFrame, feature: str, effect: Column, points: int = 60) -> DataFrame:
    """Score change over a grid of one feature between its 1st and 99th percentile, relative to its median."""
    q = quantiles(df, feature, [0.01, 0.5, 0.99])
    grid = q.select("q1", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("q0") + (F.col("q2") - F.col("q0")) * i / (points - 1))).alias(feature))
    at = grid.withColumn("effect", effect)
    ref = q.select(F.col("q1").alias(feature)).withColumn("e", effect).select("e").scalar()
    return at.withColumn("_r", ref).select(feature, (F.col("effect") - F.col("_r")).alias("relative_effect"))
