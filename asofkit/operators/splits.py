"""Leakage-safe splits and folds. Assignments are pure functions of keys, dates and a seed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import dates, hashing
from asofkit.operators.ordering import even_bounds, rank_spread

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class TemporalSplit:
    train_end: str
    validation_end: str
    window_days: int | None = 180
    window_years: int | None = None
    embargo: bool = True
    entities_disjoint: bool = True


def temporal_split(df: DataFrame, plan: TemporalSplit, *, entity: str = "entity_id", date: str = "index_date") -> DataFrame:
    """Rows with ``split`` and, for dropped rows, ``removed`` (embargo or entity_overlap).

    Embargo: an earlier row is dropped when its outcome window reaches the first date of the
    next split. Overlap: an entity of a later split loses its earlier rows, test before
    validation; both rules need only two flags per entity, so it is one aggregate and one join.
    """
    day = F.col(date)
    raw = F.when(day <= F.lit(plan.train_end).cast("date"), "train").when(day <= F.lit(plan.validation_end).cast("date"), "validation").otherwise("test")
    rows = df.withColumn("split", raw).withColumn("removed", F.lit(None).cast("string"))
    if plan.embargo:
        first = rows.agg(F.struct(F.min(F.when(F.col("split") == "validation", day)).alias("v"), F.min(F.when(F.col("split") == "test", day)).alias("t"))).scalar()
        end = dates.window_end(date, years=plan.window_years, days=plan.window_days)
        reach = F.when(F.col("split") == "train", end >= F.col("_first.v")).when(F.col("split") == "validation", end >= F.col("_first.t"))
        rows = rows.withColumn("_first", first).withColumn("removed", F.when(reach, "embargo")).drop("_first")
    if not plan.entities_disjoint:
        return rows
    kept = F.col("removed").isNull()
    flags = rows.groupBy(entity).agg(F.max(kept & (F.col("split") == "test")).alias("_test"), F.max(kept & (F.col("split") == "validation")).alias("_val"))
    clash = kept & (((F.col("split") != "test") & F.col("_test")) | ((F.col("split") == "train") & F.col("_val") & ~F.col("_test")))
    return rows.join(flags, entity).withColumn("removed", F.coalesce("removed", F.when(clash, "entity_overlap"))).drop("_test", "_val")


def split_summary(rows: DataFrame, *, entity: str = "entity_id", date: str = "index_date", y: str = "y") -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.sum(y).alias("events"),
                                     F.avg(y).alias("prevalence"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def entity_overlap(rows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities seen in more than one split; must be 0 for a disjoint split."""
    return rows.groupBy(entity).agg(F.count_distinct("split").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("shared"), F.count(F.lit(1)).alias("entities"))


def group_holdout(df: DataFrame, group: str, validation: Sequence, test: Sequence) -> DataFrame:
    """Listed groups go to validation or test, all others to train."""
    both = set(validation) & set(test)
    if both:
        raise ValueError(f"groups listed twice: {sorted(both)}")
    return df.withColumn("split", F.when(F.col(group).isin(*test), "test").when(F.col(group).isin(*validation), "validation").otherwise("train"))


def grouped_random_split(df: DataFrame, entity: str, validation: float, test: float, seed: int, *, y: str | None = "y") -> DataFrame:
    """Entities in hash order within outcome strata (entity maximum); the first parts are test and validation, sizes half up."""
    per = df.groupBy(entity).agg((F.max(y) if y else F.lit(0)).alias("_stratum")).withColumn("_u", hashing.hash_uniform(F.lit(str(seed)), F.col(entity)))
    ranked = rank_spread(per, "_u", entity, ["_stratum"], bounds=even_bounds(df))
    n_test = F.floor(F.col("tot_n") * test + 0.5)
    n_val = F.floor(F.col("tot_n") * validation + 0.5)
    split = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "validation").otherwise("train")
    return df.join(ranked.select(entity, split.alias("split")), entity)


def hash_partition(entity: Column | str, salt: str, train: float, validation: float) -> Column:
    """Split from a salted hash of the entity: no state, the same on every run."""
    u = hashing.hash_uniform(F.lit(salt), F.col(entity) if isinstance(entity, str) else entity)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def stratified_folds(df: DataFrame, key: str, k: int, seed: int, y: str = "y") -> DataFrame:
    """Fold = position mod k in hash order inside each class; ``key`` is a unique number per row."""
    rows = df.withColumn("_u", hashing.hash_uniform(F.lit(str(seed)), F.col(key)))
    ranked = rank_spread(rows, "_u", key, [y], bounds=even_bounds(df))
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k))).drop("_u", "rn", "tot_n")


def balanced_folds(df: DataFrame, entity: str, k: int, seed: int) -> DataFrame:
    """Entities to folds, largest first, each to the fold with the fewest rows so far (lowest fold on a tie).

    The greedy rule is sequential only between distinct group sizes. Inside one size s the m
    groups take the m smallest numbers of the k ladders load_f, load_f + s, load_f + 2s, ...
    So the driver walks the table of (size, count) and works out how many rungs each ladder
    gives; where the i-th group of a size goes follows from i by division.
    """
    spark = df.sparkSession
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("size")).withColumn("_u", hashing.hash_uniform(F.lit(str(seed)), F.col(entity)))
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("size").desc()).collect()
    load = [0] * k
    pieces = []
    for size, m in ((r["size"], r["m"]) for r in classes):
        pieces.append((size, _pieces(load, size)))
        load = [x + n * size for x, n in zip(load, _rungs(load, size, m), strict=True)]
    table = spark.createDataFrame(pieces, "size long, pieces array<struct<first:long,folds:array<int>>>")
    ranked = rank_spread(sizes, "_u", entity, ["size"], bounds=even_bounds(df)).select(entity, "size", "rn")
    own = F.element_at(F.filter("pieces", lambda p: p["first"] < F.col("rn")), -1)
    return ranked.join(table, "size").withColumn("_p", own).select(entity, "size", F.element_at("_p.folds", (F.pmod(F.col("rn") - 1 - F.col("_p.first"), F.size("_p.folds")) + 1).cast("int")).alias("fold"))


def _pieces(load: list[int], size: int) -> list[tuple[int, list[int]]]:
    """(groups before, folds in turn): how groups of one size go round the folds.

    Seen in steps of one size above the lowest load, fold f joins in with step q_f, and within
    a step the folds take turns by what their load leaves over, then by number. A new piece begins
    whenever further folds join, so there are at most as many as folds.
    """
    low = min(load)
    joins = sorted(((x - low) // size, (x - low) % size, f) for f, x in enumerate(load))
    out, first, before = [], 0, 0
    for q in sorted({j[0] for j in joins}):
        if out:
            first += (q - before) * len(out[-1][1])
        out.append((first, [f for _, f in sorted((left, f) for at, left, f in joins if at <= q)]))
        before = q
    return out


def _rungs(load: list[int], size: int, m: int) -> list[int]:
    """How many of the m smallest values of {load_f + i*size} lie on each ladder (ties to the lower fold)."""

    def below(v: int) -> list[int]:
        return [max(0, -(-(v - x) // size)) for x in load]

    lo, hi = min(load), max(load) + size * (m + 1)
    while lo < hi:  # the largest v with at most m values below it
        mid = (lo + hi + 1) // 2
        if sum(below(mid)) <= m:
            lo = mid
        else:
            hi = mid - 1
    taken = below(lo)
    left = m - sum(taken)
    for f, x in enumerate(load):
        if left and lo >= x and (lo - x) % size == 0:
            taken[f] += 1
            left -= 1
    return taken


def fold_complete(oof: DataFrame, key: str) -> DataFrame:
    """Out-of-fold check: every row predicted exactly once."""
    per = oof.groupBy(key).agg(F.count("p").alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_n") == 1).alias("once"), F.count_if(F.col("_n") != 1).alias("wrong"))


def test_rows_number(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free identity of the test rows: count and exact sum of key hashes."""
    return rows.where("split = 'test'").agg(F.count(F.lit(1)).alias("rows"), hashing.content_number(*keys).cast("string").alias("content"))


class HeldBackRows:
    """Hands the test rows out once, with a reason; a second request is refused."""

    def __init__(self, rows: DataFrame):
        self._rows: DataFrame | None = rows
        self.reason: str | None = None

    def release(self, reason: str) -> DataFrame:
        if not reason.strip():
            raise ValueError("a release needs a reason")
        if self._rows is None:
            raise RuntimeError(f"test rows were already released ({self.reason})")
        rows, self._rows, self.reason = self._rows, None, reason
        return rows


def forbidden_rows(fit_rows: DataFrame, held_back: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fitting rows whose key is held back; must be empty."""
    return fit_rows.join(held_back.select(*keys).distinct(), list(keys), "left_semi")


def nested_fraction(df: DataFrame, entity: str, fraction: float, seed: int, y: str = "y") -> DataFrame:
    """Nested stratified subset for learning curves: the first ``fraction`` of entities in hash order per stratum."""
    per = df.groupBy(entity).agg(F.max(y).alias("_stratum")).withColumn("_u", hashing.hash_uniform(F.lit(str(seed)), F.col(entity)))
    ranked = rank_spread(per, "_u", entity, ["_stratum"], bounds=even_bounds(df))
    return df.join(ranked.where(F.col("rn") <= F.ceil(F.col("tot_n") * fraction)).select(entity), entity, "left_semi")
