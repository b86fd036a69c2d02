"""Catalogue tables: one row per column, feature or source. They describe the data and stay as small as its schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.pit import first_match
from asofkit.session import cut_lineage

STATUS_ORDER = ("SAFE", "UNRESOLVED", "UNSAFE")


def worst_status(c: Column) -> Column:
    """Worst status as an aggregate."""
    order = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return F.element_at(order, F.max(F.array_position(order, c)).cast("int"))


def worst_of(*statuses: Column) -> Column:
    """Worst of several statuses of one row."""
    order = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return F.element_at(order, F.greatest(*[F.array_position(order, s) for s in statuses]).cast("int"))


def schema_diff(old: DataFrame, declared: DataFrame, header: DataFrame, *, sealed_pattern: str) -> DataFrame:
    """Class of every column over the old contract (column_name, role), the declared new schema
    (column_name, equivalence, new_role, replaces, lineage_proven) and the extract header (column_name).

    UNCHANGED, CHANGED_DEFINITION, NEW_CANDIDATE, RENAMED (proven predecessor that is gone), FORBIDDEN (sealed name),
    REVIEW (unknown meaning), REMOVED (in the old contract, not in the extract), DECLARED_ONLY.
    """
    o = old.select("column_name", F.lit(True).alias("in_old"), F.col("role").alias("old_role"))
    d = declared.withColumn("in_declared", F.lit(True))
    h = header.select("column_name", F.lit(True).alias("in_extract"))
    gone = old.select(F.col("column_name").alias("replaces")).join(header.select(F.col("column_name").alias("replaces")), "replaces", "left_anti").withColumn("_gone", F.lit(True))
    t = o.join(d, "column_name", "full").join(h, "column_name", "full").join(gone, "replaces", "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_old", "in_declared", "in_extract")}
    tests = [
        ~flags["in_extract"] & flags["in_old"],
        ~flags["in_extract"],
        flags["in_old"] & F.coalesce(F.col("equivalence") == "CHANGED", F.lit(False)),
        flags["in_old"] & F.col("equivalence").isNull(),
        flags["in_old"],
        flags["in_declared"] & F.coalesce(F.col("lineage_proven") & F.col("_gone"), F.lit(False)),
        flags["in_declared"] & (F.col("new_role") == "PREDICTOR"),
        flags["in_declared"],
        F.col("column_name").rlike(sealed_pattern),
    ]
    klass = F.coalesce(first_match(tests, ["REMOVED", "DECLARED_ONLY", "CHANGED_DEFINITION", "REVIEW", "UNCHANGED", "RENAMED", "NEW_CANDIDATE", "NEW_OTHER", "FORBIDDEN"]), F.lit("REVIEW"))
    return t.select("column_name", *[c.alias(n) for n, c in flags.items()], klass.alias("column_class"))


def seal_map(catalog: DataFrame, *, listed: Sequence[str], roles: Sequence[str], timings: Sequence[str], pattern: str) -> DataFrame:
    """Columns that may never be read as predictors, with the first reason."""
    tests = [F.col("column_name").isin(*listed) if listed else F.lit(False), F.col("role").isin(*roles), F.col("timing").isin(*timings), F.lower("column_name").rlike(pattern)]
    return catalog.select("column_name", first_match(tests, ["listed", "role", "timing", "name"]).alias("reason")).where("reason IS NOT NULL")


def enrich(catalog: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left joins of further catalogue tables on ``column_name``."""
    return reduce(lambda acc, p: acc.join(p, "column_name", "left"), parts, catalog)


def usage(features: DataFrame) -> DataFrame:
    """Columns used by features (feature, inputs array): one row per column with its features."""
    return (features.select("feature", F.explode("inputs").alias("column_name")).groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n_features"), F.array_join(F.array_sort(F.collect_set("feature")), "; ").alias("features")))


def needed_columns(features: DataFrame, header: DataFrame, sealed: DataFrame) -> DataFrame:
    """Inputs of the features with availability: available, absent, or sealed."""
    need = features.select(F.explode("inputs").alias("column_name")).distinct()
    t = need.join(header.select("column_name", F.lit(True).alias("_h")), "column_name", "left").join(sealed.select("column_name", F.lit(True).alias("_s")), "column_name", "left")
    return t.select("column_name", F.when(F.col("_s"), "sealed").when(F.col("_h"), "available").otherwise("absent").alias("availability"))


def coverage(spec: DataFrame, available: DataFrame) -> DataFrame:
    """Available, unavailable and mandatory missing features, with the percentage."""
    t = spec.join(available.select("feature", F.lit(True).alias("_a")), "feature", "left").withColumn("_a", F.coalesce("_a", F.lit(False)))
    return t.agg(F.count(F.lit(1)).alias("features"), F.count_if("_a").alias("available"), F.count_if(~F.col("_a")).alias("unavailable"),
                 F.count_if(~F.col("_a") & F.col("mandatory")).alias("mandatory_missing"), (100.0 * F.count_if("_a") / F.count(F.lit(1))).alias("pct"))


def evidence_join(base: DataFrame, *parts: DataFrame, key: Sequence[str] = ("feature",)) -> DataFrame:
    """Evidence tables joined by feature; a feature of any table is kept."""
    return reduce(lambda acc, p: acc.join(p, list(key), "full"), parts, base)


def consensus_rating(evidence: DataFrame) -> DataFrame:
    """Rating from the evidence flags: linear, univariate, importance, ablation (booleans; NULL = no evidence)."""
    votes = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("univariate", "importance")), F.coalesce(F.col("linear").cast("int"), F.lit(0)))
    ablation = F.coalesce(F.col("ablation"), F.lit(False))
    rating = F.when(ablation & (votes >= 2), "STRONG").when(ablation | (votes >= 2), "MODERATE").when(votes >= 1, "WEAK").otherwise("NONE")
    return evidence.withColumn("votes", votes).withColumn("rating", rating)


def little_or_no_value(evidence: DataFrame) -> DataFrame:
    """True when importance is within one SD of zero in every model and the feature is never selected; NULL without any evidence."""
    agg = evidence.groupBy("feature").agg(F.count("mean_drop").alias("_n"), F.every(F.coalesce(F.col("mean_drop") <= F.col("sd_drop"), F.lit(True))).alias("_flat"),
                                          F.some(F.coalesce(F.col("selected"), F.lit(False))).alias("_sel"), F.count("selected").alias("_m"))
    return agg.select("feature", F.when((F.col("_n") == 0) & (F.col("_m") == 0), None).otherwise(F.col("_flat") & ~F.col("_sel")).alias("little_or_no_value"))


def driver_table(perm: DataFrame, stability: DataFrame, top: int) -> DataFrame:
    """Importance ranked inside each family, joined with stability; the top features per family."""
    ranked = perm.withColumn("rank", F.rank().over(Window.partitionBy("family").orderBy(F.col("drop").desc())))
    return ranked.where(F.col("rank") <= top).join(stability, ["family", "feature"], "left")


def relative_coefficients(coefs: DataFrame) -> DataFrame:
    """Subtract the reference level's coefficient inside each factor (term, factor, is_reference, coefficient)."""
    ref = F.max(F.when(F.col("is_reference"), F.col("coefficient"))).over(Window.partitionBy("factor"))
    return coefs.withColumn("relative", F.col("coefficient") - F.coalesce(ref, F.lit(0.0)))


def reachable(edges: DataFrame) -> DataFrame:
    """Distinct (column_name, ancestor) pairs over paths of any length.

    Path lengths double from round to round until no pair is new, so a chain of n steps
    takes log2(n) rounds; cycles and layered graphs add each pair once.
    """
    pairs = cut_lineage(edges.select("column_name", F.col("parent").alias("ancestor")).distinct())
    known = pairs.count()
    while True:
        onward = pairs.select(F.col("column_name").alias("ancestor"), F.col("ancestor").alias("_far"))
        pairs = cut_lineage(pairs.union(pairs.join(onward, "ancestor").select("column_name", "_far")).distinct())
        now = pairs.count()
        if now == known:
            return pairs
        known = now


def dependency_closure(statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """Worst status over a column and everything it is derived from, transitively.

    ``statuses``: (column_name, status); ``edges``: (column_name, parent). A column on a cycle is
    UNRESOLVED, and so is whatever derives from it, at any distance. ``n_inherited`` counts the
    distinct columns it derives from, itself not included, and one more if it lies on a cycle.
    """
    pairs = reachable(edges)
    looped = pairs.where("column_name = ancestor").select("column_name", F.lit("UNRESOLVED").alias("status"))
    inherited = (pairs.where("column_name <> ancestor").join(statuses.withColumnRenamed("column_name", "ancestor"), "ancestor", "left")
                 .join(looped.select(F.col("column_name").alias("ancestor"), F.lit("UNRESOLVED").alias("_loop")), "ancestor", "left")
                 .select("column_name", worst_of(F.coalesce("status", F.lit("UNRESOLVED")), F.coalesce("_loop", F.lit("SAFE"))).alias("status")))
    every = statuses.unionByName(inherited).unionByName(looped)
    return (statuses.withColumnRenamed("status", "own_status")
            .join(every.groupBy("column_name").agg(worst_status(F.col("status")).alias("status"), (F.count(F.lit(1)) - 1).alias("n_inherited")), "column_name"))


def column_status(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Own status of each column: contract role and timing first, then the on / after counts of its source's record date."""
    t = catalog.join(counts, "record_date", "left")
    hits = F.coalesce(F.col("n_on"), F.lit(0)) + F.coalesce(F.col("n_after"), F.lit(0))
    tests = [F.col("role") == "FORBIDDEN", F.col("timing") == "post_index", F.col("timing") == "unknown", F.col("record_date").isNull(), F.col("n_on").isNull(), hits > 0]
    labels = ["UNSAFE", "UNSAFE", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED", "UNSAFE"]
    return t.withColumn("status", F.coalesce(first_match(tests, labels), F.lit("SAFE")))


def feature_sets(features: DataFrame, status: DataFrame) -> DataFrame:
    """A feature is as safe as its worst input; set SAFE holds the safe ones, ALL every feature that is not UNSAFE."""
    t = features.select("feature", F.explode("inputs").alias("column_name")).join(status.select("column_name", "status"), "column_name", "left")
    s = t.groupBy("feature").agg(worst_status(F.coalesce("status", F.lit("UNRESOLVED"))).alias("status"))
    return s.withColumn("sets", F.when(F.col("status") == "SAFE", "ALL; SAFE").when(F.col("status") == "UNRESOLVED", "ALL").otherwise(""))


def set_membership(registry: DataFrame, sets: Mapping[str, str]) -> DataFrame:
    """Named feature sets as SQL conditions over the registry; sets with equal members share the alias of the first name."""
    names = F.filter(F.array(*[F.when(F.expr(cond), F.lit(n)) for n, cond in sets.items()]), lambda x: x.isNotNull())
    members = (registry.select("feature", F.explode(names).alias("set_name")).groupBy("set_name")
               .agg(F.array_sort(F.collect_set("feature")).alias("members")))
    alias = F.min("set_name").over(Window.partitionBy("members"))
    return members.select("set_name", F.size("members").alias("n_features"), F.array_join("members", "; ").alias("members"), alias.alias("alias_of"))


def set_violations(members: DataFrame, registry: DataFrame) -> DataFrame:
    """Members of a set that are not eligible in the registry; must be empty."""
    long = members.select("set_name", F.explode(F.split("members", "; ")).alias("feature"))
    return long.join(registry.where("eligible").select("feature"), "feature", "left_anti")


def registry_funnel(registry: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Ordered counts of registry rows that pass each condition and all before it."""
    cond, items = F.lit(True), []
    for i, (name, test) in enumerate(steps):
        cond = cond & F.coalesce(F.expr(test), F.lit(False))
        items.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count_if(cond).alias("n")))
    return registry.agg(F.array(*items).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def column_registry(profile: DataFrame, used: DataFrame, *, min_observed: int) -> DataFrame:
    """One disposition per raw column: used, sealed role, empty, constant, too sparse, or candidate."""
    t = profile.join(used, "column_name", "left")
    tests = [F.col("features").isNotNull(), F.col("role").isin("LABEL", "IDENTIFIER", "FORBIDDEN"), F.col("status") == "EMPTY", F.col("status") == "CONSTANT", F.col("observed") < min_observed]
    return t.withColumn("disposition", F.coalesce(first_match(tests, ["USED", "NOT_A_PREDICTOR", "EMPTY", "CONSTANT", "TOO_SPARSE"]), F.lit("CANDIDATE")))
