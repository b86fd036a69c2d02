"""Top-k selection at a fixed capacity: overall, inside folds, and for weighted (resampled) copies.

Counts at a capacity do not need every row's rank. Running counts per distinct score
locate the boundary score; only the rows tied at it are ordered by the tie-break key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators.evaluate import with_rates
from asofkit.operators.ordering import prefix_sums, range_count, rank_rows, value_bounds


def n_selected(permille: Column, n: Column) -> Column:
    """permille / 1000 x n rounded half up in exact integers."""
    return F.floor((2 * permille.cast("long") * n.cast("long") + 1000) / 2000)


def top_count(frac: float, n: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(frac) * n))


def top_mask(df: DataFrame, tie: str, frac: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``flagged``: the ceil(frac * n) highest risks, ties by the key."""
    ranked = rank_rows(df, "p", tie, keys=keys)
    return ranked.withColumn("flagged", F.col("rn") <= top_count(frac, F.col("tot_n"))).drop("rn", "tot_n")


def top_k_events(df: DataFrame, cuts: DataFrame, keys: Sequence[str], tie: str, *, weight: str | None = None,
                 source: DataFrame | None = None) -> DataFrame:
    """Events among the ``k`` highest-risk copies for each row of ``cuts`` (keys, cut, k).

    Result: keys, cut, k, tp, selected, boundary (the score of the last selected copy) and
    ``tie_split`` (some copies of that score are selected and some are not). ``source`` is a
    smaller table with the same spread of scores and tie keys, e.g. the rows before resampling.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    source = df if source is None else source
    base = df.select(*keys, "p", tie, w.alias("_w"), (w * F.col("y")).alias("_wy"))
    runs = prefix_sums(base, "p", {"w": F.col("_w"), "wy": F.col("_wy")}, keys, bounds=value_bounds(source, "p", range_count(source)))
    # Exactly one score per cut holds the k-th copy; a k beyond the total takes the last score.
    before = F.col("cum_w") - F.col("w")
    at = (before < F.col("k")) & ((F.col("k") <= F.col("cum_w")) | (F.col("cum_w") == F.col("tot_w")))
    whole = F.col("cum_w") <= F.col("k")
    if keys:
        with_cuts = runs.join(cuts, keys)
    else:  # the few cuts as one array, so that nothing is joined without a key
        arr = cuts.agg(F.collect_list(F.struct("cut", "k"))).scalar()
        with_cuts = runs.withColumn("_cuts", arr).select("*", F.explode("_cuts").alias("_c")).select(*runs.columns, "_c.cut", "_c.k")
    per_cut = with_cuts.where(at).select(
        *keys, "cut", "k", F.when(whole, F.col("cum_wy")).otherwise(F.col("cum_wy") - F.col("wy")).alias("_full_tp"),
        F.when(whole, F.col("cum_w")).otherwise(before).alias("_full_n"), F.col("p").alias("boundary"), (~whole).alias("tie_split"))
    split = per_cut.where("tie_split").select(*keys, "cut", F.col("boundary").alias("p"), (F.col("k") - F.col("_full_n")).alias("_left"))
    block = base.join(split, [*keys, "p"])
    order = prefix_sums(block, tie, {"w": F.col("_w"), "wy": F.col("_wy"), "left": F.col("_left")}, [*keys, "cut"], descending=False,
                        bounds=value_bounds(source, tie, range_count(source)))
    # tie is unique inside a block, so each group of the running sum is one row and "left" is that row's own value.
    part = F.least(F.greatest(F.col("left") - (F.col("cum_w") - F.col("w")), F.lit(0)), F.col("w"))
    extra = order.groupBy(*keys, "cut").agg(F.sum(part * F.when(F.col("w") > 0, F.col("wy") / F.col("w")).otherwise(0)).alias("_part_tp"),
                                            F.sum(part).alias("_part_n"))
    return (per_cut.join(extra, [*keys, "cut"], "left")
            .select(*keys, "cut", "k", (F.col("_full_tp") + F.coalesce("_part_tp", F.lit(0))).alias("tp"),
                    (F.col("_full_n") + F.coalesce("_part_n", F.lit(0))).alias("selected"), "boundary", "tie_split"))


def _totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


def _with_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(totals, list(keys))
    one = totals.select(F.struct("n", "events")).scalar()
    return df.withColumn("_t", one).select(*df.columns, "_t.n", "_t.events")


def fraction_cuts(totals: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("cut"), top_count(q, F.col("n")).alias("k")) for q in fractions]))
    return totals.select(*keys, "n", "events", each.alias("_c")).select(*keys, "_c.cut", "_c.k")


def capacity_table(df: DataFrame, tie: str, fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates with the ceil(q * n) highest risks flagged, for each q."""
    keys = list(keys)
    totals = _totals(df, keys)
    hits = _with_totals(top_k_events(df, fraction_cuts(totals, keys, fractions), keys, tie), totals, keys)
    counts = hits.select(*keys, F.col("cut").alias("capacity"), "boundary", "tie_split", F.col("tp").cast("long").alias("tp"), (F.col("k") - F.col("tp")).cast("long").alias("fp"),
                         (F.col("events") - F.col("tp")).cast("long").alias("fn"),
                         (F.col("n") - F.col("events") - (F.col("k") - F.col("tp"))).cast("long").alias("tn"))
    return with_rates(counts)


def frozen_cutoffs(df: DataFrame, fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Value of the ceil(q * n)-th largest risk for each q; needs only the running counts."""
    runs = prefix_sums(df, "p", {"w": F.lit(1).cast("long")}, keys)
    row = runs.groupBy(*keys).agg(*[F.max(F.when(F.col("cum_w") >= top_count(q, F.col("tot_w")), F.col("p"))).alias(f"_q{i}") for i, q in enumerate(fractions)])
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("capacity"), F.col(f"_q{i}").alias("cutoff")) for i, q in enumerate(fractions)]))
    return row.select(*keys, each.alias("_e")).select(*keys, "_e.capacity", "_e.cutoff")


def apply_cutoffs(df: DataFrame, cutoffs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with absolute cut-offs (p >= cutoff, ties together), per group."""
    arr = cutoffs.agg(F.collect_list(F.struct("capacity", "cutoff"))).scalar()
    cells = df.groupBy(*groups, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("_c", arr)
    long = cells.select(*groups, "p", "pos", "neg", F.explode("_c").alias("_c")).select(*groups, "_c.capacity", "_c.cutoff", "p", "pos", "neg")
    hit = F.col("p") >= F.col("cutoff")
    return with_rates(long.groupBy(*groups, "capacity", "cutoff").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn")))


def gains_curve(df: DataFrame, tie: str, points: int = 100) -> DataFrame:
    """Share of events among the first i/points of the rows in risk order, i = 1..points."""
    totals = _totals(df, [])
    cuts = (totals.select("n", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("cut"))
            .select("cut", F.greatest(F.lit(1), F.floor(F.col("cut") * F.col("n") / points)).alias("k")))
    return (_with_totals(top_k_events(df, cuts, [], tie), totals, [])
            .select(F.col("cut").alias("point"), F.col("k"), stats.ratio(F.col("tp"), F.col("events")).alias("event_share")))


# ------------------------------------------------------------------ folds
def allocate(sizes: DataFrame, total: Column, keys: Sequence[str], fold: str = "fold", size: str = "size") -> DataFrame:
    """Largest-remainder split of ``total`` over the folds of each key; ties go to the lower fold. Adds ``k``."""
    whole = Window.partitionBy(*keys)
    grand = F.sum(size).over(whole)
    t = (sizes.withColumn("_total", total).withColumn("_grand", grand)
         .withColumn("_base", F.floor(F.col("_total") * F.col(size) / F.col("_grand")))
         .withColumn("_rem", (F.col("_total") * F.col(size)) % F.col("_grand")))
    t = t.withColumn("_left", F.col("_total") - F.sum("_base").over(whole))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_rem").desc(), fold))
    k = F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    return (t.withColumn("_place", place).withColumn("k", F.least(k, F.col(size)).cast("long"))
            .drop("_total", "_grand", "_base", "_rem", "_left", "_place"))


def fold_cuts(df: DataFrame, models: Sequence[str], permilles: Sequence[int], fold: str = "fold") -> DataFrame:
    """Per (model, fold, permille): fold size, events and the allocated number to select."""
    sizes = df.groupBy(*models, fold).agg(F.count(F.lit(1)).alias("size"), F.sum("y").alias("fold_events"))
    n = F.sum("size").over(Window.partitionBy(*models))
    grid = (sizes.withColumn("population", n)
            .withColumn("cut", F.explode(F.array(*[F.lit(int(v)) for v in permilles]))))
    return allocate(grid, n_selected(F.col("cut"), F.col("population")), [*models, "cut"], fold)


def fold_rows(df: DataFrame, models: Sequence[str], permilles: Sequence[int], tie: str, fold: str = "fold") -> DataFrame:
    """Per fold: selected, tp, fp, fn, tn with the fold's own top k."""
    keys = [*models, fold]
    cuts = fold_cuts(df, models, permilles, fold)
    hits = top_k_events(df, cuts.select(*keys, "cut", "k"), keys, tie)
    return (cuts.join(hits.select(*keys, "cut", "tp", "tie_split"), [*keys, "cut"], "left")
            .select(*keys, F.col("cut").alias("permille"), "population", F.col("size").alias("fold_size"), F.col("k").alias("selected"),
                    F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                    (F.col("k") - F.coalesce("tp", F.lit(0))).cast("long").alias("fp"), "fold_events", F.coalesce("tie_split", F.lit(False)).alias("tie_split"))
            .withColumn("fn", F.col("fold_events") - F.col("tp")).withColumn("tn", F.col("fold_size") - F.col("fold_events") - F.col("fp")))


def fold_capacity(df: DataFrame, models: Sequence[str], permilles: Sequence[int], tie: str, fold: str = "fold") -> DataFrame:
    """Counts summed over folds at each capacity, with rates, cell safety and whether a boundary split a tie."""
    rows = fold_rows(df, models, permilles, tie, fold)
    sums = rows.groupBy(*models, "permille", "population").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.max("tie_split").alias("tie_split"))
    return with_rates(sums).withColumn("cells_safe", cells_safe(10))


def cells_safe(min_cell: int) -> Column:
    ok = F.lit(True)
    for c in ("tp", "fp", "fn", "tn"):
        ok = ok & ~((F.col(c) > 0) & (F.col(c) < min_cell))
    return ok


def safe_points(curve: DataFrame) -> DataFrame:
    """Capacity points whose cells are safe for EVERY model."""
    return curve.groupBy("permille").agg(F.every("cells_safe").alias("safe"))


def grid_step(n: Column, min_cell: int = 10) -> Column:
    """Smallest per-mille step of 1, 2, 5, 10 that moves at least ``min_cell`` rows."""
    step = F.lit(10)
    for s in (5, 2, 1):
        step = F.when(s * n / 1000 >= min_cell, s).otherwise(step)
    return step


def smallest_capacity(curve: DataFrame, models: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """First grid point whose sensitivity reaches each target, per model."""
    row = curve.groupBy(*models).agg(*[F.min(F.when(F.col("sensitivity") >= t, F.struct("permille", "tp", "fp"))).alias(f"_t{i}") for i, t in enumerate(targets)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("at")) for i, t in enumerate(targets)]))
    return row.select(*models, each.alias("_e")).select(*models, "_e.target", "_e.at.permille", "_e.at.tp", "_e.at.fp")


def capacity_headline(curve: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """Extra captures and fewer false alerts of ``b`` over ``a`` at each capacity."""
    one = curve.groupBy("permille", "population").agg(
        *[F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{s}") for m, s in ((a, "a"), (b, "b")) for c in ("tp", "fp")])
    return one.select("permille", "tp_a", "tp_b", "fp_a", "fp_b", (F.col("tp_b") - F.col("tp_a")).alias("extra_captures"),
                      (F.col("fp_a") - F.col("fp_b")).alias("fewer_false_alerts"),
                      stats.ratio(1e4 * (F.col("tp_b") - F.col("tp_a")), F.col("population")).alias("extra_captures_per_10000"))
