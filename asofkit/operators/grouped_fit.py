"""Logistic calibration of any number of keys, the state of every fit in a table.

Equal scores of a key are put together first. Each Newton step is one join of these cells with
the open fits and one grouped aggregate; all keys, and both kinds of fit, share the steps, and a
fit that has ended leaves the table. The driver learns only whether a fit is still open. Cells of
a key with many of them are dealt to pieces, so no key has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.session import cut_lineage

PIECE_CELLS = 100_000  # cells of one piece, at least
TASK_CELLS = 2_000_000
PIECES = 1000  # a key is dealt to pieces from this share of all cells on, so there are PIECES such keys at most

STATE = ("_a", "_b", "_best", "_scale", "_da", "_db")


def fit_by_key(df: DataFrame, keys: Sequence[str] = (), *, lp: str = "lp", weight: str | None = None, offset_only: Sequence[bool] = (False,),
               max_iter: int = 50, tol: float = 1e-10, max_coef: float = 50.0) -> DataFrame:
    """Maximum-likelihood ``logit P(y) = a + b*lp`` per key and entry of ``offset_only`` (true: b is fixed at 1).

    Columns: keys, offset_only, intercept, slope, intercept_se, slope_se, fit_status. The status is ``converged``, or why the
    numbers are NULL: ``one_class`` (no events, no non-events or no rows), ``singular`` (the scores of the key do not vary),
    ``separated`` (a coefficient beyond ``max_coef``, or no information left on the way there) or ``not_converged`` (after ``max_iter`` steps). NULL is a key like any
    other; rows without outcome, score or weight take no part, but their key has a row.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    cells = cut_lineage(_cells(df, key, lp, weight))
    per_key = cells.groupBy("_k").agg(F.sum("_w").alias("_n"), F.sum("_e").alias("_e"), F.sum(F.col("_w") * F.col("_x")).alias("_sx"), F.count(F.lit(1)).alias("_m"))
    n_cells = cells.count()
    piece = max(PIECE_CELLS, -(-n_cells // PIECES))
    hot = F.broadcast(cut_lineage(per_key.where(F.col("_m") > piece).select("_k", F.ceil(F.col("_m") / piece).alias("_pieces"))))  # PIECES rows at most
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = cells.join(hot, "_k", "left").withColumn("_piece", F.pmod(F.xxhash64("_x"), pieces)).drop("_pieces")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_cells // TASK_CELLS + 1)
    dealt = dealt.repartition(tasks, "_k", "_piece").persist()
    dealt.count()  # a finished cache shows its partitioning to the steps, so they shuffle no cells
    gather, step = [*_sums(), *[F.first(c).alias(c) for c in STATE]], _step(tol, max_coef)
    spread_over = F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))
    try:
        state = cut_lineage(_start(per_key, offset_only))
        ended = [state.where("_status IS NOT NULL")]
        for _ in range(max_iter):
            state = state.where("_status IS NULL")
            if state.isEmpty():
                break
            spread = state.join(hot, "_k", "left").withColumn("_piece", spread_over)
            state = cut_lineage(step(dealt.join(spread, ["_k", "_piece"]).groupBy("_k", "_fit").agg(*gather)))
            ended.append(state.where("_status IS NOT NULL"))
        ended.append(state.where("_status IS NULL").withColumn("_status", F.lit("not_converged")))
    finally:
        dealt.unpersist()
    out = reduce(DataFrame.unionByName, ended)
    ok = F.col("_status") == "converged"
    numbers = {"intercept": F.col("_a"), "slope": F.col("_b"), "intercept_se": F.sqrt("_va"), "slope_se": F.sqrt("_vb")}
    return out.select(*[F.col("_k").getField(k).alias(k) for k in keys], F.col("_fit").alias("offset_only"),
                      *[F.when(ok, c).alias(n) for n, c in numbers.items()], F.col("_status").alias("fit_status"))


def _cells(df: DataFrame, key: Column, lp: str, weight: str | None) -> DataFrame:
    """(key, score) with weight and weighted events; a row that lacks a value has weight 0."""
    y, x, w = F.col("y").cast("double"), F.col(lp).cast("double"), (F.col(weight) if weight else F.lit(1)).cast("double")
    whole = y.isNotNull() & x.isNotNull() & w.isNotNull()
    used = df.select(key.alias("_k"), *[F.when(whole, c).otherwise(0.0).alias(n) for n, c in (("_x", x), ("_w", w), ("_y", y))])
    return used.groupBy("_k", "_x").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_y")).alias("_e"))


def _start(per_key: DataFrame, offset_only: Sequence[bool]) -> DataFrame:
    """Every fit at its key's event rate; keys of one class have ended."""
    n, e = F.col("_n"), F.col("_e")
    fits = per_key.withColumn("_fit", F.explode(F.array(*[F.lit(f) for f in offset_only])))
    none = F.lit(None).cast("double")
    two = (e > 0) & (e < n)
    a = F.when(two, F.log(e / F.when(two, n - e)) - F.when(F.col("_fit"), F.col("_sx") / n).otherwise(0.0))
    return fits.select("_k", "_fit", a.alias("_a"), F.col("_fit").cast("double").alias("_b"), F.lit(float("-inf")).alias("_best"), F.lit(1.0).alias("_scale"),
                       F.lit(0.0).alias("_da"), F.lit(0.0).alias("_db"), none.alias("_va"), none.alias("_vb"), F.when(~F.coalesce(two, F.lit(False)), "one_class").alias("_status"))


def _sums() -> list[Column]:
    """Gradient, information and log likelihood of a fit at its coefficients."""
    w, x, e = F.col("_w"), F.col("_x"), F.col("_e")
    eta = F.col("_a") + F.col("_b") * x
    mu = stats.expit(eta)
    v = w * mu * (1 - mu)
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    parts = {"g0": e - w * mu, "g1": (e - w * mu) * x, "h00": v, "h01": v * x, "h11": v * x * x, "ll": e * eta - w * softplus}
    return [F.sum(c).alias(n) for n, c in parts.items()]


def _step(tol: float, max_coef: float) -> Callable[[DataFrame], DataFrame]:
    """From the sums to the next state of every fit: a Newton step, half of the last one where that lowered the likelihood, or the end."""
    g0, g1, h00, h01, h11, ll = (F.col(c) for c in ("g0", "g1", "h00", "h01", "h11", "ll"))
    a, b, best, scale, da, db = (F.col(c) for c in STATE)
    fixed = F.col("_fit")
    det = F.when(fixed, h00).otherwise(h00 * h11 - h01 * h01)
    least = F.when(fixed, 0.0).otherwise(1e-12 * F.greatest(h00 * h11, F.lit(1e-300)))
    solved = {
        "_halve": (ll < best - 1e-9 * F.abs(best)) & (scale > 1e-8),
        "_singular": det <= least,
        "_na": F.when(fixed, F.try_divide(g0, h00)).otherwise(F.try_divide(h11 * g0 - h01 * g1, det)),
        "_nb": F.when(fixed, 0.0).otherwise(F.try_divide(h00 * g1 - h01 * g0, det)),
        "_va": F.when(fixed, F.try_divide(F.lit(1.0), h00)).otherwise(F.try_divide(h11, det)),
        "_vb": F.when(~fixed, F.try_divide(h00, det)),
    }
    na, nb, halve = F.col("_na"), F.col("_nb"), F.col("_halve")
    size = F.greatest(F.abs(na), F.abs(nb))
    first = best == float("-inf")
    status = (F.when(halve, None).when(F.col("_singular"), F.when(first, "singular").otherwise("separated"))
              .when(size < tol * (1 + F.greatest(F.abs(a), F.abs(b))), "converged").when(F.greatest(F.abs(a + na), F.abs(b + nb)) > max_coef, "separated"))
    ends = F.col("_status").isNotNull()
    out = ["_k", "_fit", F.when(ends, a).when(halve, a - scale * da / 2).otherwise(a + na).alias("_a"), F.when(ends, b).when(halve, b - scale * db / 2).otherwise(b + nb).alias("_b"),
           F.when(halve, best).otherwise(ll).alias("_best"), F.when(halve, scale / 2).otherwise(1.0).alias("_scale"),
           F.when(halve, da).otherwise(na).alias("_da"), F.when(halve, db).otherwise(nb).alias("_db"), "_va", "_vb", "_status"]
    return lambda sums: sums.withColumns(solved).withColumn("_status", status).select(*out)
