"""Penalised logistic paths: all folds, mixings and penalties at once, a few passes over the rows.

Every pass evaluates all models: each task adds up, per fold and penalty, the gradient, the
curvature and the deviance of its rows; the sums (models x features^2 numbers, whatever the rows)
come to the driver, which solves each model's penalised quadratic and sends new coefficients.
Rows stay where they are. Features are standardised with each training fold's own means and
standard deviations, which follow from the totals by subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.contracts import ContractError

ZERO_SPREAD = 1e-12
BARRED = 1e300  # penalty of a feature outside a model's set
CHUNK = 1 << 16  # rows x models that a task works on at once


@dataclass(frozen=True)
class Path:
    """Fitted models by (fold, mixing, penalty); the last fold index stands for all rows.

    ``beta``: coefficients of standardised features; ``intercept``; ``mean`` and ``sd`` by fold;
    ``deviance``: held-out mean deviance by (fold, mixing, penalty); ``held_out``: rows by fold.
    """

    features: tuple[str, ...]
    l1_ratios: np.ndarray
    lambdas: np.ndarray  # mixing, penalty
    beta: np.ndarray
    intercept: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    deviance: np.ndarray
    held_out: np.ndarray
    converged: np.ndarray
    passes: int

    def _all_converged(self) -> None:
        """Held-out deviances are not given out while a fold's fit has not converged."""
        if not self.converged[:-1].all():
            raise ContractError("the fit of a fold did not converge; raise max_passes")

    def cv_table(self, spark) -> DataFrame:
        """(l1_ratio, lambda, fold, n, deviance) of every held-out fold."""
        self._all_converged()
        rows = [(float(a), float(self.lambdas[i, j]), f, int(self.held_out[f]), float(self.deviance[f, i, j])) for i, a in enumerate(self.l1_ratios) for j in range(self.lambdas.shape[1]) for f in range(len(self.held_out))]
        return spark.createDataFrame(rows, "l1_ratio double, lambda double, fold int, n long, deviance double")

    def chosen(self, tolerance: float = 1e-3, confirm: int = 5) -> tuple[int, int, bool]:
        """(mixing, penalty) of the lowest mean deviance, the largest penalty on ties, and whether the minimum is identified.

        It is identified when at least ``confirm`` smaller penalties are worse by the relative ``tolerance``.
        """
        self._all_converged()
        mean = self.deviance.mean(axis=0)
        i = int(np.argmin(mean.min(axis=1)))
        j = int(np.argmin(mean[i]))
        worse = (mean[i, j + 1 :] - mean[i, j]) >= tolerance * mean[i, j]
        return i, j, bool(mean[i, j] > 0 and worse.sum() >= confirm)

    def coefficients(self, i: int, j: int) -> np.ndarray:
        """Coefficients of the fit on all rows, for standardised features."""
        if not self.converged[-1, i, j]:
            raise ContractError("the fit at the chosen penalty did not converge")
        return np.where(np.abs(self.beta[-1, i, j]) < ZERO_SPREAD, 0.0, self.beta[-1, i, j])


def moments(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """Per fold: rows, events, rows with a NULL, and the sums and squares of every feature."""
    gap = F.count_if(F.greatest(F.col(y).isNull(), *[F.col(f).isNull() for f in features]))
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"), gap.alias("gaps"), *[F.sum(f).alias(f"s_{f}") for f in features], *[F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features])


def training_scale(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """(fold, feature, n, mean, sd): the scale of the rows OUTSIDE each fold, divisor N, from ``moments``."""
    total = table.agg(F.struct(F.sum("n").alias("n"), *[F.sum(f"{k}_{f}").alias(f"{k}_{f}") for k in "sq" for f in features])).scalar()
    left = table.withColumn("_t", total)
    n = F.col("_t.n") - F.col("n")
    each = []
    for f in features:
        mean = (F.col(f"_t.s_{f}") - F.col(f"s_{f}")) / n
        spread = F.greatest((F.col(f"_t.q_{f}") - F.col(f"q_{f}")) / n - mean * mean, F.lit(0.0))
        each.append(F.struct(F.lit(f).alias("feature"), n.alias("n"), mean.alias("mean"), F.sqrt(spread).alias("sd")))
    return left.select("fold", F.explode(F.array(*each)).alias("e")).select("fold", "e.*")


def penalty_grid(top: float, n: int = 100, ratio: float = 1e-4) -> np.ndarray:
    """Log-spaced penalties from ``top`` down to ``ratio * top``."""
    return top * ratio ** (np.arange(n) / max(1, n - 1))


def _pass(df: DataFrame, without: Sequence[Sequence[int]], raw: np.ndarray, held_out: int = 0, *, open_: np.ndarray | None = None, used: np.ndarray | None = None) -> np.ndarray:
    """Sums over the rows for coefficients ``raw`` (group, model, 1 + features).

    Group g trains on the rows whose fold is not in ``without[g]``. By group: gradient, upper
    triangle of the curvature, deviance. With ``held_out`` (the number of folds) instead the
    deviance of the rows in each fold that the group goes without: (group, fold, model).
    ``open_`` (group, model) leaves other models at 0; ``used`` (model, 1 + features) says which
    features a model has, where most have few: other places of its curvature stay 0.
    """
    groups, models, q = raw.shape
    open_ = np.ones((groups, models), bool) if open_ is None else open_
    upper = np.triu_indices(q)
    place = np.zeros((q, q), int)
    place[upper] = np.arange(len(upper[0]))
    shared = df.sparkSession.sparkContext.broadcast((raw, open_))

    def places(g: int) -> np.ndarray:
        """Where a group's sums stand among those of all its models."""
        at = np.flatnonzero(open_[g])
        curved = [m * len(upper[0]) + (np.arange(len(upper[0])) if used is None else _pairs(used[m], place)) for m in at]
        return np.concatenate([(at[:, None] * q + np.arange(q)).ravel(), models * q + np.concatenate(curved), models * (q + len(upper[0])) + at])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, open_ = shared.value
        step = max(256, CHUNK // models)
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                fold, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                x = np.column_stack([np.ones(len(y)), b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), q - 1)])
                crossed = x[:, upper[0]] * x[:, upper[1]] if used is None and not held_out else None
                for g, gone in enumerate(without):
                    mine_of = open_[g]
                    if not mine_of.any():
                        continue
                    for f in gone if held_out else (-1,):
                        mine = fold == f if held_out else ~np.isin(fold, gone)
                        if not mine.any():
                            continue
                        xs, ys = x[mine], y[mine, None]
                        eta = np.clip(xs @ raw[g][mine_of].T, -30, 30)
                        e = np.exp(-np.abs(eta))
                        d = 1 / (1 + e)
                        part = 2 * (np.maximum(eta, 0) - np.log(d) - ys * eta).sum(axis=0)
                        if not held_out:
                            v, r = e * d * d, np.where(eta >= 0, d, e * d) - ys
                            if used is None:
                                curved = (v.T @ crossed[mine]).ravel()
                            else:
                                curved = np.concatenate([_curvature(xs[:, used[m]], v[:, i]) for i, m in enumerate(np.flatnonzero(mine_of))])
                            part = np.concatenate([(r.T @ xs).ravel(), curved, part])
                        at = g * held_out + f if held_out else g
                        sums[at] = sums.get(at, 0.0) + part
        for f, s in sums.items():
            yield pa.record_batch({"f": np.full(len(s), f, np.int32), "place": (np.arange(len(s)) if held_out else places(f)).astype(np.int32), "v": s})

    rows = df.mapInArrow(add, "f int, place int, v double").groupBy("f", "place").agg(F.sum("v").alias("v")).toPandas()
    shared.unpersist()
    if held_out:
        out = np.zeros((groups * held_out, models))
    else:
        out = np.zeros((groups, models * (q + len(upper[0]) + 1)))
    out[rows["f"], rows["place"]] = rows["v"]
    return out.reshape(groups, held_out, -1) if held_out else out


def _pairs(used: np.ndarray, place: np.ndarray) -> np.ndarray:
    own = np.flatnonzero(used)
    i, j = np.triu_indices(len(own))
    return place[own[i], own[j]]


def _curvature(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ((x * v[:, None]).T @ x)[np.triu_indices(x.shape[1])]


def _solve(start: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Coordinate descent on each model's penalised quadratic, all models at once; place 0 is the unpenalised intercept.

    ``l1`` and ``l2`` are by model and feature.
    """
    b, g = start.copy(), gradient.copy()
    for _ in range(2000):
        moved = 0.0
        for j in range(b.shape[-1]):
            h = curvature[..., j, j]
            pull = h * b[..., j] - g[..., j]
            new = np.where(h > 0, pull / np.maximum(h, 1e-300), 0.0) if j == 0 else np.where(h > ZERO_SPREAD, np.sign(pull) * np.maximum(np.abs(pull) - l1[..., j - 1], 0) / np.maximum(h + l2[..., j - 1], 1e-300), 0.0)
            step = new - b[..., j]
            g += curvature[..., j] * step[..., None]
            b[..., j] = new
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return b


@dataclass(frozen=True)
class _Fits:
    """Models by (group, feature set, mixing, penalty). ``held``: mean deviance by (group, fold, ...)."""

    beta: np.ndarray
    intercept: np.ndarray
    raw: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    lambdas: np.ndarray
    held: np.ndarray
    count: np.ndarray
    converged: np.ndarray
    passes: int


def _fit(df: DataFrame, features: tuple[str, ...], without: Sequence[Sequence[int]], grid_of: Sequence[int], used: np.ndarray, *, folds: int, n_lambdas: int, ratio: float, l1_ratios: Sequence[float], max_passes: int, tolerance: float) -> _Fits:
    """All groups, feature sets, mixings and penalties in shared passes.

    ``without``: folds that each group does not train on; ``grid_of``: the group whose rows set a
    group's penalties; ``used`` (set, feature): features that a set may use.
    """
    stats = {r["fold"]: r for r in moments(df, features).collect()}  # one row per fold
    if not set(stats) <= set(range(folds)):
        raise ContractError("a row has no fold, or one out of range")
    if any(r["gaps"] for r in stats.values()):
        raise ContractError("a row has a NULL outcome or feature")
    row = lambda f, k: np.array([float(stats[f][f"{k}_{x}"]) for x in features]) if f in stats else np.zeros(len(features))
    count = np.array([stats[f]["n"] if f in stats else 0 for f in range(folds)])
    events = np.array([float(stats[f]["events"]) if f in stats else 0.0 for f in range(folds)])
    s, q = np.array([row(f, "s") for f in range(folds)]), np.array([row(f, "q") for f in range(folds)])
    train = lambda v: np.array([v.sum(axis=0) - v[list(gone)].sum(axis=0) for gone in without])
    n, e = train(count).astype(float), train(events)
    if (e <= 0).any() or (e >= n).any():
        raise ContractError("a training fold has one outcome only")
    mean = train(s) / n[:, None]
    sd = np.sqrt(np.maximum(train(q) / n[:, None] - mean**2, 0))
    flat = sd <= ZERO_SPREAD * np.maximum(1, np.abs(mean))
    sd = np.where(flat, 1.0, sd)
    data = df.select("fold", F.col("y").cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).persist()
    try:
        groups, shape = len(without), (len(used), len(l1_ratios), n_lambdas)
        models, width = int(np.prod(shape)), len(features) + 1
        to_raw = np.zeros((groups, width, width))  # standardised to raw coefficients
        to_raw[:, 0, 0] = 1
        to_raw[:, 0, 1:] = -mean / sd
        to_raw[:, np.arange(1, width), np.arange(1, width)] = np.where(flat, 0.0, 1 / sd)
        upper = np.triu_indices(width)
        b = np.zeros((groups, models, width))
        b[..., 0] = np.log(e / (n - e))[:, None]

        def sums(at: np.ndarray, open_: np.ndarray | None = None):
            raw = np.einsum("fij,fmj->fmi", to_raw, at)
            got = _pass(data, without, raw, open_=open_)
            cut = np.cumsum([models * width, models * len(upper[0])])
            g, h, d = np.split(got, cut, axis=1)
            full = np.zeros((groups, models, width, width))
            full[..., upper[0], upper[1]] = full[..., upper[1], upper[0]] = h.reshape(groups, models, -1)
            gradient = np.einsum("fji,fmj->fmi", to_raw, g.reshape(groups, models, width)) / n[:, None, None]
            return gradient, np.einsum("fji,fmjk,fkl->fmil", to_raw, full, to_raw) / n[:, None, None, None], d / n[:, None]

        gradient, curvature, deviance = sums(b)
        top = np.where(used, np.abs(gradient[list(grid_of), :1, 1:]), 0.0).max(axis=-1)  # group, set
        lambdas = np.array([[[penalty_grid(t / max(a, 1e-3), n_lambdas, ratio) for a in l1_ratios] for t in row] for row in top])
        mixing = np.array(l1_ratios)[:, None]
        by_feature = lambda v: np.broadcast_to(v[..., None], (groups, *shape, width - 1))
        l1 = np.where(used[None, :, None, None, :], by_feature(lambdas * mixing), BARRED).reshape(groups, models, -1)
        l2 = by_feature(lambdas * (1 - mixing)).reshape(groups, models, -1)
        worth = lambda at, d: d / 2 + (l1 * np.abs(at[..., 1:])).sum(-1) + (l2 / 2 * at[..., 1:] ** 2).sum(-1)
        value, passes = worth(b, deviance), 1
        converged = np.zeros((groups, models), bool)
        while not converged.all() and passes < max_passes:
            going = ~converged  # a model that has converged stays where it is and is not summed again
            new = np.where(going[..., None], _solve(b, gradient, curvature, l1, l2), b)
            moved = np.abs(new - b).max(axis=-1)
            for _ in range(20):  # shorter steps where the objective would rise
                g2, c2, d2 = (np.where(going[(..., *[None] * (x.ndim - 2))], x, kept) for x, kept in zip(sums(new, going), (gradient, curvature, deviance), strict=True))
                passes += 1
                higher = worth(new, d2) > value + 1e-12 * np.abs(value) + 1e-15
                if not higher.any() or (moved[higher] < tolerance).all():
                    break
                new = np.where(higher[..., None], (new + b) / 2, new)
            b, gradient, curvature, deviance, value = new, g2, c2, d2, worth(new, d2)
            converged = moved < tolerance
        raw = np.einsum("fij,fmj->fmi", to_raw, b)
        held = _pass(data, without, raw, held_out=folds) / np.maximum(count, 1)[:, None]
    finally:
        data.unpersist()
    of = lambda v: v.reshape(groups, *shape, *v.shape[2:])
    return _Fits(of(b[..., 1:]), of(b[..., 0]), of(raw), mean, sd, lambdas, held.reshape(groups, folds, *shape), count, of(converged), passes)


def penalised_path(df: DataFrame, features: Sequence[str], *, folds: int = 10, n_lambdas: int = 100, ratio: float = 1e-4, l1_ratios: Sequence[float] = (1.0,), max_passes: int = 60, tolerance: float = 1e-7) -> Path:
    """Fits all folds, mixings and penalties. ``df``: y (0/1), fold (0..folds-1) and numeric features."""
    features = tuple(features)
    without = [*[(f,) for f in range(folds)], ()]
    fits = _fit(df, features, without, [folds] * (folds + 1), np.ones((1, len(features)), bool), folds=folds, n_lambdas=n_lambdas, ratio=ratio, l1_ratios=l1_ratios, max_passes=max_passes, tolerance=tolerance)
    held = fits.held[np.arange(folds), np.arange(folds), 0]
    return Path(features, np.array(l1_ratios, float), fits.lambdas[-1, 0], fits.beta[:, 0], fits.intercept[:, 0], fits.mean, fits.sd, held, fits.count, fits.converged[:, 0], fits.passes)


@dataclass(frozen=True)
class Nested:
    """One model per (feature set, outer fold), fitted and tuned without the fold's rows."""

    features: tuple[str, ...]
    sets: tuple[str, ...]
    l1_ratio: np.ndarray  # set, fold
    lam: np.ndarray
    coefficients: np.ndarray  # set, fold, intercept and features as given
    passes: int

    def out_of_fold(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_<set>``: each row's event probability under the model of its own outer fold."""
        out = df
        for name, models in zip(self.sets, self.coefficients, strict=True):
            own = F.element_at(F.array(*[F.array(*[F.lit(float(c)) for c in m]) for m in models]), F.col("fold") + 1)
            eta = own[0]
            for i, f in enumerate(self.features):
                eta = eta + own[i + 1] * F.col(f)
            out = out.withColumn(f"p_{name}", 1 / (1 + F.exp(-eta)))
        return out

    def choices(self, spark) -> DataFrame:
        """(set, fold, l1_ratio, lambda, selected): what each outer fold chose, and how many coefficients are not 0."""
        rows = [(s, f, float(self.l1_ratio[k, f]), float(self.lam[k, f]), int((np.abs(self.coefficients[k, f, 1:]) > ZERO_SPREAD).sum())) for k, s in enumerate(self.sets) for f in range(self.lam.shape[1])]
        return spark.createDataFrame(rows, "set string, fold int, l1_ratio double, lambda double, selected int")


def nested_path(df: DataFrame, features: Sequence[str], *, folds: int = 5, sets: Mapping[str, Sequence[str]] | None = None, n_lambdas: int = 50, ratio: float = 1e-3, l1_ratios: Sequence[float] = (1.0,), max_passes: int = 200, tolerance: float = 1e-7) -> Nested:
    """Nested cross-validation: outer fold k is predicted by a model tuned and fitted on the other folds only.

    The inner folds of k are the other outer folds, so the inner model (k, j) trains without k and j.
    Standardisation and penalties of k, its inner models' included, come from the rows outside k.
    All outer and inner models of all feature ``sets`` share every pass over the rows. ``df``: y (0/1),
    fold (0..folds-1; rows of an entity in one fold) and numeric features. Complete or refused: a row
    without a fold, a training part with one outcome or a fit that does not converge stops the job.
    """
    if folds < 3:
        raise ContractError("nested cross-validation takes three folds or more")
    features = tuple(features)
    sets = dict(sets or {"all": features})
    if any(not own or not set(own) <= set(features) for own in sets.values()):
        raise ContractError("a feature set is empty or names an unknown feature")
    used = np.array([[f in own for f in features] for own in sets.values()])
    inner = [(k, j) for k in range(folds) for j in range(folds) if j != k]
    fits = _fit(df, features, [*[(k,) for k in range(folds)], *inner], [*range(folds), *[k for k, _ in inner]], used, folds=folds, n_lambdas=n_lambdas, ratio=ratio, l1_ratios=l1_ratios, max_passes=max_passes, tolerance=tolerance)
    if not fits.converged.all():
        raise ContractError("a fit did not converge")
    l1_ratio, lam, chosen = np.zeros((len(sets), folds)), np.zeros((len(sets), folds)), np.zeros((len(sets), folds, len(features) + 1))
    for k in range(folds):
        error = np.mean([fits.held[folds + i, j] for i, (own, j) in enumerate(inner) if own == k], axis=0)  # set, mixing, penalty
        for s in range(len(sets)):
            i, at = np.unravel_index(np.argmin(error[s]), error[s].shape)
            l1_ratio[s, k], lam[s, k], chosen[s, k] = l1_ratios[i], fits.lambdas[k, s, i, at], fits.raw[k, s, i, at]
    return Nested(features, tuple(sets), l1_ratio, lam, chosen, fits.passes)


def logistic_fits(df: DataFrame, features: Sequence[str], subsets: Sequence[Sequence[str]], *, y: str = "y", max_passes: int = 50, tolerance: float = 1e-8) -> list[tuple[float, dict[str, float], float]]:
    """Unpenalised logistic fits on several subsets of the features at once: (intercept, coefficients, deviance) of each.

    All fits share every pass over the rows; a fit without an optimum (separation) stops the job.
    """
    features = tuple(features)
    used = np.array([[True, *[f in s for f in features]] for s in subsets])
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean, sd = (np.array([float(facts[f"{k}_{f}"]) for f in features]) for k in "ms")
    width, n = len(features) + 1, facts["n"]
    to_raw = np.zeros((width, width))
    to_raw[0, 0] = 1
    to_raw[0, 1:] = -mean / np.where(sd > 0, sd, 1)
    to_raw[np.arange(1, width), np.arange(1, width)] = 1 / np.where(sd > 0, sd, 1)
    upper = np.triu_indices(width)
    data = df.select(F.lit(-1).alias("fold"), F.col(y).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).persist()
    try:
        b = np.zeros((len(subsets), width))
        b[:, 0] = np.log(facts["m"] / (1 - facts["m"]))

        def sums(at: np.ndarray):
            got = _pass(data, [()], (at @ to_raw.T)[None], used=used)[0]
            g, h, d = np.split(got, np.cumsum([at.size, len(subsets) * len(upper[0])]))
            full = np.zeros((len(subsets), width, width))
            full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = h.reshape(len(subsets), -1)
            return g.reshape(at.shape) @ to_raw / n, np.einsum("ji,mjk,kl->mil", to_raw, full, to_raw) / n, d

        gradient, curvature, deviance = sums(b)
        for _ in range(max_passes):
            held = np.where(used[:, :, None] & used[:, None, :], curvature, 0.0) + np.where(used, 0.0, 1.0)[:, :, None] * np.eye(width)
            step = np.linalg.solve(held, np.where(used, -gradient, 0.0)[..., None])[..., 0]
            for _ in range(20):
                g2, c2, d2 = sums(b + step)
                higher = d2 > deviance + 1e-9
                if not higher.any():
                    break
                step = np.where(higher[:, None], step / 2, step)
            b, gradient, curvature, deviance = b + step, g2, c2, d2
            if np.abs(step).max() < tolerance:
                break
        else:
            raise ContractError("separation: a fit has no optimum")
    finally:
        data.unpersist()
    raw = b @ to_raw.T
    return [(float(r[0]), {f: float(r[i + 1]) for i, f in enumerate(features) if used[k, i + 1]}, float(deviance[k])) for k, r in enumerate(raw)]
