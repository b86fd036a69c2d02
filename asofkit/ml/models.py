"""Model fitting as Spark ML jobs. Features are double columns; training data never leave the executors.

The driver loops only over independent fits or over iterations of a distributed aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import scalars, stats
from asofkit.ml.paths import Path, logistic_fits
from asofkit.operators.contracts import ContractError
from asofkit.operators.design import power_scaling, standardise
from asofkit.operators.splits import forbidden_rows


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df).select(*keep, "features")


def refuse_held_back(train: DataFrame, held_back: DataFrame | None, keys: Sequence[str]) -> None:
    """Fitting stops when a training key is a validation or test key."""
    if held_back is not None and not forbidden_rows(train, held_back, keys).isEmpty():
        raise ContractError("training rows include held-back keys")


def score(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows with the event probability ``p``."""
    out = model.transform(assemble(df, features, keep))
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


# ------------------------------------------------------------------ penalised logistic
def lambda_max(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Smallest penalty that sets every coefficient to 0: max |sum z (y - mean y)| / n over standardised features."""
    mean_y = df.agg(F.avg(y)).scalar()
    z = standardise(df, features).withColumn("_my", mean_y)
    sums = z.agg(*[F.abs(F.sum(F.col(f"{f}__z") * (F.col(y) - F.col("_my"))) / F.count(F.lit(1))).alias(f) for f in features])
    return sums.select(F.greatest(*features, F.lit(0.0)).alias("lambda_max"))


def penalised(lam: float, l1_ratio: float, max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", regParam=lam, elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter, tol=1e-6)


def deviance_table(folds: DataFrame) -> DataFrame:
    """Mean deviance and its standard error per mixing and penalty over folds."""
    return folds.groupBy("l1_ratio", "lambda").agg(F.avg("deviance").alias("mean_deviance"), (F.stddev_samp("deviance") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("folds"))


def path_coefficients(path: Path, spark) -> DataFrame:
    """Coefficients at the mixing and penalty with the lowest mean fold deviance, with rank, odds ratio and the choice itself."""
    i, j, identified = path.chosen()
    return (ranked_coefficients(path.features, path.coefficients(i, j), spark)
            .withColumns({"l1_ratio": F.lit(float(path.l1_ratios[i])), "lambda": F.lit(float(path.lambdas[i, j])), "identified": F.lit(identified)}))


def optimality(df: DataFrame, path: Path) -> DataFrame:
    """(feature, residual): how far the chosen model is from its optimality conditions, computed from the rows.

    For a coefficient other than 0 the derivative of the penalised objective, for 0 what the derivative exceeds the penalty by.
    """
    i, j, _ = path.chosen()
    lam, a, b = float(path.lambdas[i, j]), float(path.l1_ratios[i]), [float(x) for x in path.coefficients(i, j)]
    z = {f: (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(path.features, path.mean[-1], path.sd[-1], strict=True)}
    eta = F.lit(float(path.intercept[-1, i, j]))
    for f, c in zip(path.features, b, strict=True):
        eta = eta + F.lit(c) * z[f]
    g = df.withColumn("_r", 1 / (1 + F.exp(-eta)) - F.col("y")).agg(F.avg("_r").alias("(intercept)"), *[F.avg(F.col("_r") * z[f]).alias(f) for f in path.features])
    each = [F.struct(F.lit("(intercept)").alias("feature"), F.abs("(intercept)").alias("residual"))]
    for f, c in zip(path.features, b, strict=True):
        slope = F.col(f) + F.lit(lam * (1 - a) * c)
        residual = F.greatest(F.abs(slope) - lam * a, F.lit(0.0)) if c == 0 else F.abs(slope + F.lit(lam * a * (1 if c > 0 else -1)))
        each.append(F.struct(F.lit(f).alias("feature"), residual.alias("residual")))
    return g.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def ranked_coefficients(features: Sequence[str], values, spark) -> DataFrame:
    """Feature, coefficient, odds ratio and rank by absolute size."""
    rows = sorted(zip(features, (float(c) for c in values), strict=True), key=lambda r: (-abs(r[1]), r[0]))
    t = spark.createDataFrame([(f, c, i + 1) for i, (f, c) in enumerate(rows)], "feature string, coefficient double, rank int")
    return t.withColumn("odds_ratio", F.exp("coefficient"))


def coefficient_table(model, features: Sequence[str], spark) -> DataFrame:
    return ranked_coefficients(features, model.coefficients, spark)


def fit_unpenalised(df: DataFrame, features: Sequence[str], offset: str | None = None, max_coef: float = 50.0):
    """Maximum-likelihood logistic with standard errors; separation shows as a diverged coefficient and is refused."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", featuresCol="features", maxIter=50, tol=1e-10)
    keep = ["y"]
    if offset:
        glm = glm.setOffsetCol(offset)
        keep.append(offset)
    model = glm.fit(assemble(df, features, keep))
    if any(abs(c) > max_coef for c in model.coefficients):
        raise ContractError("separation: a coefficient diverged")
    return model


def glm_table(model, features: Sequence[str], spark) -> DataFrame:
    se = list(model.summary.coefficientStandardErrors)
    rows = [("(intercept)", float(model.intercept), float(se[-1])), *[(f, float(c), float(s)) for f, c, s in zip(features, model.coefficients, se)]]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double")


# ------------------------------------------------------------------ trees
def random_forest(trees: int = 50, depth: int = 5, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)


def boosted_trees(rounds: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 1, validation: str | None = None) -> GBTClassifier:
    """Gradient boosting; ``validation`` names a boolean column whose rows stop the boosting early."""
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def fit_trees(estimator, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("y",)):
    """Trees with NULL handling: a missing value becomes an indicator and the column minimum minus one (one aggregate)."""
    return estimator.fit(assemble(fill_for_trees(df, features), tree_columns(features), list(keep)))


def tree_columns(features: Sequence[str]) -> list[str]:
    return [*features, *[f"{f}__null" for f in features]]


def fill_for_trees(df: DataFrame, features: Sequence[str]) -> DataFrame:
    low = df.agg(F.struct(*[F.coalesce(F.min(F.col(f).cast("double")) - 1, F.lit(0.0)).alias(f) for f in features])).scalar()
    flags = {f"{f}__null": F.col(f).isNull().cast("double") for f in features}
    return df.withColumn("_low", low).withColumns(flags).withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"_low.{f}")) for f in features}).drop("_low")


# ------------------------------------------------------------------ search
def expand_space(space: Mapping[str, Sequence], limit: int) -> list[dict]:
    """Every combination of a bounded grid; a larger grid is refused."""
    combos = [dict(zip(space, values)) for values in product(*space.values())]
    if len(combos) > limit:
        raise ContractError(f"{len(combos)} trials exceed the limit of {limit}")
    return combos


def search(trials: Sequence[dict], fit_score: Callable[[dict], DataFrame], metrics: Callable[[DataFrame], DataFrame], weights: Mapping[str, float], spark) -> DataFrame:
    """One row per trial with its metrics on validation rows, the weighted objective and its place."""
    rows = []
    for i, params in enumerate(trials):
        m = metrics(fit_score(params)).first().asDict()
        values = [m.get(k) for k in weights]
        objective = None if any(v is None for v in values) else sum(float(v) * w for v, w in zip(values, weights.values()))
        rows.append((i, str(sorted(params.items())), objective))
    t = spark.createDataFrame(rows, "trial int, params string, objective double")
    ranked = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0]))
    places = spark.createDataFrame([(r[0], k + 1) for k, r in enumerate(ranked)], "trial int, place int")
    return t.join(places, "trial", "left")


# ------------------------------------------------------------------ separation
def separation_omissions(df: DataFrame, binary: Sequence[str], y: str) -> list[tuple[int, str, str, int]]:
    """Drop constant columns and 0/1 levels that hold one outcome class, with their rows, until nothing changes.

    Each round is one aggregate over the remaining rows. Result: (round, column, reason, rows dropped).
    """
    kept = df.select(y, *binary).persist()
    left, rows, out = list(binary), kept, []
    round_no = 0
    while left:
        round_no += 1
        parts = []
        for c in left:
            for v in (0, 1):
                hit = F.col(c) == v
                parts += [F.count_if(hit).alias(f"{c}|{v}|n"), F.sum(F.when(hit, F.col(y)).otherwise(0)).alias(f"{c}|{v}|e")]
        s = rows.agg(*parts).first()
        found = None
        for c in left:
            n = {v: s[f"{c}|{v}|n"] for v in (0, 1)}
            e = {v: s[f"{c}|{v}|e"] or 0 for v in (0, 1)}
            if 0 in n.values():
                found = (round_no, c, "constant", 0)
            else:
                level = next((v for v in (1, 0) if e[v] in (0, n[v])), None)
                if level is not None:
                    found = (round_no, c, f"level {level} predicts {'failure' if e[level] == 0 else 'success'} perfectly", n[level])
                    rows = rows.where(F.col(c) != level)
            if found:
                break
        if not found:
            break
        out.append(found)
        left.remove(found[1])
    kept.unpersist()
    return out


# ------------------------------------------------------------------ fractional polynomials
POWERS = (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0)  # fixed set of powers


def power_candidates(max_degree: int = 2) -> list[tuple[float, ...]]:
    """8 one-term and 36 two-term power sets."""
    one = [(p,) for p in POWERS]
    two = [(a, b) for i, a in enumerate(POWERS) for b in POWERS[i:]]
    return one + (two if max_degree >= 2 else [])


def power_deviances(df: DataFrame, variable: str, other: Sequence[str], candidates: Sequence[tuple[float, ...]], scaling=None) -> dict[tuple[float, ...], float]:
    """Model deviance per power set of one variable next to the other features (linear: power 1); all sets share the passes."""
    s = scaling or power_scaling(df, variable).first()
    terms = {powers: scalars.power_terms(F.col(variable), powers, s["shift"], s["scale"]) for powers in candidates}
    names: dict[str, str] = {}  # equal terms of several sets are one column
    columns = {powers: [names.setdefault(str(t), f"_fp{len(names)}") for t in ts] for powers, ts in terms.items()}
    data = df.withColumns({names[str(t)]: t for ts in terms.values() for t in ts})
    fits = logistic_fits(data, [*names.values(), *other], [[*columns[powers], *other] for powers in candidates])
    return {powers: fit[2] for powers, fit in zip(candidates, fits, strict=True)}


def deviance_rows(variable: str, deviances: Mapping[tuple[float, ...], float], spark) -> DataFrame:
    rows = [(variable, [float(p) for p in powers], len(powers), d) for powers, d in deviances.items()]
    return spark.createDataFrame(rows, "variable string, powers array<double>, degree int, deviance double")


def closed_test(table: DataFrame, null_deviance: float, alpha: float = 0.05) -> tuple[float, ...] | None:
    """Closed test: drop the variable, else linear, else the best one-term, else the best two-term set (None = drop).

    Chi-square quantiles with 4, 3 and 2 degrees of freedom at 5%: fixed values.
    """
    if alpha != 0.05:
        raise ValueError("only alpha = 0.05 is tabulated")
    crit = {4: 9.487729, 3: 7.814728, 2: 5.991465}
    rows = table.orderBy("deviance").collect()
    best2 = next(r for r in rows if r["degree"] == 2)
    best1 = next(r for r in rows if r["degree"] == 1)
    linear = next(r for r in rows if list(r["powers"]) == [1.0])
    if null_deviance - best2["deviance"] <= crit[4]:
        return None
    if linear["deviance"] - best2["deviance"] <= crit[3]:
        return (1.0,)
    if best1["deviance"] - best2["deviance"] <= crit[2]:
        return tuple(best1["powers"])
    return tuple(best2["powers"])


LINEAR = (1.0,)


def chi_square_tail(x: float, freedom: int) -> float:
    """P(chi-square > x) for 1, 2 or 3 degrees of freedom."""
    x = max(x, 0.0)
    two_sided = math.erfc(math.sqrt(x / 2))
    return {1: two_sided, 2: math.exp(-x / 2), 3: two_sided + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)}[freedom]


def tested_form(deviance: Mapping[tuple[float, ...], float], alpha: float = 0.05) -> dict:
    """Closed test of one variable that stays in: linear, else the best one-term, else the best two-term set.

    Two terms against linear on 3 degrees of freedom, then against one term on 2; without two-term sets one term
    against linear on 1. Ties go to the first set in the order of ``POWERS``.
    """
    best = {d: min((p for p in deviance if len(p) == d), key=deviance.get, default=None) for d in (1, 2)}
    one, two, line = best[1], best[2], deviance[LINEAR]
    if two is None:
        curved, simpler = chi_square_tail(line - deviance[one], 1), None
        form = one if curved < alpha else LINEAR
    else:
        curved, simpler = chi_square_tail(line - deviance[two], 3), chi_square_tail(deviance[one] - deviance[two], 2)
        form = LINEAR if curved >= alpha else one if simpler >= alpha else two
    return {"form": form, "p_nonlinear": curved, "p_simplify": simpler, "deviance_linear": line, "deviance_one": deviance[one], "deviance_two": None if two is None else deviance[two]}


def select_power_forms(df: DataFrame, variables: Sequence[str], other: Sequence[str] = (), *, max_degree: int = 2, alpha: float = 0.05, max_cycles: int = 5) -> DataFrame:
    """Power forms of several variables by backfitting; one row per variable.

    All variables stay in the model. They are taken in the order of what dropping each from the
    all-linear model costs (dearest first, ties by name). A cycle tests every variable given the
    present forms of the others and the ``other`` features; cycles go on until one changes nothing
    (``converged``) or ``max_cycles``. All candidates of a variable share the passes of one fit
    (``logistic_fits``), and a variable whose surroundings have not moved since its last test keeps
    its result. ``df`` has y (0/1); values are not NULL.
    """
    if not variables or max_cycles < 1 or max_degree not in (1, 2) or not 0 < alpha < 1:
        raise ContractError("power forms need variables, a cycle or more, degree 1 or 2 and alpha within (0, 1)")
    if df.where(F.greatest(F.col("y").isNull(), *[F.col(c).isNull() for c in (*variables, *other)])).limit(1).count():
        raise ContractError("a row has a NULL outcome or feature")
    df = df.select("y", *variables, *other).persist()  # every fit reads it
    try:
        names = sorted(variables)
        features = [*names, *other]
        whole, *less = [fit[2] for fit in logistic_fits(df, features, [features, *[[f for f in features if f != v] for v in names]])]
        cost = {v: max(d - whole, 0.0) for v, d in zip(names, less, strict=True)}
        order = sorted(names, key=lambda v: (-cost[v], v))
        scaling = {v: power_scaling(df, v).first() for v in order}
        forms, tested, met = dict.fromkeys(order, LINEAR), {}, {}
        converged, cycle = False, 0
        while not converged and cycle < max_cycles:
            cycle, converged = cycle + 1, True
            for v in order:
                around = tuple(forms[u] for u in order if u != v)
                if met.get(v) != around:
                    terms = {f"_{u}{i}": c for u in order if u != v for i, c in enumerate(_form(u, forms[u], scaling[u]))}
                    table = power_deviances(df.withColumns(terms), v, [*terms, *other], power_candidates(max_degree), scaling[v])
                    tested[v], met[v] = tested_form(table, alpha), around
                if tested[v]["form"] != forms[v]:
                    forms[v], converged = tested[v]["form"], False
    finally:
        df.unpersist()
    rows = [(v, [float(p) for p in forms[v]], *((0.0, 1.0) if forms[v] == LINEAR else (float(scaling[v]["shift"]), float(scaling[v]["scale"]))), i + 1, cost[v],
             *[tested[v][k] for k in ("deviance_linear", "deviance_one", "deviance_two", "p_nonlinear", "p_simplify")], cycle, converged) for i, v in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "variable string, powers array<double>, shift double, scale double, place int, drop_cost double, deviance_linear double, deviance_one double, deviance_two double, p_nonlinear double, p_simplify double, cycles int, converged boolean")


def _form(variable: str, powers: tuple[float, ...], scaling) -> list[Column]:
    return [F.col(variable).cast("double")] if powers == LINEAR else scalars.power_terms(F.col(variable), powers, scaling["shift"], scaling["scale"])


def risk_column(intercept: float, coefs: Mapping[str, float]) -> Column:
    return stats.expit(scalars.linear_predictor(intercept, coefs))
