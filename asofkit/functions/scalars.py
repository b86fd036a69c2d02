"""Row-level expressions: recodes, engineered values, encodings, keys, scores, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Category part before the dot per code system.
CODE_HEADS = {"ICD-10": r"[A-Z]\d{2}", "ICD-10-CM": r"[A-Z]\d[A-Z0-9]", "ICD-9-CM": r"E\d{3}|V\d{2}|\d{3}"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ text to typed values
def to_number(raw: Column | str) -> Column:
    """Plain decimal text to double; anything else (also 'nan', 'inf', '1d') is NULL."""
    text = F.trim(_c(raw))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_integer(raw: Column | str) -> Column:
    """Integral numbers and true / false to long; other text is NULL, never repaired."""
    text = F.lower(F.trim(_c(raw)))
    num = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(to_number(raw))
    return F.when(num == F.round(num), num.cast("long"))


def to_text(raw: Column | str) -> Column:
    return F.nullif(F.trim(_c(raw)), F.lit(""))


def normalise_cell(raw: Column | str) -> Column:
    """Trim, empty to NULL, integral numbers back to integer text."""
    return F.nullif(F.regexp_replace(F.trim(_c(raw)), r"^([+-]?\d+)\.0+$", "$1"), F.lit(""))


# Fixed values of a shape: what digits and letters become, how runs of letters and long shapes are cut.
SHAPE_DIGITS, SHAPE_LETTERS = "[0-9]", "[A-Za-z\u0590-\u05ff]"
SHAPE_DIGIT, SHAPE_LETTER, SHAPE_LONG_RUN, SHAPE_RUN, SHAPE_BLANK = "9", "a", "a{4,}", "aaa…", "(blank)"
SHAPE_LENGTH = 24


def text_shape(raw: Column | str) -> Column:
    """Shape of a text: digits and Latin or Hebrew letters by their signs, long letter runs and long shapes cut."""
    shape = F.regexp_replace(F.trim(_c(raw)), SHAPE_DIGITS, SHAPE_DIGIT)
    shape = F.regexp_replace(shape, SHAPE_LETTERS, SHAPE_LETTER)
    shape = F.left(F.regexp_replace(shape, SHAPE_LONG_RUN, SHAPE_RUN), F.lit(SHAPE_LENGTH))
    return F.when(F.length(shape) > 0, shape).otherwise(SHAPE_BLANK)


# ------------------------------------------------------------------ codes
def normalise_code(code: Column | str) -> Column:
    return F.upper(F.trim(F.replace(_c(code), F.lit("."), F.lit(""))))


def well_formed(code: Column | str, system: Column | str) -> Column:
    """A dotted code must have the category shape of its system before the dot; undotted codes pass."""
    text = F.upper(F.trim(_c(code)))
    head = F.substring_index(text, ".", 1)
    ok = F.lit(False)
    for name, pattern in CODE_HEADS.items():
        ok = ok | ((_c(system) == name) & head.rlike(f"^({pattern})$"))
    return ~F.contains(text, F.lit(".")) | ok


def expand_code_ranges(rules: DataFrame, col: str = "codes") -> DataFrame:
    """'A10-A14' to one row per code, keeping letter and width; single codes stay."""
    norm = F.replace(normalise_code(col), F.lit(" "), F.lit(""))
    lo, hi = F.split(norm, "-")[0], F.element_at(F.split(norm, "-"), -1)
    digits = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    letter = F.regexp_extract(lo, r"^([A-Z]?)", 1)
    is_range = F.contains(norm, F.lit("-"))
    numbers = F.sequence(digits(lo).cast("int"), digits(hi).cast("int"))
    expanded = F.transform(numbers, lambda i: F.concat(letter, F.lpad(i.cast("string"), F.length(digits(lo)), F.lit("0"))))
    return rules.withColumn("prefix", F.explode(F.when(is_range, expanded).otherwise(F.array(lo))))


# ------------------------------------------------------------------ recodes and engineered values
def recode(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Declared values to targets; an undeclared value gives NULL (count it with ``unmapped``)."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.element_at(F.create_map(*pairs), _c(col).cast("string"))


def unmapped(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Observed values without a target, with their counts; must be empty."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).cast("string").isin(*mapping)).groupBy(F.col(col).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def any_positive(cols: Sequence[Column | str], *, null_is_absent: bool = False) -> Column:
    """1 when any value is positive; NULL only when all are NULL (or 0 when NULL is declared to mean absent)."""
    cs = [_c(c) for c in cols]
    hit = F.lit(False)
    seen = F.lit(False)
    for c in cs:
        hit = hit | F.coalesce(c > 0, F.lit(False))
        seen = seen | c.isNotNull()
    value = hit.cast("int")
    return value if null_is_absent else F.when(seen, value)


def explained_count(col: Column | str, absent: Column | str) -> Column:
    """A count whose NULL is 0 only where the source is flagged absent."""
    return F.when(_c(col).isNull() & (_c(absent) == 1), F.lit(0)).otherwise(_c(col))


def unexplained_nulls(col: Column | str, absent: Column | str) -> Column:
    return F.count_if(_c(col).isNull() & ~F.coalesce(_c(absent) == 1, F.lit(False)))


def flag_below(col: Column | str, cut: float) -> Column:
    return (_c(col) < cut).cast("int")


def flag_at_least(col: Column | str, cut: float) -> Column:
    return (_c(col) >= cut).cast("int")


def recorded(col: str, dtype: str) -> Column:
    """Something is recorded: a non-zero number, a date, or non-blank text."""
    c = F.col(col)
    if dtype == "string":
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if dtype in ("date", "timestamp"):
        return c.isNotNull()
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def no_record_value(kind: str, missing: str) -> Column:
    """Value of a feature when nothing is recorded: 0 for declared-absent indicators and counts, else NULL."""
    return F.lit(0.0) if kind in ("binary", "count") and missing == "absent" else F.lit(None).cast("double")


def band(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: labels[i] for edges[i-1] <= value < edges[i]; NULL stays NULL."""
    c = _c(col)
    chain = F.when(c < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        chain = chain.when(c < e, label)
    return chain.when(c.isNotNull(), labels[-1])


def body_category(col: Column | str, obese: float = 30.0) -> Column:
    return F.coalesce(band(col, [18.5, 25.0, obese], ["underweight", "normal", "overweight", "obese"]), F.lit("missing"))


def log_count(col: Column | str) -> Column:
    """ln((n + 1) / 10); NULL for NULL or negative counts."""
    c = _c(col)
    return F.when(c >= 0, F.log((c + 1) / F.lit(10.0)))


# ------------------------------------------------------------------ encodings
def one_hot(col: str, levels: Sequence[str], *, reference: str | None = None, null_level: str | None = None) -> dict[str, Column]:
    """One 0/1 double per declared level (without the reference level); NULL counts as ``null_level``."""
    value = F.coalesce(F.col(col), F.lit(null_level)) if null_level else F.col(col)
    return {f"{col}__{lv}": F.coalesce(value == lv, F.lit(False)).cast("double") for lv in levels if lv != reference}


def thermometer(col: str, levels: Sequence[float]) -> dict[str, Column]:
    return {f"{col}__ge_{lv:g}": F.coalesce(F.col(col) >= lv, F.lit(False)).cast("double") for lv in levels}


def recency_bands(col: str, edges: Sequence[int]) -> dict[str, Column]:
    """Indicator per band of days since, left-closed; a NULL is in no band."""
    out, lo = {}, 0
    for e in edges:
        out[f"{col}__{lo}_{e - 1}"] = F.coalesce((F.col(col) >= lo) & (F.col(col) < e), F.lit(False)).cast("double")
        lo = e
    out[f"{col}__{lo}_plus"] = F.coalesce(F.col(col) >= lo, F.lit(False)).cast("double")
    return out


def log1p_encoded(col: str) -> Column:
    return F.log1p(F.greatest(F.col(col), F.lit(0)))


def power_terms(x: Column, powers: Sequence[float], shift: float = 0.0, scale: float = 1.0) -> list[Column]:
    """Fractional polynomial terms of (x + shift) / scale: x^p, ln x for p = 0, a repeated power times ln x."""
    z = (x + shift) / scale
    out, last = [], None
    for p in powers:
        term = F.log(z) if p == 0 else F.pow(z, F.lit(float(p)))
        out.append(out[-1] * F.log(z) if last is not None and p == last else term)
        last = p
    return out


# ------------------------------------------------------------------ scoring
def linear_predictor(intercept: float, coefs: Mapping[str, float]) -> Column:
    total = F.lit(float(intercept))
    for name, beta in coefs.items():
        total = total + F.lit(float(beta)) * F.col(name)
    return total


def contributions(coefs: Mapping[str, float], reference: Mapping[str, float]) -> dict[str, Column]:
    return {n: F.lit(float(b)) * (F.col(n) - F.lit(float(reference.get(n, 0.0)))) for n, b in coefs.items()}


def top_contributions(coefs: Mapping[str, float], reference: Mapping[str, float], k: int) -> Column:
    """Array of the k largest contributions by absolute size (name breaks ties), without zeros, with direction."""
    parts = [F.struct(-F.abs(c).alias("order"), F.lit(n).alias("name"), c.alias("value")) for n, c in contributions(coefs, reference).items()]
    best = F.slice(F.array_sort(F.array(*parts)), 1, k)
    kept = F.filter(best, lambda s: s["value"] != 0)
    return F.transform(kept, lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"),
                                                F.when(s["value"] > 0, "raises").otherwise("lowers").alias("direction")))


def risk_category(risk: Column | str, cuts: Sequence[float], labels: Sequence[str], *, approved: bool = True) -> Column:
    """Lower-closed categories; hidden (NULL) unless the cut points are approved."""
    return band(risk, cuts, labels) if approved else F.lit(None).cast("string")


def row_flags(tests: Mapping[str, Column]) -> Column:
    """Names of the tests that hold for the row."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^0-9a-z]+", "_")
