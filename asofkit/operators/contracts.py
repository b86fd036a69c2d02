"""Contract-checked tables: typed reads with counted failures, validation, rule battery, schema diff.

A contract is a small Python object. It drives generated expressions; each check is a
count inside one aggregate over the data, never a row returned to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import dates, scalars, suppress

PREDICTOR_ROLES = ("PREDICTOR", "CANDIDATE")
SEVERITIES = ("CRITICAL", "WARNING", "INFO")


@dataclass(frozen=True)
class ColumnRule:
    name: str
    kind: str  # integer, decimal, date, text
    nullable: bool = True
    role: str = "PREDICTOR"
    timing: str = "pre_index"
    semantic: str = "continuous"
    allowed: tuple[str, ...] = ()
    sentinels: tuple[str, ...] = ()
    sentinel_to_null: bool = False
    null_means: str = ""
    source: str = ""


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnRule, ...]
    date_formats: tuple[str, ...] = ("yyyy-MM-dd",)
    constants: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        dates.check_formats(self.date_formats)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


# ------------------------------------------------------------------ coercion
def typed(rule: ColumnRule, raw: Column | str, formats: Sequence[str]) -> Column:
    if rule.kind == "integer":
        return scalars.to_integer(raw)
    if rule.kind == "decimal":
        return scalars.to_number(raw)
    if rule.kind == "date":
        return dates.parse_dates(raw, formats)
    return scalars.to_text(raw)


def coerce(raw: DataFrame, contract: Contract, *, keep_raw: bool = False) -> DataFrame:
    """Every contract column cast by its declared kind; unreadable text is NULL. ``keep_raw`` adds ``raw__*`` columns."""
    rules = {c.name: c for c in contract.columns}
    cols = [typed(rules[c], c, contract.date_formats).alias(c) if c in rules else F.col(c) for c in raw.columns]
    extra = [F.col(c).alias(f"raw__{c}") for c in raw.columns if keep_raw and c in rules]
    return raw.select(*cols, *extra)


def unreadable(rule: ColumnRule, raw: Column | str, formats: Sequence[str]) -> Column:
    text = F.nullif(F.trim(F.col(raw) if isinstance(raw, str) else raw), F.lit(""))
    return text.isNotNull() & typed(rule, raw, formats).isNull()


def not_allowed(rule: ColumnRule) -> Column:
    c = F.col(rule.name)
    return c.isNotNull() & ~c.cast("string").isin(*rule.allowed) if rule.allowed else F.lit(False)


def coercion_counts(raw: DataFrame, contract: Contract) -> DataFrame:
    """Per column: observed, unreadable (wrong type) and out-of-list values, in one aggregate."""
    parts = []
    for r in contract.columns:
        if r.name not in raw.columns:
            continue
        value = typed(r, r.name, contract.date_formats)
        bad_level = value.isNotNull() & ~value.cast("string").isin(*r.allowed) if r.allowed else F.lit(False)
        text = F.nullif(F.trim(r.name), F.lit(""))
        parts.append((r.name, F.struct(F.count(text).alias("observed"), F.count_if(unreadable(r, r.name, contract.date_formats)).alias("wrong_type"),
                                       F.count_if(bad_level).alias("out_of_list"), F.count_if(value.isNull()).alias("nulls"))))
    return _rows_from_aggregate(raw, parts, "column_name")


def _rows_from_aggregate(df: DataFrame, parts: Sequence[tuple[str, Column]], key: str) -> DataFrame:
    """One aggregate of named structs turned into one row per name."""
    one = df.agg(*[c.alias(f"_{i}") for i, (_, c) in enumerate(parts)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias("v")) for i, (n, _) in enumerate(parts)]))
    return one.select(each.alias("e")).select(f"e.{key}", "e.v.*")


def problem_masks(raw: DataFrame, contract: Contract, keys: Sequence[str]) -> DataFrame:
    """Per row and column: unreadable, or outside the allowed list (two boolean columns each)."""
    cols = []
    for r in contract.columns:
        if r.name in raw.columns and r.name not in keys:
            value = typed(r, r.name, contract.date_formats)
            cols.append(unreadable(r, r.name, contract.date_formats).alias(f"{r.name}__unreadable"))
            if r.allowed:
                cols.append((value.isNotNull() & ~value.cast("string").isin(*r.allowed)).alias(f"{r.name}__not_allowed"))
    return raw.select(*keys, *cols)


def date_formats_used(raw: DataFrame, contract: Contract) -> DataFrame:
    """Values read with each declared format, per date column."""
    cols = [r.name for r in contract.columns if r.kind == "date" and r.name in raw.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), dates.parsed_format(c, contract.date_formats).alias("date_format")) for c in cols]))
    return (raw.select(each.alias("e")).select("e.*").where("date_format IS NOT NULL").groupBy("column_name", "date_format")
            .agg(F.count(F.lit(1)).alias("n")))


def failed_shapes(raw: DataFrame, contract: Contract) -> DataFrame:
    """Masked shapes of the texts that could not be read, per column."""
    items = [F.struct(F.lit(r.name).alias("column_name"), F.when(unreadable(r, r.name, contract.date_formats), scalars.text_shape(r.name)).alias("shape"))
             for r in contract.columns if r.name in raw.columns and r.kind != "text"]
    return (raw.select(F.explode(F.array(*items)).alias("e")).select("e.*").where("shape IS NOT NULL").groupBy("column_name", "shape")
            .agg(F.count(F.lit(1)).alias("n")))


def sentinel_report(df: DataFrame, contract: Contract, far: str = "2100-01-01") -> DataFrame:
    """Per date column: range, declared sentinels, undeclared far dates."""
    parts = []
    for r in contract.columns:
        if r.kind != "date" or r.name not in df.columns:
            continue
        c = F.col(r.name)
        sent = c.isin(*[F.lit(s).cast("date") for s in r.sentinels]) if r.sentinels else F.lit(False)
        real = F.when(~sent, c)
        parts.append((r.name, F.struct(F.count(c).alias("observed"), F.min(real).alias("first_date"), F.max(real).alias("last_date"),
                                       F.count_if(sent).alias("sentinels"), F.count_if((c >= F.lit(far).cast("date")) & ~sent).alias("undeclared_far"))))
    return _rows_from_aggregate(df, parts, "column_name")


def resolve_sentinels(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared sentinels become NULL where the contract says so."""
    for r in contract.columns:
        if r.sentinels and r.sentinel_to_null and r.name in df.columns:
            df = df.withColumn(r.name, dates.sentinel_to_null(r.name, r.sentinels))
    return df


# ------------------------------------------------------------------ validation
def validate_contract(df: DataFrame, contract: Contract, strict: Sequence[str] = ()) -> DataFrame:
    """NOT NULL, allowed lists, far dates and constants: one row per check with a level (problem in strict columns, else warning)."""
    parts: list[tuple[str, str, Column]] = []
    for r in contract.columns:
        if r.name not in df.columns:
            continue
        c = F.col(r.name)
        if not r.nullable:
            parts.append((r.name, "null_in_not_null", F.count_if(c.isNull())))
        if r.allowed:
            parts.append((r.name, "not_allowed", F.count_if(not_allowed(r))))
        if r.kind == "date":
            sent = c.isin(*[F.lit(s).cast("date") for s in r.sentinels]) if r.sentinels else F.lit(False)
            parts.append((r.name, "undeclared_far_date", F.count_if((c >= F.lit("2100-01-01").cast("date")) & ~sent)))
    for name, value in contract.constants.items():
        parts.append((name, "not_constant", F.count_if(~F.col(name).cast("string").eqNullSafe(value))))
    rows = _rows_from_aggregate(df, [(f"{c}|{k}", F.struct(v.alias("n"))) for c, k, v in parts], "check")
    name = F.substring_index("check", "|", 1)
    return rows.select(name.alias("column_name"), F.substring_index("check", "|", -1).alias("check_name"), "n",
                       F.when(F.col("n") == 0, "ok").when(name.isin(*strict) if strict else F.lit(False), "problem").otherwise("warning").alias("level"))


@dataclass(frozen=True)
class FeatureRule:
    name: str
    kind: str  # binary, count, float, categorical
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    levels: tuple[str, ...] = ()


def validate_modeling_rows(df: DataFrame, features: Sequence[FeatureRule], *, keys: Sequence[str], index: str, latest: str, y: str, event: str,
                           window_days: int, constants: Sequence[str] = ()) -> DataFrame:
    """All rules of a modelling table at once: one row per check with the number of violating rows."""
    end = dates.window_end(index, days=window_days)
    yy, ev = F.col(y), F.col(event)
    checks: list[tuple[str, Column]] = [
        ("null_index_date", F.count_if(F.col(index).isNull())),
        ("evidence_on_or_after_index", F.count_if(F.col(latest) >= F.col(index))),
        ("null_outcome", F.count_if(yy.isNull())),
        ("illegal_outcome", F.count_if(~yy.isin(0, 1))),
        ("positive_without_event_date", F.count_if((yy == 1) & ev.isNull())),
        ("negative_with_event_date", F.count_if((yy == 0) & ev.isNotNull())),
        ("event_outside_window", F.count_if((ev < F.col(index)) | (ev > end))),
    ]
    for k in keys:
        checks.append((f"null_key:{k}", F.count_if(F.col(k).isNull())))
    for f in features:
        c = F.col(f.name)
        if not f.nullable:
            checks.append((f"null:{f.name}", F.count_if(c.isNull())))
        if f.kind == "binary":
            checks.append((f"illegal:{f.name}", F.count_if(~c.isin(0, 1))))
        if f.kind == "float":
            checks.append((f"not_finite:{f.name}", F.count_if(F.isnan(c) | (F.abs(c) == float("inf")))))
        if f.kind == "categorical":
            checks.append((f"undeclared_level:{f.name}", F.count_if(~c.isin(*f.levels))))
        if f.low is not None:
            checks.append((f"below_minimum:{f.name}", F.count_if(c < f.low)))
        if f.high is not None:
            checks.append((f"above_maximum:{f.name}", F.count_if(c > f.high)))
    for c in constants:
        # min and max differ, or a NULL is present
        checks.append((f"not_constant:{c}", F.when(~F.min(c).eqNullSafe(F.max(c)), F.count(F.lit(1))).otherwise(F.count_if(F.col(c).isNull()))))
    rows = _rows_from_aggregate(df, [(n, F.struct(v.alias("n"))) for n, v in checks], "check_name")
    return rows.unionByName(duplicate_keys(df, [*keys, index]).select(F.lit("duplicated_key_rows").alias("check_name"), F.col("extra_rows").alias("n")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys and of rows beyond the first per key (counts first, so a hot key is one row)."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"))


class ContractError(ValueError):
    """Raised with every violated check."""


def require_clean(checks: DataFrame) -> None:
    """Stop with all problems listed when a check table (check_name, n) has violations."""
    bad = checks.where("n > 0").orderBy("check_name").collect()
    if bad:
        raise ContractError("; ".join(f"{r['check_name']}: {r['n']}" for r in bad))


# ------------------------------------------------------------------ rule battery
@dataclass(frozen=True)
class Rule:
    """A coded check: rows for which ``predicate`` (SQL over the table) holds are findings."""

    id: str
    category: str
    severity: str
    title: str
    columns: tuple[str, ...]
    predicate: str
    denominator: str = "true"


def run_rules(df: DataFrame, rules: Sequence[Rule], min_cell: int = 1) -> DataFrame:
    """All rules in ONE aggregate; a rule whose columns are absent is NOT_APPLICABLE. Findings come with severity."""
    ready = [r for r in rules if set(r.columns) <= set(df.columns)]
    missing = [r for r in rules if r not in ready]
    rows = _rows_from_aggregate(df, [(r.id, F.struct(
        F.count_if(F.coalesce(F.expr(r.predicate), F.lit(False))).alias("n"), F.count_if(F.coalesce(F.expr(r.denominator), F.lit(False))).alias("rows"))) for r in ready], "rule_id")
    spark = df.sparkSession
    meta = spark.createDataFrame([(r.id, r.category, r.severity, r.title, "; ".join(r.columns)) for r in rules],
                                 "rule_id string, category string, severity string, title string, columns string")
    if missing:
        rows = rows.unionByName(spark.createDataFrame([(r.id, None, None) for r in missing], "rule_id string, n long, rows long"))
    n = F.col("n")
    status = F.when(n.isNull(), "NOT_APPLICABLE").when(n > 0, "FINDING").otherwise("PASS")
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return (rows.join(meta, "rule_id").withColumn("status", status)
            .select("rule_id", "category", F.when(F.col("status") == "FINDING", F.col("severity")).alias("severity"), "status", "title", "columns",
                    suppress.cell(n, min_cell).alias("n"), F.when(F.col("rows") > 0, 100.0 * suppress.cell(n, min_cell) / F.col("rows")).alias("pct"),
                    F.when(F.col("status") == "FINDING", order).otherwise(9).alias("severity_order")))


# Fixed values of the rules: their ids, categories, severities and titles
def contract_rules(contract: Contract, index: str) -> list[Rule]:
    """Rules that follow from the declarations alone: far and early dates, negative counts, lists, NOT NULL, sentinels."""
    out = []
    for r in contract.columns:
        if r.kind == "date":
            sent = ", ".join(f"DATE'{s}'" for s in r.sentinels)
            out.append(Rule(f"C01:{r.name}", "dates", "WARNING", "date before 1900", (r.name,), f"{r.name} < DATE'1900-01-01'"))
            out.append(Rule(f"C02:{r.name}", "dates", "WARNING", "undeclared far-future date", (r.name,),
                            f"{r.name} >= DATE'2100-01-01'" + (f" AND {r.name} NOT IN ({sent})" if sent else "")))
            if sent:
                out.append(Rule(f"C03:{r.name}", "dates", "INFO", "declared sentinel", (r.name,), f"{r.name} IN ({sent})"))
            if r.timing == "pre_index":
                out.append(Rule(f"C07:{r.name}", "temporal", "WARNING", "record on or after the index day", (r.name, index), f"{r.name} >= {index}", f"{r.name} IS NOT NULL"))
        if r.semantic == "count":
            out.append(Rule(f"D01:{r.name}", "numeric", "WARNING", "negative counter", (r.name,), f"{r.name} < 0"))
        if r.allowed:
            levels = ", ".join(f"'{a}'" for a in r.allowed)
            out.append(Rule(f"B03:{r.name}", "contract", "WARNING", "value outside the allowed list", (r.name,), f"CAST({r.name} AS STRING) NOT IN ({levels})", f"{r.name} IS NOT NULL"))
        if not r.nullable:
            out.append(Rule(f"B04:{r.name}", "contract", "WARNING", "NULL in a NOT NULL column", (r.name,), f"{r.name} IS NULL"))
    for name, value in contract.constants.items():
        out.append(Rule(f"G04:{name}", "provenance", "CRITICAL", "version is not constant", (name,), f"NOT (CAST({name} AS STRING) <=> '{value}')"))
    return out


def nested_windows_rule(id: str, columns: Sequence[str]) -> Rule:
    """A shorter window may not hold more events than a longer one."""
    return Rule(id, "consistency", "WARNING", "shorter window exceeds longer window", tuple(columns), " OR ".join(f"coalesce({a} > {b}, false)" for a, b in zip(columns, columns[1:])))


def days_rules(id: str, date: str, days: str, index: str) -> list[Rule]:
    """A day count must not be negative and must equal index minus date."""
    return [Rule(f"C04:{id}", "dates", "WARNING", "negative days since", (days,), f"{days} < 0"),
            Rule(f"C05:{id}", "dates", "INFO", "day count differs from index minus date", (days, date, index), f"{days} <> datediff({index}, {date})", f"{days} IS NOT NULL AND {date} IS NOT NULL"),
            Rule(f"E06:{id}", "consistency", "INFO", "date and day count are not NULL together", (date, days), f"({date} IS NULL) <> ({days} IS NULL)")]


def label_rules(y: str, event: str, days: str, index: str, end: str) -> list[Rule]:
    """Outcome contradictions."""
    return [Rule(f"F01:{y}", "outcome", "CRITICAL", "positive label without an event date", (y, event), f"{y} = 1 AND {event} IS NULL"),
            Rule(f"F02:{y}", "outcome", "CRITICAL", "negative label with an event date", (y, event), f"{y} = 0 AND {event} IS NOT NULL"),
            Rule(f"F04:{y}", "outcome", "INFO", "days to event differ from the dates", (days, event, index), f"{days} <> datediff({event}, {index})", f"{days} IS NOT NULL AND {event} IS NOT NULL"),
            Rule(f"C11:{y}", "outcome", "WARNING", "event outside its window", (event, index, end), f"{event} < {index} OR {event} > {end}")]


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Codes with several labels and labels with several codes; both must be 0."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    left = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n")).withColumn("direction", F.lit(f"{a}->{b}"))
    right = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n")).withColumn("direction", F.lit(f"{b}->{a}"))
    return left.unionByName(right)


def one_index_date(df: DataFrame, index: str) -> str:
    """The only index date of a table; several stop the job and are listed."""
    found = [r[0] for r in df.groupBy(index).count().orderBy(index).collect()]  # one row per date
    if len(found) != 1:
        raise ContractError(f"expected one index date, found {[str(d) for d in found]}")
    return str(found[0])


# ------------------------------------------------------------------ declarative mapping
def unmapped_values(df: DataFrame, recodes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(column_name, value, n) of every value that its column's recode table lacks."""
    return reduce(DataFrame.unionByName, [scalars.unmapped(df, c, m).withColumn("column_name", F.lit(c)) for c, m in recodes.items()])


def apply_mapping(df: DataFrame, rename: Mapping[str, str], recodes: Mapping[str, Mapping[str, str]], drop: Sequence[str] = ()) -> DataFrame:
    """Rename, recode and drop by declaration; undeclared or absent columns and unmapped values stop the job.

    The message lists the columns and how many values each lacks; ``unmapped_values`` gives the values.
    """
    known = set(rename) | set(drop)
    absent, extra = sorted(known - set(df.columns)), sorted(set(df.columns) - known)
    problems = [f"absent: {absent}"] if absent else []
    problems += [f"undeclared: {extra}"] if extra else []
    if not problems and recodes:
        per_column = unmapped_values(df, recodes).groupBy("column_name").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.min("value").alias("first"))
        problems += [f"{r['column_name']}={r['first']} and {r['values'] - 1} more unmapped values ({r['n']} rows)" for r in per_column.orderBy("column_name").collect()]
    if problems:
        raise ContractError("; ".join(problems))
    return df.select(*[(scalars.recode(s, recodes[s]) if s in recodes else F.col(s)).alias(t) for s, t in rename.items()])
