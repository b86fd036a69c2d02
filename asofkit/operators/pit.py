"""Point-in-time derivation: one row per (entity_id, index_date) from event tables.

Prediction is made at the start of the index day. A record counts only when it
happened and was known before that day; outcome events count from the index day on.

Canonical tables
    persons        entity_id, birth_date, sex, site, death_date, start_date, end_date (one row per membership interval)
    conditions     entity_id, feature, record_date, available_date
    prescriptions  entity_id, item, chapter, is_drug, record_date, available_date
    measurements   entity_id, kind, value, record_date, available_date
    lifestyle      entity_id, kind, value, units, record_date, available_date
    encounters     entity_id, encounter_id, encounter_type, admission_method, spell_start_date, event_date,
                   code, position, code_system

Every feature is one or two grouped aggregates over the usable pairs, so partial
aggregation runs before each shuffle. The join of index rows to records has two levels:
entities with many records are found by a sketch, their records are dealt to pieces by a
hash of the whole record, and their index rows are copied to every piece. The join is on
(entity, piece), so an entity with any share of the records never has to fit into one task,
and each aggregate above it combines inside its piece before it is shuffled. The first and
last index date, two numbers, become date bounds on the records' scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import dates
from asofkit.operators.contracts import require_clean
from asofkit.session import cut_lineage

ROW = ["entity_id", "index_date"]

# Fixed values of the rules.
SEXES = ("female", "male")
ELIGIBILITY_REASONS = ("missing_person_record", "missing_date_of_birth", "invalid_sex", "died_before_index",
                       "not_member_at_index", "age_below_minimum")
SMOKING_LEVELS = ("never", "ex", "current")
ALCOHOL_LEVELS = ("zero", "lower_risk", "previous_higher_risk_or_harmful", "higher_risk", "harmful")
OUTCOME_STATUSES = ("icd9cm_review_not_counted", "icd9cm_excluded_code", "icd10cm_excluded_7th_character",
                    "encounter_type_not_qualifying", "spell_started_before_index", "unknown_admission_method",
                    "admission_not_non_elective", "position_rule")
NON_ELECTIVE = ("emergency", "urgent", "via_ed")


@dataclass(frozen=True)
class WindowRule:
    """Look-back rule of one binary feature; ``None`` means complete history."""

    feature: str
    lookback_years: int | None = None
    lookback_days: int | None = None
    age_at_record_min: float | None = None
    resolved_by: tuple[str, ...] = ()

    def inside(self) -> Column:
        keep = F.lit(True)
        if self.lookback_years is not None or self.lookback_days is not None:
            keep = F.col("record_date") >= dates.window_start("index_date", years=self.lookback_years, days=self.lookback_days)
        if self.age_at_record_min is not None:
            keep = keep & (dates.decimal_age("birth_date", "record_date") >= self.age_at_record_min)
        return keep


@dataclass(frozen=True)
class ReadingRule:
    """A feature is evident when one criterion has at least ``min_readings`` readings; criteria are not mixed."""

    feature: str
    min_readings: int
    criteria: tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class SexCutRule:
    """Evidence is a value below a sex-specific cut, unless a normal reading came strictly later."""

    feature: str
    kind: str
    below: Mapping[str, float]


@dataclass(frozen=True)
class OutcomeRules:
    days: int | None = 180
    years: int | None = None
    non_elective_only: bool = True
    unknown_method_excluded: bool = True
    exclude_earlier_spells: bool = True
    principal_or_external: bool = True


@dataclass(frozen=True)
class DerivationRules:
    age_min: float = 65.0
    lag_days: int = 0
    undeclared: frozenset[str] = frozenset()
    item_window_days: int = 120
    excluded_chapters: tuple[int, ...] = ()
    body_window_years: int = 5
    body_range: tuple[float, float] = (10.0, 80.0)
    pair_gap_days: int = 30
    alcohol_window_years: int = 5
    windows: tuple[WindowRule, ...] = ()
    readings: tuple[ReadingRule, ...] = ()
    sex_cuts: tuple[SexCutRule, ...] = ()
    outcome: OutcomeRules = field(default_factory=OutcomeRules)


# ------------------------------------------------------------------ input checks
def overlapping_intervals(intervals: DataFrame, order: Sequence[str] = ("start_date", "end_date")) -> DataFrame:
    """Intervals with ``overlaps``: the one before, in order, is open or ends on or after this one's start."""
    w = Window.partitionBy("entity_id").orderBy(*order)
    prev = F.lag("end_date").over(w)
    return intervals.withColumn("overlaps", (F.row_number().over(w) > 1) & (prev.isNull() | (F.col("start_date") <= prev)))


PERSON_FACTS = ("birth_date", "sex", "death_date")


def input_problems(tables: Mapping[str, DataFrame], index: DataFrame) -> DataFrame:
    """(check_name, n) of everything that a derivation refuses: one row per check, 0 where all is well.

    Index: NULL keys, repeated rows. Persons: NULL keys or starts, ends before starts, overlapping intervals, persons whose
    facts vary between their intervals. Event tables: NULL keys or dates, records that are available before they were made.
    """
    persons = tables["persons"]
    rows = index.groupBy("entity_id", "index_date").agg(F.count(F.lit(1)).alias("_n"))
    facts = persons.groupBy("entity_id").agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in PERSON_FACTS])
    parts = [
        rows.agg(F.coalesce(F.sum(F.when(F.col("entity_id").isNull() | F.col("index_date").isNull(), F.col("_n"))), F.lit(0)).alias("index_null_key"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("index_repeated")),
        overlapping_intervals(persons).agg(
            F.count_if(F.col("entity_id").isNull() | F.col("start_date").isNull()).alias("persons_null_key"),
            F.count_if(F.col("end_date") < F.col("start_date")).alias("persons_end_before_start"), F.count_if("overlaps").alias("persons_overlapping")),
        facts.agg(*[F.count_if(F.col(f) > 1).alias(f"persons_varying_{f}") for f in PERSON_FACTS]),
    ]
    for name, t in tables.items():
        if name != "persons":
            date = "record_date" if "record_date" in t.columns else "event_date"
            checks = [F.count_if(F.col("entity_id").isNull() | F.col(date).isNull()).alias(f"{name}_null_key")]
            if "available_date" in t.columns:
                checks.append(F.count_if(F.col("available_date") < F.col(date)).alias(f"{name}_available_before_record"))
            parts.append(t.agg(*checks))
    each = lambda p: p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("n")) for c in p.columns])).alias("e")).select("e.*")
    return reduce(DataFrame.unionByName, [each(p) for p in parts])


def derive_checked(tables: Mapping[str, DataFrame], index: DataFrame, code_rules: DataFrame, code_lengths: Sequence[int], rules: DerivationRules) -> DataFrame:
    """``derive`` that stops with the full list of input problems first."""
    require_clean(input_problems(tables, index))
    return derive(tables, index, code_rules, code_lengths, rules)


# ------------------------------------------------------------------ joins by entity
HOT = 1000  # an entity with at least 1/HOT of the records is dealt to pieces of that size, so there are HOT such entities at most
SKETCH = 10_000  # counters of the frequent-items sketch; it names every entity with more than 1.4/SKETCH of the records


def hot_entities(*tables: DataFrame, share: int = HOT) -> DataFrame:
    """(entity_id, _pieces) of the entities that hold many of the tables' records, by one pass with a sketch and no shuffle."""
    keys = reduce(DataFrame.unionByName, [t.select("entity_id") for t in tables]).where("entity_id IS NOT NULL")
    found = keys.agg(F.expr(f"approx_top_k(entity_id, {share}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    rows = [(r["item"], -(-r["count"] * share // found["n"])) for r in found["top"] or () if r["count"] * share >= found["n"]]
    return keys.sparkSession.createDataFrame(rows, f"entity_id {keys.schema['entity_id'].dataType.simpleString()}, _pieces long")


def entity_join(rows: DataFrame, records: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``records`` by entity, pieces of hot entities in different tasks.

    Pairs of one row may come from several tasks, so what is made of them must be aggregated once more; with
    ``how`` "left", a row may also have a pair without a record beside its real ones.
    """
    pieces = F.coalesce("_pieces", F.lit(1))
    few = F.broadcast(hot)  # HOT rows at most
    left = rows.join(few, "entity_id", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("_pieces")
    right = records.join(few, "entity_id", "left").withColumn("_piece", F.pmod(F.xxhash64(*records.columns), pieces)).drop("_pieces")
    return left.join(right, ["entity_id", "_piece"], how).drop("_piece")


FILTER_BITS = 24  # places of the entity filter: 2 MB, however many entities there are


def of_entities(records: Mapping[str, DataFrame], rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The records without most of those that have no row to meet, and their hot entities.

    A filter of fixed size over the rows' entities; what passes by chance finds no row in the join. As a condition on the entity alone it
    moves down to the scan that has it, so such records are not shuffled, neither for a join that makes the record nor for the one with
    the rows. ``rows`` are read once more; the driver sees 2^(FILTER_BITS - 6) words at most.
    """
    place = F.pmod(F.xxhash64("entity_id"), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
    words = [0] * (1 << (FILTER_BITS - 6))
    for r in rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toLocalIterator():
        words[r["w"]] = r["b"]
    kept = rows.sparkSession.createDataFrame([(words,)], "words array<long>").scalar()
    word = F.get(kept, F.shiftright(place, 6).cast("int"))
    listed = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    same = rows.schema["entity_id"].dataType
    met = {name: t.where(listed) if t.schema["entity_id"].dataType == same else t for name, t in records.items()}
    return met, hot_entities(*met.values())


def prepared_rows(rows: DataFrame) -> DataFrame:
    """Index rows written once, for all the tables they are joined to."""
    return cut_lineage(rows)


def oldest_window(windows: Sequence[WindowRule]) -> Column | None:
    """Start of the longest look-back window as a function of ``index_date``; None where one of them is complete history."""
    starts = []
    for w in windows:
        if w.lookback_years is None and w.lookback_days is None:
            return None
        starts.append(dates.window_start("index_date", years=w.lookback_years, days=w.lookback_days))
    return F.least(*starts) if len(starts) > 1 else starts[0]


def within(records: DataFrame, rows: DataFrame, *, since: Column | None = None, until: Column | None = None, date_column: str = "record_date") -> DataFrame:
    """Records that any row can use: from the first row's ``since`` to before (with ``until``: up to) the last row's date.

    The bounds are literals, so they reach the scan of a table that is stored by date.
    """
    until_ = F.col("index_date") if until is None else until
    first, last = rows.agg(F.min(F.lit(None).cast("date") if since is None else since), F.max(until_)).first()
    if last is None:
        return records.where(F.lit(False))
    day = F.col(date_column)
    kept = records.where(day < F.lit(last) if until is None else day <= F.lit(last))
    return kept if first is None else kept.where(day >= F.lit(first))


# ------------------------------------------------------------------ rows
def as_of_membership(index: DataFrame, persons: DataFrame) -> DataFrame:
    """LEFT join of index rows to intervals; the covering interval wins, else the earliest one with ``covers`` false.

    One grouped ``max_by`` instead of a ranking window: it combines before the shuffle.
    """
    attrs = [c for c in persons.columns if c != "entity_id"]
    covers = dates.covers("start_date", "end_date", "index_date")
    return (
        entity_join(index, persons.withColumn("_known", F.lit(True)), hot_entities(persons), "left")
        .withColumn("_covers", F.coalesce(covers, F.lit(False)))
        .groupBy(*ROW)
        .agg(F.max_by(F.struct("_known", "_covers", *attrs),
                      F.struct(F.col("_covers"), F.col("_known").isNotNull(), F.col("start_date").isNotNull(), -F.unix_date("start_date"), -F.coalesce(F.unix_date("end_date"), F.lit(2**30)),
                               F.xxhash64(*attrs))).alias("m"))
        .select(*ROW, F.col("m._known").isNotNull().alias("has_person"), F.col("m._covers").alias("covers"),
                *[F.col(f"m.{a}").alias(a) for a in attrs])
    )


def eligibility(index: DataFrame, persons: DataFrame, age_min: float) -> DataFrame:
    """As-of rows with decimal age and the FIRST failing reason (NULL = eligible)."""
    rows = as_of_membership(index, persons).withColumn("age", dates.decimal_age("birth_date", "index_date"))
    tests = [
        ~F.col("has_person"),
        F.col("birth_date").isNull(),
        ~F.coalesce(F.col("sex").isin(*SEXES), F.lit(False)),
        F.coalesce(F.col("death_date") < F.col("index_date"), F.lit(False)),
        ~F.col("covers"),
        ~F.coalesce(F.col("age") >= age_min, F.lit(False)),
    ]
    return rows.withColumn("exclusion_reason", first_match(tests, ELIGIBILITY_REASONS))


def first_match(tests: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the first true test, NULL when none is."""
    chain = None
    for test, label in zip(tests, labels, strict=True):
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def eligible_rows(index: DataFrame, persons: DataFrame, age_min: float) -> DataFrame:
    return eligibility(index, persons, age_min).where("exclusion_reason IS NULL")


# ------------------------------------------------------------------ records
def record_pairs(rows: DataFrame, records: DataFrame, *, declared: bool = True, lag_days: int = 0, hot: DataFrame | None = None) -> DataFrame:
    """Index rows x records of the same entity with the first reason a record may not be used (NULL = usable)."""
    keep = [c for c in ("birth_date", "sex") if c in rows.columns]
    if hot is None:
        found, hot = of_entities({"records": records}, rows)
        records = found["records"]
    pairs = entity_join(rows.select(*ROW, *keep), records, hot)
    on_after = F.col("record_date") >= F.col("index_date")
    late = F.coalesce(F.col("available_date") >= F.col("index_date"), F.lit(False))
    reason = F.when(on_after, "record_on_or_after_index")
    if not declared:
        reason = reason.when(F.col("record_date") >= F.date_sub("index_date", lag_days), "within_unknown_availability_lag")
    return pairs.withColumn("reject_reason", reason.when(late, "available_on_or_after_index"))


def usable_records(rows: DataFrame, records: DataFrame, *, declared: bool = True, lag_days: int = 0, since: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The pairs a feature may read. The same conditions, as join predicates: no rejected pair leaves the join.

    ``since`` (a date as a function of ``index_date``) says that older records are of no use to the caller. ``rows`` are read twice.
    """
    near = within(records, rows, since=since)
    pairs = record_pairs(rows, near, declared=declared, lag_days=lag_days, hot=hot).where("reject_reason IS NULL").drop("reject_reason")
    return pairs if since is None else pairs.where(F.col("record_date") >= since)


def rejection_counts(pairs: Mapping[str, DataFrame]) -> DataFrame:
    """Rejected pairs per table and reason."""
    parts = [p.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(t).alias("table_name"), F.col("reject_reason").alias("reason"), "n") for t, p in pairs.items()]
    return reduce(DataFrame.unionByName, parts)


def derivation_counters(rows: DataFrame, tables: Mapping[str, DataFrame], rules: DerivationRules) -> DataFrame:
    """(table_name, counter, n): what became of every pair of an eligible row and a record of its entity, each counted once.

    First the reasons for which a record may not be used at all, then ``not_declared`` (no rule reads this feature, kind or item),
    ``outside_window`` (no window of its rules reaches it), ``value_unusable`` (out of range or no known level), else ``used``: the
    pairs that the features and ``max_record_date`` of ``derive`` come from. Counters of a table add up to its pairs.
    One join and one small aggregate a table. Records of the outcome are counted by ``outcome_audit``.
    """
    labels = {"conditions": _condition_tests, "prescriptions": _prescription_tests, "measurements": _measurement_tests, "lifestyle": _lifestyle_tests}
    met, hot = of_entities({name: tables[name] for name in labels}, rows)
    parts = []
    for name, tests in labels.items():
        pairs = record_pairs(rows, met[name], declared=name not in rules.undeclared, lag_days=rules.lag_days, hot=hot)
        known, inside, sound = (F.coalesce(c, F.lit(False)) for c in tests(rules))
        found = F.coalesce("reject_reason", first_match([~known, ~inside, ~sound], ["not_declared", "outside_window", "value_unusable"]), F.lit("used"))
        parts.append(pairs.groupBy(found.alias("counter")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "counter", "n"))
    return reduce(DataFrame.unionByName, parts)


def _any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def _condition_tests(rules: DerivationRules) -> tuple[Column, Column, Column]:
    """Whether a rule reads the record, whether a window of such a rule reaches it, and whether its value is usable."""
    return F.col("feature").isin(*[w.feature for w in rules.windows]), _any_of([(F.col("feature") == w.feature) & w.inside() for w in rules.windows]), F.lit(True)


def _prescription_tests(rules: DerivationRules) -> tuple[Column, Column, Column]:
    counted = F.col("is_drug")
    if rules.excluded_chapters:
        counted = counted & ~F.col("chapter").isin(*rules.excluded_chapters)
    return counted, F.col("record_date") >= dates.window_start("index_date", days=rules.item_window_days), F.lit(True)


def _measurement_tests(rules: DerivationRules) -> tuple[Column, Column, Column]:
    by_name = {w.feature: w for w in rules.windows}
    kind = F.col("kind")
    reads = [(kind.isin("bmi", "weight_kg", "height_m"), F.col("record_date") >= dates.window_start("index_date", years=rules.body_window_years))]
    reads += [(kind.isin(*sorted({k for k, _, _ in r.criteria})), by_name[r.feature].inside()) for r in rules.readings]
    reads += [(kind == r.kind, by_name[r.feature].inside()) for r in rules.sex_cuts]
    sound = F.col("value").isNotNull() & ((kind != "bmi") | F.col("value").between(*rules.body_range))
    return _any_of([k for k, _ in reads]), _any_of([k & i for k, i in reads]), sound


def _lifestyle_tests(rules: DerivationRules) -> tuple[Column, Column, Column]:
    kind = F.col("kind")
    inside = (kind == "smoking") | (F.col("record_date") >= dates.window_start("index_date", years=rules.alcohol_window_years))
    sound = F.when(kind == "smoking", F.col("value").isin(*SMOKING_LEVELS)).when(kind == "alcohol", F.col("value").isin(*ALCOHOL_LEVELS)).otherwise(F.col("units").isNotNull())
    return kind.isin("smoking", "alcohol", "alcohol_units_week"), inside, sound


def latest_evidence(used: Sequence[DataFrame]) -> DataFrame:
    """Latest record date per row over every record that entered a derivation."""
    return (reduce(DataFrame.unionByName, [u.select(*ROW, "record_date") for u in used])
            .groupBy(*ROW).agg(F.max("record_date").alias("max_record_date")))


# ------------------------------------------------------------------ features
def distinct_items(pairs: DataFrame, *, window_days: int, excluded_chapters: Sequence[int] = ()) -> DataFrame:
    """Distinct items with index - W <= record < index; drugs only, some chapters excluded."""
    keep = drug_in_window(window_days, excluded_chapters)
    return pairs.where(keep).groupBy(*ROW).agg(F.count_distinct("item").alias("item_count"))


def drug_in_window(window_days: int, excluded_chapters: Sequence[int]) -> Column:
    drug = F.col("is_drug")
    if excluded_chapters:
        drug = drug & ~F.col("chapter").isin(*excluded_chapters)
    return (F.col("record_date") >= dates.window_start("index_date", days=window_days)) & drug


def latest_day_mean(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """Mean of ``value`` on the latest record day per row: per-day sums, then the latest day's pair."""
    days = pairs.groupBy(*ROW, "record_date").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return (days.groupBy(*ROW).agg(F.max_by(F.struct("_s", "_n"), "record_date").alias("d"))
            .select(*ROW, F.try_divide("d._s", "d._n").alias(name)))


def nearest_match(pairs: DataFrame, left_kind: str, right_kind: str, gap_days: int) -> DataFrame:
    """Each left reading with its nearest right reading within ``gap_days``; a tie takes the later one.

    No pair list is built. Days are cut into slices as long as the gap; right readings are
    copied into the neighbouring slices, so the nearest one before and after each left
    reading is found by two running windows inside (row, slice). Same-day right readings
    of a row count once, by their largest value.
    """
    day = F.unix_date("record_date")
    left = (pairs.where(F.col("kind") == left_kind)
            .select(*ROW, "record_date", "value", F.floor(day / gap_days).alias("_slice"), F.lit(None).cast("double").alias("_rv")))
    right = (pairs.where(F.col("kind") == right_kind).groupBy(*ROW, "record_date").agg(F.max("value").alias("_rv"))
             .withColumn("_home", F.floor(day / gap_days))
             .select(*ROW, "record_date", F.lit(None).cast("double").alias("value"),
                     F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)).alias("_slice"), "_rv"))
    r = F.when(F.col("_rv").isNotNull(), F.struct(F.col("record_date").alias("d"), F.col("_rv").alias("v")))
    order = Window.partitionBy(*ROW, "_slice").orderBy("record_date")
    back = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = (left.unionByName(right)
            .withColumn("_prev", F.last(r, ignorenulls=True).over(back))
            .withColumn("_next", F.first(r, ignorenulls=True).over(ahead))
            .where("value IS NOT NULL"))
    gap_prev = F.date_diff("record_date", F.col("_prev.d"))
    gap_next = F.date_diff(F.col("_next.d"), "record_date")
    ok_prev, ok_next = F.coalesce(gap_prev <= gap_days, F.lit(False)), F.coalesce(gap_next <= gap_days, F.lit(False))
    pick = (F.when(ok_next & (~ok_prev | (gap_next <= gap_prev)), F.col("_next"))
            .when(ok_prev, F.col("_prev")))
    return (both.withColumn("_m", pick).where("_m IS NOT NULL")
            .select(*ROW, "record_date", "value", F.col("_m.d").alias("match_date"), F.col("_m.v").alias("match_value")))


def body_index(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    """Recorded value on the latest valid day, else computed from the latest weight with a near height."""
    lo, hi = rules.body_range
    win = body_window(pairs, rules)
    recorded = latest_day_mean(win.where((F.col("kind") == "bmi") & F.col("value").between(lo, hi)), "value", "recorded")
    return (recorded.join(_matched_index(win, rules), ROW, "full")
            .select(*ROW, F.coalesce("recorded", "computed").alias("body_index")))


def body_window(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    return pairs.where((F.col("record_date") >= dates.window_start("index_date", years=rules.body_window_years))
                       & F.col("kind").isin("bmi", "weight_kg", "height_m"))


def level_rank(col: str, levels: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)) - 1


def level_name(rank: Column, levels: Sequence[str]) -> Column:
    # element_at over a literal array reads a NULL index as -1, so NULL is kept apart.
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in levels]), (rank + 1).cast("int")))


def latest_status(pairs: DataFrame) -> DataFrame:
    """Last smoking level by (date, rank); 'never' after any other record becomes 'ex'."""
    sm = pairs.where(F.col("kind") == "smoking").withColumn("_rank", level_rank("value", SMOKING_LEVELS))
    return (sm.groupBy(*ROW)
            .agg(F.max_by("value", F.struct("record_date", "_rank")).alias("_last"), F.max(F.col("value") != "never").alias("_ever"))
            .select(*ROW, F.when((F.col("_last") == "never") & F.col("_ever"), "ex").otherwise(F.col("_last")).alias("smoking_status")))


def unit_level_rank(units: Column) -> Column:
    """Weekly units to a level: 0 zero, (0, 21) lower, [21, 49) higher, 49 and more harmful."""
    return F.when(units == 0, 0).when(units < 21, 1).when(units < 49, 3).otherwise(4)


def highest_level(pairs: DataFrame, window_years: int) -> DataFrame:
    """Highest level in the window; a coded level replaces units recorded the same day.

    The same-day anti join is a grouped choice per (row, day): no second pass over the records.
    """
    al = alcohol_window(pairs, window_years)
    coded = F.when(F.col("kind") == "alcohol", level_rank("value", ALCOHOL_LEVELS))
    units = F.when(F.col("kind") == "alcohol_units_week", unit_level_rank(F.col("units")))
    per_day = al.groupBy(*ROW, "record_date").agg(F.max(coded).alias("_c"), F.max(units).alias("_u"))
    return (per_day.groupBy(*ROW).agg(F.max(F.coalesce("_c", "_u")).alias("_r"))
            .select(*ROW, level_name(F.col("_r"), ALCOHOL_LEVELS).alias("alcohol_level")))


def alcohol_window(pairs: DataFrame, window_years: int) -> DataFrame:
    return pairs.where(F.col("kind").isin("alcohol", "alcohol_units_week")
                       & (F.col("record_date") >= dates.window_start("index_date", years=window_years)))


def same_day_anti(units: DataFrame, coded: DataFrame) -> DataFrame:
    """Unit records without a coded record on the same (row, day)."""
    return units.join(coded.select(*ROW, "record_date").distinct(), [*ROW, "record_date"], "left_anti")


# ------------------------------------------------------------------ binary features
_COMPARE = {"<": lambda c, t: c < t, "<=": lambda c, t: c <= t, ">": lambda c, t: c > t, ">=": lambda c, t: c >= t}


def condition_evidence(conditions: DataFrame, windows: Sequence[WindowRule]) -> DataFrame:
    """Coded evidence inside each feature's own window: (row, feature, record_date)."""
    keep = reduce(lambda acc, w: acc.when(F.col("feature") == w.feature, w.inside()),
                  windows[1:], F.when(F.col("feature") == windows[0].feature, windows[0].inside()))
    return conditions.where(F.coalesce(keep, F.lit(False))).select(*ROW, "feature", "record_date")


def reading_evidence(measurements: DataFrame, rule: ReadingRule, window: WindowRule) -> DataFrame:
    """Latest qualifying reading date per row where a criterion has enough qualifying readings."""
    flags = [(F.col("kind") == kind) & _COMPARE[op](F.col("value"), cut) for kind, op, cut in rule.criteria]
    kinds = sorted({kind for kind, _, _ in rule.criteria})
    aggs = []
    for i, f in enumerate(flags):
        aggs += [F.count_if(f).alias(f"_n{i}"), F.max(F.when(f, F.col("record_date"))).alias(f"_d{i}")]
    # One branch per criterion, kept only with enough readings; greatest() skips NULL but needs two arguments.
    latest = [F.when(F.col(f"_n{i}") >= rule.min_readings, F.col(f"_d{i}")) for i in range(len(flags))]
    return (measurements.where(F.col("kind").isin(*kinds) & window.inside()).groupBy(*ROW).agg(*aggs)
            .withColumn("record_date", F.greatest(*latest, F.lit(None).cast("date")))
            .where("record_date IS NOT NULL").select(*ROW, F.lit(rule.feature).alias("feature"), "record_date"))


def sex_cut_evidence(measurements: DataFrame, rule: SexCutRule, window: WindowRule) -> DataFrame:
    """Low readings by sex; a row whose last normal reading is later than its last low one gives none."""
    cut = F.coalesce(*[F.when(F.col("sex") == s, F.lit(v)) for s, v in rule.below.items()])
    low = F.col("value") < cut
    return (measurements.where((F.col("kind") == rule.kind) & window.inside()).groupBy(*ROW)
            .agg(F.max(F.when(low, F.col("record_date"))).alias("record_date"),
                 F.max(F.when(~low, F.col("record_date"))).alias("_normal"))
            .where("record_date IS NOT NULL AND NOT coalesce(_normal > record_date, false)")
            .select(*ROW, F.lit(rule.feature).alias("feature"), "record_date"))


def evidence(conditions: DataFrame, measurements: DataFrame, rules: DerivationRules) -> DataFrame:
    by_name = {w.feature: w for w in rules.windows}
    parts = [condition_evidence(conditions, rules.windows)]
    parts += [reading_evidence(measurements, r, by_name[r.feature]) for r in rules.readings]
    parts += [sex_cut_evidence(measurements, r, by_name[r.feature]) for r in rules.sex_cuts]
    return reduce(DataFrame.unionByName, parts)


def pivot_evidence(ev: DataFrame, windows: Sequence[WindowRule]) -> DataFrame:
    """One 0/1 column per feature; a resolving feature dated on or after the resolved one clears it."""
    latest = ev.groupBy(*ROW).agg(*[F.max(F.when(F.col("feature") == w.feature, F.col("record_date"))).alias(w.feature) for w in windows])
    out = []
    for w in windows:
        on = F.col(w.feature).isNotNull()
        if w.resolved_by:
            resolver = F.greatest(*[F.col(r) for r in w.resolved_by], F.lit(None).cast("date"))
            on = on & ~F.coalesce(resolver >= F.col(w.feature), F.lit(False))
        out.append(on.cast("int").alias(w.feature))
    return latest.select(*ROW, *out)


# ------------------------------------------------------------------ outcome
def longest_prefix(codes: DataFrame, code: str, rules: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Each row with the rule of the LONGEST matching prefix; rows without a match are dropped.

    Distinct codes are matched, not rows: each code explodes into its prefixes of the rule
    lengths, which join the rule table on equality, and ``max_by`` keeps the longest.
    """
    attrs = [c for c in rules.columns if c != "prefix"]
    heads = (codes.select(code).distinct()
             .withColumn("prefix", F.explode(F.array_distinct(F.array(*[F.substring(code, 1, n) for n in sorted(set(lengths))])))))
    best = (heads.join(rules, "prefix").groupBy(code)
            .agg(F.max_by(F.struct("prefix", *attrs), F.length("prefix")).alias("r"))
            .select(code, "r.prefix", *[f"r.{a}" for a in attrs]))
    return codes.join(best, code)


def outcome_pairs(rows: DataFrame, encounters: DataFrame, rules: OutcomeRules, hot: DataFrame | None = None) -> DataFrame:
    """Encounters of the row's entity with index <= event <= window end."""
    end = dates.window_end("index_date", years=rules.years, days=rules.days)
    near = within(encounters, rows, since=F.col("index_date"), until=end, date_column="event_date")
    if hot is None:
        found, hot = of_entities({"encounters": near}, rows)
        near = found["encounters"]
    pairs = entity_join(rows.select(*ROW).withColumn("window_end", end), near, hot)
    return pairs.where(F.col("event_date").between(F.col("index_date"), F.col("window_end")))


def outcome_status(pairs: DataFrame, rules: OutcomeRules) -> DataFrame:
    """First matching disqualifier of each code-matched pair, else ``qualifying``."""
    admission = F.col("encounter_type") == "hospital_admission"
    method = F.col("admission_method")
    tests = [
        F.col("code_status") == "REVIEW",
        F.col("code_status") == "EXCLUDE",
        (F.col("code_system") == "ICD-10-CM") & (F.length("code") == 7) & ~F.substring("code", 7, 1).isin("A", "B", "C"),
        F.col("encounter_type") == "other",
        F.lit(rules.exclude_earlier_spells) & F.coalesce(F.col("spell_start_date") < F.col("index_date"), F.lit(False)),
        F.lit(rules.non_elective_only and rules.unknown_method_excluded) & admission & method.isNull() & (F.col("code_status") == "CANDIDATE"),
        F.lit(rules.non_elective_only) & admission & method.isNotNull() & ~method.isin(*NON_ELECTIVE),
        F.lit(rules.principal_or_external) & (F.col("kind") == "fracture") & (F.col("position") != 1),
    ]
    return pairs.withColumn("status", F.coalesce(first_match(tests, OUTCOME_STATUSES), F.lit("qualifying")))


def first_event(statused: DataFrame) -> DataFrame:
    return (statused.where("status = 'qualifying'").groupBy(*ROW).agg(F.min("event_date").alias("first_event_date")))


def outcome_audit(statused: DataFrame) -> DataFrame:
    """Record counts by the audit attributes; position becomes principal / secondary, a missing method 'unknown'."""
    return (statused.withColumn("position", F.when(F.col("position") == 1, "principal").otherwise("secondary"))
            .withColumn("admission_method", F.coalesce("admission_method", F.lit("unknown")))
            .groupBy("code_system", "code_block", "kind", "code_status", "encounter_type", "admission_method", "position", "status")
            .agg(F.count(F.lit(1)).alias("n_records")))


# ------------------------------------------------------------------ whole derivation
def derive(tables: Mapping[str, DataFrame], index: DataFrame, code_rules: DataFrame, code_lengths: Sequence[int],
           rules: DerivationRules) -> DataFrame:
    """All parts joined on the row key: keys, latest evidence date, outcome, predictors, follow-up end.

    Eligible rows are written once. Each event table is joined to them once and reduced in one chain of
    aggregates that gives all its features together with the latest date it used. The parts are then
    joined on the row key they are already partitioned by.
    """
    rows = prepared_rows(eligible_rows(index, tables["persons"], rules.age_min))
    met, hot = of_entities({name: t for name, t in tables.items() if name != "persons"}, rows)
    since = {"prescriptions": dates.window_start("index_date", days=rules.item_window_days), "conditions": oldest_window(rules.windows)}

    def pairs(name: str) -> DataFrame:
        return usable_records(rows, met[name], declared=name not in rules.undeclared, lag_days=rules.lag_days, since=since.get(name), hot=hot)

    meas = pairs("measurements")
    enc = longest_prefix(outcome_pairs(rows, met["encounters"], rules.outcome, hot), "code", code_rules, code_lengths)
    parts = [
        _condition_part(pairs("conditions"), rules), _prescription_part(pairs("prescriptions"), rules), _measurement_part(meas, rules),
        _matched_index(body_window(meas, rules), rules), _lifestyle_part(pairs("lifestyle"), rules), first_event(outcome_status(enc, rules.outcome)),
    ]
    out = reduce(lambda acc, part: acc.join(part, ROW, "left"), parts, rows)
    coded = {w.feature for w in rules.windows}
    measured = {r.feature for r in (*rules.readings, *rules.sex_cuts)}
    none = F.lit(None).cast("date")
    latest = {f: F.greatest(F.col(f"_c_{f}"), F.col(f"_m_{f}") if f in measured else none, none) for f in coded}
    end = dates.window_end("index_date", years=rules.outcome.years, days=rules.outcome.days)
    return out.select(
        *ROW, F.greatest("_cond_date", "_rx_date", "_meas_date", "_life_date").alias("max_record_date"),
        F.col("first_event_date").isNotNull().cast("int").alias("outcome"), "first_event_date",
        "age", "sex", "site", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("recorded", "computed").alias("body_index"),
        "smoking_status", "alcohol_level", *[_resolved(w, latest).alias(w.feature) for w in rules.windows],
        F.least("death_date", "end_date", end).alias("followup_end_date"),
    )


def _resolved(w: WindowRule, latest: Mapping[str, Column]) -> Column:
    on = latest[w.feature].isNotNull()
    if w.resolved_by:
        resolver = F.greatest(*[latest[r] for r in w.resolved_by], F.lit(None).cast("date"))
        on = on & ~F.coalesce(resolver >= latest[w.feature], F.lit(False))
    return on.cast("int")


def _condition_part(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    """Latest coded date per feature and over all of them."""
    hits = {w.feature: (F.col("feature") == w.feature) & w.inside() for w in rules.windows}
    out = pairs.groupBy(*ROW).agg(*[F.max(F.when(h, F.col("record_date"))).alias(f"_c_{f}") for f, h in hits.items()])
    return out.withColumn("_cond_date", F.greatest(*[F.col(f"_c_{f}") for f in hits], F.lit(None).cast("date")))


def _prescription_part(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    keep = drug_in_window(rules.item_window_days, rules.excluded_chapters)
    return pairs.where(keep).groupBy(*ROW).agg(F.count_distinct("item").alias("item_count"), F.max("record_date").alias("_rx_date"))


def _measurement_part(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    """Recorded index, reading rules, sex cuts and the latest used date, from per-day sums."""
    by_name = {w.feature: w for w in rules.windows}
    lo, hi = rules.body_range
    body = (F.col("record_date") >= dates.window_start("index_date", years=rules.body_window_years)) & F.col("kind").isin("bmi", "weight_kg", "height_m")
    valid = body & (F.col("kind") == "bmi") & F.col("value").between(lo, hi)
    used = body
    daily: list[Column] = [F.sum(F.when(valid, F.col("value"))).alias("_s"), F.count_if(valid).alias("_n")]
    final: list[Column] = []
    outs: list[Column] = []
    for r in rules.readings:
        inside = by_name[r.feature].inside()
        used = used | (F.col("kind").isin(*sorted({k for k, _, _ in r.criteria})) & inside)
        for i, (kind, op, cut) in enumerate(r.criteria):
            n = f"_r_{r.feature}_{i}"
            daily.append(F.count_if((F.col("kind") == kind) & inside & _COMPARE[op](F.col("value"), cut)).alias(n))
            final += [F.sum(n).alias(f"{n}_n"), F.max(F.when(F.col(n) > 0, F.col("record_date"))).alias(f"{n}_d")]
        enough = [F.when(F.col(f"_r_{r.feature}_{i}_n") >= r.min_readings, F.col(f"_r_{r.feature}_{i}_d")) for i in range(len(r.criteria))]
        outs.append(F.greatest(*enough, F.lit(None).cast("date")).alias(f"_m_{r.feature}"))
    for r in rules.sex_cuts:
        inside = (F.col("kind") == r.kind) & by_name[r.feature].inside()
        used = used | inside
        low = F.col("value") < F.coalesce(*[F.when(F.col("sex") == s, F.lit(v)) for s, v in r.below.items()])
        daily += [F.max(inside & low).alias(f"_l_{r.feature}"), F.max(inside & ~low).alias(f"_h_{r.feature}")]
        final += [F.max(F.when(F.col(f"_{x}_{r.feature}"), F.col("record_date"))).alias(f"_{x}d_{r.feature}") for x in "lh"]
        low_date, normal = F.col(f"_ld_{r.feature}"), F.col(f"_hd_{r.feature}")
        outs.append(F.when(~F.coalesce(normal > low_date, F.lit(False)), low_date).alias(f"_m_{r.feature}"))
    days = pairs.where(used).groupBy(*ROW, "record_date").agg(*daily)
    row = days.groupBy(*ROW).agg(F.max("record_date").alias("_meas_date"), F.max_by(F.struct("_s", "_n"), F.when(F.col("_n") > 0, F.col("record_date"))).alias("_b"), *final)
    return row.select(*ROW, "_meas_date", F.try_divide("_b._s", "_b._n").alias("recorded"), *outs)


def _matched_index(window: DataFrame, rules: DerivationRules) -> DataFrame:
    matched = nearest_match(window, "weight_kg", "height_m", rules.pair_gap_days)
    index = matched.withColumn("bmi", F.try_divide(F.col("value"), F.pow("match_value", 2))).where(F.col("bmi").between(*rules.body_range))
    return latest_day_mean(index, "bmi", "computed")


def _lifestyle_part(pairs: DataFrame, rules: DerivationRules) -> DataFrame:
    """Smoking status, alcohol level and the latest used date, from one row per (row, day)."""
    inside = F.col("record_date") >= dates.window_start("index_date", years=rules.alcohol_window_years)
    smoke = F.when(F.col("kind") == "smoking", level_rank("value", SMOKING_LEVELS))
    coded = F.when((F.col("kind") == "alcohol") & inside, level_rank("value", ALCOHOL_LEVELS))
    units = F.when((F.col("kind") == "alcohol_units_week") & inside, unit_level_rank(F.col("units")))
    days = pairs.groupBy(*ROW, "record_date").agg(F.max(smoke).alias("_smoke"), F.max(coded).alias("_c"), F.max(units).alias("_u"))
    day = F.col("record_date")
    level = F.coalesce("_c", "_u")
    row = days.groupBy(*ROW).agg(F.max_by("_smoke", F.when(F.col("_smoke").isNotNull(), day)).alias("_last"), F.max("_smoke").alias("_most"), F.max(level).alias("_level"),
                                 F.max(F.when(F.col("_smoke").isNotNull() | level.isNotNull(), day)).alias("_life_date"))
    status = F.when((F.col("_last") == 0) & (F.col("_most") > 0), "ex").otherwise(level_name(F.col("_last"), SMOKING_LEVELS))
    return row.select(*ROW, status.alias("smoking_status"), level_name(F.col("_level"), ALCOHOL_LEVELS).alias("alcohol_level"), "_life_date")


def leak_count(frame: DataFrame) -> DataFrame:
    """Rows whose evidence is not strictly before the index day; must be 0."""
    return frame.agg(F.count_if(F.col("max_record_date") >= F.col("index_date")).alias("leaks"), F.count(F.lit(1)).alias("rows"))
