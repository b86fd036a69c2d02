"""Time contracts: where recorded dates lie against the index day, outcome contracts, row recovery.

Date columns are unpivoted once; each audit is one grouped aggregate over (column, offset) counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions import stats
from asofkit.operators.contracts import _rows_from_aggregate
from asofkit.operators.ordering import prefix_sums, quantiles
from asofkit.session import cut_lineage


def offsets(df: DataFrame, date_cols: Sequence[str], index: str, carry: Sequence[str] = (), sentinels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Long form (column_name, offset in days, positive = after the index day); sentinels and NULLs have no offset."""
    parts = []
    for c in date_cols:
        d = F.col(c)
        if sentinels and c in sentinels:
            d = F.when(~d.isin(*[F.lit(s).cast("date") for s in sentinels[c]]), d)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.date_diff(d, F.col(index)).alias("off")))
    return df.select(*carry, F.explode(F.array(*parts)).alias("_e")).select(*carry, "_e.column_name", "_e.off")


def root_cause(on: Column, after: Column) -> Column:
    return F.when((on == 0) & (after == 0), "CLEAN").when(after == 0, "SAME_DAY_INCLUSION").when(on == 0, "FUTURE_RECORDS").otherwise("SAME_DAY_AND_FUTURE")


def timing_diagnostic(df: DataFrame, date_cols: Sequence[str], index: str, *, eligible: str, y: str, sentinels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per date column: before / on / after the index day, quantiles of the offending offsets, label rate affected against clean, cause."""
    cells = (offsets(df, date_cols, index, [eligible, y], sentinels).groupBy("column_name", eligible, y, "off").agg(F.count(F.lit(1)).alias("c")))
    o, c, el = F.col("off"), F.col("c"), F.coalesce(F.col(eligible).cast("boolean"), F.lit(False))
    add = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    lab = el & F.col(y).isNotNull()
    s = cells.groupBy("column_name").agg(
        add(o.isNotNull()).alias("n_observed"), add(o < 0).alias("n_before"), add(o == 0).alias("n_on"), add(o > 0).alias("n_after"),
        add((o >= 0) & el).alias("affected_eligible"), add((o >= 0) & lab).alias("affected_labelled"),
        stats.ratio(add((o >= 0) & lab & (F.col(y) == 1)), add((o >= 0) & lab)).alias("rate_affected"),
        stats.ratio(add(lab & (F.col(y) == 1) & ~F.coalesce(o >= 0, F.lit(False))), add(lab & ~F.coalesce(o >= 0, F.lit(False)))).alias("rate_clean"),
        F.min(F.when(o >= 0, o)).alias("min_offset"), F.max(F.when(o >= 0, o)).alias("max_offset"))
    q = quantiles(cells.where("off >= 0"), "off", [0.5, 0.9, 0.99], ["column_name"], weight="c").select(
        "column_name", F.col("q0").alias("median_offset"), F.col("q1").alias("p90_offset"), F.col("q2").alias("p99_offset"))
    return s.join(q, "column_name", "left").withColumn("root_cause", root_cause(F.col("n_on"), F.col("n_after")))


def temporal_audit(df: DataFrame, date_cols: Mapping[str, str], index: str, *, eligible: str, sentinels: Mapping[str, Sequence[str]] | None = None,
                   buckets: Sequence[tuple[str, int, int]] = ()) -> DataFrame:
    """Every date column (with its declared timing): offset quantiles p1..p99, offset buckets, leakage risk class."""
    cells = offsets(df, list(date_cols), index, [eligible], sentinels).groupBy("column_name", eligible, "off").agg(F.count(F.lit(1)).alias("c"))
    o, c = F.col("off"), F.col("c")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    s = cells.groupBy("column_name").agg(
        add(o.isNotNull()).alias("n_observed"), add(o < 0).alias("n_before"), add(o == 0).alias("n_equal"), add(o > 0).alias("n_after"),
        add((o >= 0) & F.coalesce(F.col(eligible).cast("boolean"), F.lit(False))).alias("eligible_on_or_after"),
        *[add((o >= lo) & (o <= hi)).alias(name) for name, lo, hi in buckets])
    q = quantiles(cells, "off", [0.01, 0.05, 0.5, 0.95, 0.99], ["column_name"], weight="c").select(
        "column_name", *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p01", "p05", "p50", "p95", "p99"))])
    timing = F.element_at(F.create_map(*[F.lit(x) for kv in date_cols.items() for x in kv]), F.col("column_name"))
    # The names of the risk classes
    risk = (F.when(timing == "post_index", "POST_INDEX_BY_DESIGN").when(timing == "unknown", "TIMING_UNKNOWN").when(timing == "technical", "TECHNICAL_DATE")
            .when(F.col("eligible_on_or_after") > 0, "PROVEN_INDEX_DAY_OR_FUTURE_RECORDS").otherwise("CLEAN_IN_THIS_EXTRACT"))
    return s.join(q, "column_name", "left").withColumn("timing", timing).withColumn("risk", risk)


def companion_agreement(df: DataFrame, pairs: Mapping[str, str], index: str) -> DataFrame:
    """Share of rows whose stored day count equals index minus date."""
    parts = []
    for d, days in pairs.items():
        both = F.col(d).isNotNull() & F.col(days).isNotNull()
        parts.append((d, F.struct(F.count_if(both).alias("both"), F.count_if(both & (F.col(days) == F.date_diff(F.col(index), F.col(d)))).alias("equal"),
                                  F.count_if(F.col(days) < 0).alias("negative"))))
    return _rows_from_aggregate(df, parts, "column_name").withColumn("share_equal", stats.ratio(F.col("equal"), F.col("both")))


def source_timing(df: DataFrame, sources: Mapping[str, str], index: str, split: str) -> DataFrame:
    """Per source (with its record-date column) and split: before / on / after / without date, largest offset after, cause."""
    cells = offsets(df, list(sources.values()), index, [split]).groupBy("column_name", split, "off").agg(F.count(F.lit(1)).alias("c"))
    name = F.element_at(F.create_map(*[F.lit(x) for s, c in sources.items() for x in (c, s)]), F.col("column_name"))
    o, c = F.col("off"), F.col("c")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return (cells.withColumn("source", name).groupBy("source", split).agg(
        add(o < 0).alias("n_before"), add(o == 0).alias("n_on"), add(o > 0).alias("n_after"), add(o.isNull()).alias("n_null"),
        F.coalesce(F.max(F.when(o > 0, o)), F.lit(0)).alias("max_days_after"))
        .withColumn("root_cause", F.when(F.col("n_after") > 0, "POST_INDEX_RECORDS").when(F.col("n_on") > 0, "CLEAN_UNDER_END_OF_DAY").otherwise("CLEAN")))


def post_index_rows(df: DataFrame, date_cols: Sequence[str], index: str) -> DataFrame:
    """Rows with any predictor date after the index date, and the same per column."""
    any_after = F.lit(False)
    for c in date_cols:
        any_after = any_after | F.coalesce(F.col(c) > F.col(index), F.lit(False))
    parts = [("any", F.struct(F.count_if(any_after).alias("rows_after"), F.count(F.lit(1)).alias("rows")))]
    parts += [(c, F.struct(F.count_if(F.col(c) > F.col(index)).alias("rows_after"), F.count(c).alias("rows"))) for c in date_cols]
    return _rows_from_aggregate(df, parts, "column_name")


# ------------------------------------------------------------------ outcome contracts
def outcome_contract(df: DataFrame, *, y: str, event: str, days: str, index: str, end: str, followup: str, window: int, max_followup_share: float,
                     max_inconsistent_share: float, min_events: int, sentinel_year: int = 2900, start_after_index: bool = True) -> DataFrame:
    """Checks O1..O6: one row per check with its count, limit and verdict. ``start_after_index`` is the end-of-day contract."""
    pos, neg = F.col(y) == 1, F.col(y) == 0
    off = F.date_diff(F.col(event), F.col(index))
    first = 1 if start_after_index else 0
    real = F.col(followup).isNotNull() & (F.year(followup) < sentinel_year)
    n_pos = F.greatest(F.count_if(pos), F.lit(1))
    labelled = F.greatest(F.count_if(pos | neg), F.lit(1))
    zero = F.lit(0.0)
    last = window if start_after_index else window - 1
    checks = [
        ("O1_event_before_window", F.count_if(pos & ((off < first) | (F.col(days) < first))), zero),
        ("O2_window_end", F.count_if(F.date_diff(F.col(end), F.col(index)) != last), zero),
        ("O3_event_after_window", F.count_if(pos & (off > last)), zero),
        ("O4_event_after_followup", F.count_if(pos & real & (F.col(event) > F.col(followup))), F.lit(float(max_followup_share)) * n_pos),
        ("O5_label_date_inconsistent", F.count_if((pos & F.col(event).isNull()) | (neg & (off >= first) & (off <= last))), F.lit(float(max_inconsistent_share)) * labelled),
        ("O6_missing_events", F.greatest(F.lit(min_events) - F.count_if(pos), F.lit(0)), zero),
    ]
    rows = _rows_from_aggregate(df, [(n, F.struct(v.cast("long").alias("n"), lim.alias("allowed"))) for n, v, lim in checks], "check_name")
    return rows.withColumn("verdict", F.when(F.col("n") <= F.col("allowed"), "PASS").otherwise("STOP"))


def followup_zero_tolerance(df: DataFrame, *, y: str, event: str, followup: str, sentinel_year: int = 2900) -> DataFrame:
    """Any positive whose event lies after the personal follow-up end stops; a NULL or sentinel end is open."""
    real = F.col(followup).isNotNull() & (F.year(followup) < sentinel_year)
    pos = F.col(y) == 1
    t = df.agg(F.count_if(pos).alias("positives"), F.count_if(pos & real & (F.col(event) > F.col(followup))).alias("after_followup"),
               F.count_if(pos & ~real).alias("open_followup"))
    return t.withColumn("verdict", F.when(F.col("after_followup") == 0, "PASS").otherwise("STOP"))


def episode_bands(df: DataFrame, *, y: str, event: str, index: str, last: str, early_days: int = 14) -> DataFrame:
    """Events and early events by days since the last prior event, with the gap between the last and the next event."""
    since = F.date_diff(F.col(index), F.col(last))
    dt = F.date_diff(F.col(event), F.col(index))
    name = (F.when(since.isNull(), "no prior event").when(since < 0, "after index").when(since == 0, "0").when(since <= 7, "1-7").when(since <= 30, "8-30")
            .when(since <= 90, "31-90").when(since <= 180, "91-180").when(since <= 365, "181-365").otherwise(">365"))
    pos = F.col(y) == 1
    gap = F.date_diff(F.col(event), F.col(last))
    return df.groupBy(name.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("events"), F.count_if(pos & (dt <= early_days)).alias("early_events"), F.count_if(pos & (gap <= 7)).alias("gap_le_7"),
    ).withColumn("event_rate", F.col("events") / F.col("n")).withColumn("early_share", stats.ratio(F.col("early_events"), F.col("events")))


def death_label_audit(df: DataFrame, *, y: str, death: str, index: str, window: int) -> DataFrame:
    """Events among deaths inside the window; none among many deaths suggests that death overwrites the label."""
    inside = F.date_diff(F.col(death), F.col(index)).between(0, window)
    t = df.agg(F.count(death).alias("deaths"), F.count_if(inside).alias("deaths_in_window"), F.count_if(inside & (F.col(y) == 1)).alias("events"),
               F.count_if(inside & (F.col(y) == 0)).alias("non_events"), F.count_if(inside & F.col(y).isNull()).alias("unlabelled"))
    return t.withColumn("overwrite_suspected", (F.col("deaths_in_window") >= 50) & (F.col("events") == 0))


def time_contract_checks(df: DataFrame, *, y: str, event: str, index: str, end: str, window: int, date_cols: Sequence[str], companions: Mapping[str, str],
                         indicators: Mapping[str, str]) -> DataFrame:
    """V1..V8-style checks of the end-of-day contract in one aggregate: one row per check with the violating rows."""
    off = F.date_diff(F.col(event), F.col(index))
    any_after = F.lit(False)
    for c in date_cols:
        any_after = any_after | F.coalesce(F.col(c) > F.col(index), F.lit(False))
    checks = [("positive_outside_window", F.count_if((F.col(y) == 1) & ((off < 1) | (off > window)))),
              ("window_end", F.count_if(F.date_diff(F.col(end), F.col(index)) != window)), ("post_index_records", F.count_if(any_after))]
    checks += [(f"day_count:{days}", F.count_if(F.col(days) != F.date_diff(F.col(index), F.col(d)))) for d, days in companions.items()]
    checks += [(f"indicator:{flag}", F.count_if((F.col(flag) == 1) != F.expr(cond))) for flag, cond in indicators.items()]
    return _rows_from_aggregate(df, [(n, F.struct(v.alias("n"))) for n, v in checks], "check_name")


# ------------------------------------------------------------------ snapshots
def snapshot_audit(df: DataFrame, *, index: str, entity: str, eligible: str, y: str, event: str, date_cols: Sequence[str], horizon: int,
                   max_censored: float = 0.5, freeze: str | None = None) -> DataFrame:
    """Per index date: rows, entities, eligible, labelled, censored, invalid, events, timing violations, and whether it is usable (reasons)."""
    el = F.coalesce(F.col(eligible).cast("boolean"), F.lit(False))
    lab = el & F.col(y).isNotNull()
    invalid = lab & (~F.col(y).isin(0, 1) | ((F.col(y) == 1) & F.col(event).isNull()) | ((F.col(y) == 0) & F.col(event).isNotNull()))
    viol = F.lit(False)
    for c in date_cols:
        viol = viol | F.coalesce(F.col(c) >= F.col(index), F.lit(False))
    s = df.groupBy(index).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.count_if(el).alias("eligible_rows"), F.count_if(lab).alias("labelled"),
        F.count_if(el & F.col(y).isNull()).alias("censored"), F.count_if(invalid).alias("invalid"), F.count_if(lab & (F.col(y) == 1)).alias("events"),
        F.count_if(el & viol).alias("violations"))
    end = F.date_add(F.col(index), horizon)
    reasons = [F.when(F.col("eligible_rows") == 0, "no eligible rows"), F.when((F.col("eligible_rows") > 0) & (F.col("labelled") == 0), "no usable label"),
               F.when((F.col("labelled") > 0) & (F.col("censored") / F.col("eligible_rows") > max_censored), "censored share"), F.when(F.col("invalid") > 0, "invalid labels")]
    if freeze:
        reasons.append(F.when(end > F.lit(freeze).cast("date"), "window after freeze"))
    return s.withColumn("window_end", end).withColumn("reason", F.concat_ws("; ", *reasons)).withColumn(
        "status", F.when(F.col("reason") == "", "USABLE").otherwise("EXCLUDED"))


def temporal_design(snapshots: DataFrame, index: str, *, horizon: int, test_share: float, min_test: int, min_validation: int, min_train: int) -> DataFrame:
    """Train / validation / test of the usable snapshots: the latest block with enough rows and events is test, the latest feasible
    boundary before it separates train and validation, and embargoed snapshots are marked.

    The input has one row per index date (tens to hundreds), so the running sums use one small window.
    """
    use = snapshots.where("status = 'USABLE'").select(index, "rows", "events")
    late = Window.orderBy(F.col(index).desc())
    up = use.withColumns({"_cr": F.sum("rows").over(late), "_ce": F.sum("events").over(late), "_k": F.row_number().over(late), "_t": F.sum("rows").over(Window.partitionBy()),
                          "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    enough = (F.col("_cr") >= test_share * F.col("_t")) & (F.col("_ce") >= min_test)
    first_test = up.where(enough | (F.col("_k") >= F.col("_m") - 2)).agg(F.max(index)).scalar()
    t = use.withColumn("_ft", first_test)
    early = t.where(F.col(index) < F.col("_ft"))
    # Feasible boundaries d: validation = [d, first test) after embargo; train = snapshots whose window ends before d.
    early = t.where(F.col(index) < F.col("_ft")).withColumn("_day", F.unix_date(index))
    kept = F.when(F.date_add(F.col(index), horizon) < F.col("_ft"), F.col("events")).otherwise(0)
    behind = Window.orderBy("_day").rangeBetween(Window.unboundedPreceding, -(horizon + 1))
    fe = early.select(F.col(index).alias("_d"), F.sum(kept).over(late).alias("ve"), F.coalesce(F.sum("events").over(behind), F.lit(0)).alias("te"))
    boundary = fe.where((F.col("ve") >= min_validation) & (F.col("te") >= min_train)).agg(F.max("_d")).scalar()
    d = F.col(index)
    end = F.date_add(d, horizon)
    part = (F.when(d >= F.col("_ft"), "test").when(d >= F.col("_b"), F.when(end < F.col("_ft"), "validation").otherwise("validation (embargoed)"))
            .when(d < F.col("_b"), F.when(end < F.col("_b"), "train").otherwise("train (embargoed)")))
    return t.withColumn("_b", boundary).select(index, "rows", "events", part.alias("part"))


# ------------------------------------------------------------------ row recovery
def unknown_masks(df: DataFrame, features: Mapping[str, tuple[str, str]], index: str, keys: Sequence[str]) -> DataFrame:
    """Per feature (column, record date): UNKNOWN when the record is after the index or a recorded value has no date."""
    cols = []
    for name, (value, date) in features.items():
        has = F.coalesce(F.col(value) != 0, F.lit(False))
        cols.append((F.coalesce(F.col(date) > F.col(index), F.lit(False)) | (has & F.col(date).isNull())).alias(name))
    return df.select(*keys, *cols)


def recovery_registry(df: DataFrame, features: Mapping[str, tuple[str, str]], index: str, *, train: Column, min_known: int, max_population: float, max_informative: float) -> DataFrame:
    """Per feature: UNKNOWN rows, known informative rows, shares, and the gate class."""
    parts = []
    for name, (value, date) in features.items():
        has = F.coalesce(F.col(value) != 0, F.lit(False))
        unk = F.coalesce(F.col(date) > F.col(index), F.lit(False)) | (has & F.col(date).isNull())
        known = ~unk
        seen = F.when(train & known, F.col(value))
        parts.append((name, F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(unk).alias("n_unknown"), F.count_if(known & F.col(date).isNotNull()).alias("n_informative"),
                                     F.count(seen).alias("n_known_train"), (F.min(seen) == F.max(seen)).alias("constant"), F.count_if(F.col(date) == F.col(index)).alias("n_on"),
                                     F.count_if(F.col(date) > F.col(index)).alias("n_after"), F.count_if(has & F.col(date).isNull()).alias("n_undated"))))
    t = _rows_from_aggregate(df, parts, "feature")
    sp = F.col("n_unknown") / F.col("rows")
    si = F.col("n_unknown") / F.greatest(F.lit(1), F.col("n_unknown") + F.col("n_informative"))
    klass = (F.when((F.col("n_known_train") < min_known) | F.coalesce(F.col("constant"), F.lit(True)), "NOT_RECOVERABLE_DATA")
             .when((F.col("n_unknown") > 0) & ((sp > max_population) | (si > max_informative)), "NOT_RECOVERABLE_FUTURE")
             .when(F.col("n_unknown") > 0, "SAFE_BOUNDED").otherwise("SAFE_VERIFIED"))
    return t.withColumn("unknown_share", sp).withColumn("unknown_share_informative", si).withColumn("gate_class", klass)


def remediation(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source with the features it blocks or bounds. ``sources``: (feature, sources = 'a; b')."""
    long = registry.join(sources, "feature").withColumn("source", F.explode(F.split("sources", "; ")))
    blocked, bounded = F.col("gate_class").startswith("NOT_RECOVERABLE"), F.col("gate_class") == "SAFE_BOUNDED"
    out = long.groupBy("source").agg(
        F.count_if(blocked).alias("n_blocked"), F.array_join(F.array_sort(F.collect_list(F.when(blocked, F.col("feature")))), "; ").alias("blocked"),
        F.count_if(bounded).alias("n_bounded"), F.array_join(F.array_sort(F.collect_list(F.when(bounded, F.col("feature")))), "; ").alias("bounded"))
    return out.where("n_blocked + n_bounded > 0")


def selection_bias(df: DataFrame, date_cols: Sequence[str], index: str, y: str) -> DataFrame:
    """Event rate of rows with a record on or after the index day against the other rows, per date column."""
    hit = offsets(df, date_cols, index, [y]).groupBy("column_name").agg(
        F.count_if(F.col("off") >= 0).alias("n1"), F.sum(F.when(F.col("off") >= 0, F.col(y)).otherwise(0)).alias("e1"),
        F.count_if(~F.coalesce(F.col("off") >= 0, F.lit(False))).alias("n0"), F.sum(F.when(~F.coalesce(F.col("off") >= 0, F.lit(False)), F.col(y)).otherwise(0)).alias("e0"))
    return hit.select("*", stats.ratio(F.col("e1"), F.col("n1")).alias("rate_affected"), stats.ratio(F.col("e0"), F.col("n0")).alias("rate_other"),
                      *stats.columns(stats.prevalence_ratio(F.col("e1"), F.col("n1"), F.col("e0"), F.col("n0"))))


def feasibility(masks: DataFrame, domains: Mapping[str, Sequence[str]], y: str, *, min_rows: int, min_events: int) -> DataFrame:
    """GO / NO-GO per domain: rows and events with any known informative value of the domain's columns (NULL = not informative)."""
    parts = []
    for name, cols in domains.items():
        seen = F.lit(False)
        for c in cols:
            seen = seen | F.col(c).isNotNull()
        parts.append((name, F.struct(F.count_if(seen).alias("rows"), F.sum(F.when(seen, F.col(y)).otherwise(0)).alias("events"))))
    t = _rows_from_aggregate(masks, parts, "domain")
    return t.withColumn("decision", F.when((F.col("rows") >= min_rows) & (F.col("events") >= min_events), "GO").otherwise("NO_GO"))


# ------------------------------------------------------------------ bounds over unknown states

def state_profiles(df: DataFrame, cols: Sequence[str], contribution: Column) -> DataFrame:
    """Distinct joint states with their contribution to the score."""
    return df.select(*cols).distinct().withColumn("contribution", contribution)


def _ranked(unknown: DataFrame, profiles: DataFrame, col: str) -> DataFrame:
    """Per distinct value: ``bound_rank`` (its rank among the bounds) and ``state_rank`` (that of the lowest bound that admits it).

    Rank 0 never occurs; the rank above all bounds, ``top``, stands for no bound and for states that no bound admits.
    """
    both = unknown.select(F.col(col).cast("double").alias("v"), F.lit(1).alias("b")).union(profiles.select(F.col(col).cast("double"), F.lit(0)))
    values = both.where("v IS NOT NULL").groupBy("v").agg(F.max("b").alias("b"))
    runs = prefix_sums(values, "v", {"b": F.col("b")}, descending=False)
    return runs.select("v", F.col("cum_b").alias("bound_rank"), (F.col("cum_b") - F.col("b") + 1).alias("state_rank"), (F.col("tot_b") + 1).alias("top"))


def _levels(top: Column) -> Column:
    return F.sequence(F.lit(0), F.length(F.bin(top)))


def profile_bounds(unknown: DataFrame, profiles: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Lowest and highest contribution of any observed state that stays at or below the row's upper bounds (NULL = no bound).

    Rows and states are never paired. Per column, ranks are cut into halves again and again: a
    state counts in the one block of each level that holds its rank, and the ranks up to a bound are
    one block for each binary digit of the bound's rank. States are reduced to minima and maxima
    per combination of blocks, rows look up their few combinations. A row that admits no state gets
    the range over all states.
    """
    states = profiles.select(*cols, "contribution")
    rows = unknown.select(F.col(key).alias("_key"), *cols).distinct()
    for c in cols:
        ranked = cut_lineage(_ranked(unknown, profiles, c))
        top = F.coalesce(ranked.agg(F.max("top")).scalar(), F.lit(1).cast("long"))
        by_value = ranked.select(F.col("v").alias(f"_v_{c}"), "bound_rank", "state_rank")
        place = F.coalesce("state_rank", "_top") - 1
        states = (states.join(by_value, F.col(c).cast("double") == F.col(f"_v_{c}"), "left").withColumn("_top", top)
                  .withColumn(f"_b_{c}", F.explode(F.transform(_levels(F.col("_top")), lambda k: F.struct(k.alias("k"), F.call_function("shiftright", place, k).alias("n")))))
                  .drop(f"_v_{c}", "bound_rank", "state_rank", "_top"))
        bound = F.coalesce("bound_rank", "_top")
        digits = F.filter(_levels(F.col("_top")), lambda k: F.call_function("shiftright", bound, k) % 2 == 1)
        rows = (rows.join(by_value, F.col(c).cast("double") == F.col(f"_v_{c}"), "left").withColumn("_top", top)
                .withColumn(f"_b_{c}", F.explode(F.transform(digits, lambda k: F.struct(k.alias("k"), (F.call_function("shiftright", bound, k) - 1).alias("n")))))
                .drop(f"_v_{c}", "bound_rank", "state_rank", "_top"))
    blocks = [f"_b_{c}" for c in cols]
    cells = states.groupBy(*blocks).agg(F.min("contribution").alias("lo"), F.max("contribution").alias("hi"))
    found = rows.join(cells, blocks).groupBy("_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    every = profiles.agg(F.struct(F.min("contribution").alias("lo"), F.max("contribution").alias("hi"))).scalar()
    out = unknown.select(key).join(found, F.col(key) == F.col("_key"), "left").withColumn("_all", every)
    return out.select(key, F.coalesce("lo", "_all.lo").alias("lo"), F.coalesce("hi", "_all.hi").alias("hi"), F.col("lo").isNull().alias("fallback"))
