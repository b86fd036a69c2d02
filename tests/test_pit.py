"""Boundary, precedence and metamorphic tests of the point-in-time derivation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars
from asofkit.operators import pit
from asofkit.operators.contracts import ContractError

D = dt.date
IDX = D(2020, 3, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def row_df(spark):
    return frame(spark, [(1, IDX, D(1940, 1, 1), "female")], "entity_id long, index_date date, birth_date date, sex string")


def day(offset):
    return IDX + dt.timedelta(days=offset)


def test_first_failing_reason_and_covering_interval(spark):
    persons = frame(spark, [
        (1, D(1940, 1, 1), "female", "s1", None, D(2010, 1, 1), D(2015, 1, 1)), (1, D(1940, 1, 1), "female", "s2", None, D(2016, 1, 1), None),
        (2, None, "male", "s1", None, D(2010, 1, 1), None), (3, D(1940, 1, 1), "x", "s1", D(2019, 1, 1), D(2010, 1, 1), None),
        (4, D(1940, 1, 1), "male", "s1", D(2019, 1, 1), D(2010, 1, 1), None), (5, D(1940, 1, 1), "male", "s1", None, D(2010, 1, 1), D(2012, 1, 1)),
        (6, D(1960, 1, 1), "male", "s1", None, D(2010, 1, 1), None)],
        "entity_id long, birth_date date, sex string, site string, death_date date, start_date date, end_date date")
    index = frame(spark, [(i, IDX) for i in range(1, 8)], "entity_id long, index_date date")
    got = {r.entity_id: (r.exclusion_reason, r.site) for r in pit.eligibility(index, persons, 65).collect()}
    assert got == {1: (None, "s2"), 2: ("missing_date_of_birth", "s1"), 3: ("invalid_sex", "s1"), 4: ("died_before_index", "s1"), 5: ("not_member_at_index", "s1"),
                   6: ("age_below_minimum", "s1"), 7: ("missing_person_record", None)}


@pytest.mark.parametrize("offset,counted", [(-121, 0), (-120, 1), (-1, 1), (0, 0)])
def test_item_window_boundaries(spark, offset, counted):
    rx = frame(spark, [(1, 10, 1, True, day(offset), day(offset))], "entity_id long, item long, chapter int, is_drug boolean, record_date date, available_date date")
    pairs = pit.usable_records(row_df(spark), rx)
    assert pit.distinct_items(pairs, window_days=120).count() == counted


def test_rejection_reasons(spark):
    rec = frame(spark, [(1, day(0), day(0)), (1, day(-5), day(1)), (1, day(-10), day(-2)), (1, day(-100), None)], "entity_id long, record_date date, available_date date")
    declared = pit.record_pairs(row_df(spark), rec)
    got = {r.reason: r.n for r in pit.rejection_counts({"t": declared}).collect()}
    assert got == {"record_on_or_after_index": 1, "available_on_or_after_index": 1}
    lagged = pit.record_pairs(row_df(spark), rec, declared=False, lag_days=14)
    got = {r.reason: r.n for r in pit.rejection_counts({"t": lagged}).collect()}
    assert got == {"record_on_or_after_index": 1, "within_unknown_availability_lag": 2}


def meas(spark, rows):
    return frame(spark, [(1, k, float(v), day(o), day(o)) for k, v, o in rows], "entity_id long, kind string, value double, record_date date, available_date date")


def test_nearest_match_gap_and_tie(spark):
    pairs = pit.usable_records(row_df(spark), meas(spark, [("w", 80, -200), ("h", 1.70, -230), ("h", 1.71, -169), ("w", 70, -100), ("h", 1.60, -110), ("h", 1.65, -90), ("w", 60, -40), ("h", 1.5, -5)]))
    got = {r.record_date: r.match_value for r in pit.nearest_match(pairs, "w", "h", 30).collect()}
    assert got == {day(-200): 1.70, day(-100): 1.65}  # 30 days fit, 31 do not; an equal gap takes the later one; 35 days have no match


def test_nearest_match_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice("wh"), rng.randint(1, 99), -rng.randint(1, 400)) for _ in range(120)]
    pairs = pit.usable_records(row_df(spark), meas(spark, rows))
    got = sorted((r.record_date, r.value, r.match_date, r.match_value) for r in pit.nearest_match(pairs, "w", "h", 30).collect())
    heights = {}
    for k, v, o in rows:
        if k == "h":
            heights[o] = max(heights.get(o, 0), v)
    want = []
    for k, v, o in rows:
        near = [h for h in heights if abs(h - o) <= 30]
        if k == "w" and near:
            best = min(near, key=lambda h: (abs(h - o), -h))
            want.append((day(o), float(v), day(best), float(heights[best])))
    assert got == sorted(want)


def life(spark, rows):
    return frame(spark, [(1, k, v, u, day(o), day(o)) for k, v, u, o in rows], "entity_id long, kind string, value string, units double, record_date date, available_date date")


@pytest.mark.parametrize("records,expected", [
    ([("smoking", "never", None, -5)], "never"),
    ([("smoking", "current", None, -50), ("smoking", "never", None, -5)], "ex"),
    ([("smoking", "ex", None, -5), ("smoking", "current", None, -5)], "current"),
])
def test_latest_status(spark, records, expected):
    pairs = pit.usable_records(row_df(spark), life(spark, records))
    assert pit.latest_status(pairs).first().smoking_status == expected


@pytest.mark.parametrize("records,expected", [
    ([("alcohol_units_week", None, 0.0, -5)], "zero"),
    ([("alcohol_units_week", None, 20.9, -5)], "lower_risk"),
    ([("alcohol_units_week", None, 21.0, -5)], "higher_risk"),
    ([("alcohol_units_week", None, 49.0, -5)], "harmful"),
    ([("alcohol_units_week", None, 60.0, -5), ("alcohol", "lower_risk", None, -5)], "lower_risk"),
    ([("alcohol_units_week", None, 60.0, -6), ("alcohol", "lower_risk", None, -5)], "harmful"),
])
def test_highest_level(spark, records, expected):
    pairs = pit.usable_records(row_df(spark), life(spark, records))
    assert pit.highest_level(pairs, 5).first().alcohol_level == expected


def test_reading_counts_are_not_mixed(spark):
    rule = pit.ReadingRule("high", 3, (("sbp", ">=", 140.0), ("dbp", ">=", 90.0)))
    mixed = pit.usable_records(row_df(spark), meas(spark, [("sbp", 150, -9), ("sbp", 150, -8), ("dbp", 95, -7)]))
    assert pit.reading_evidence(mixed, rule, pit.WindowRule("high")).count() == 0
    three = pit.usable_records(row_df(spark), meas(spark, [("sbp", 150, -9), ("sbp", 150, -8), ("sbp", 141, -7), ("sbp", 120, -1)]))
    assert pit.reading_evidence(three, rule, pit.WindowRule("high")).first().record_date == day(-7)


def test_later_normal_value_supersedes(spark):
    rule = pit.SexCutRule("low", "hb", {"female": 11.5, "male": 13.0})
    low_last = pit.usable_records(row_df(spark), meas(spark, [("hb", 12, -9), ("hb", 11, -8)]))
    assert pit.sex_cut_evidence(low_last, rule, pit.WindowRule("low")).count() == 1
    normal_last = pit.usable_records(row_df(spark), meas(spark, [("hb", 11, -9), ("hb", 12, -8)]))
    assert pit.sex_cut_evidence(normal_last, rule, pit.WindowRule("low")).count() == 0


def test_longest_prefix_wins(spark):
    rules = frame(spark, [("S7", "a"), ("S72", "b"), ("W", "c")], "prefix string, block string")
    codes = frame(spark, [("S720",), ("S790",), ("W19",), ("X1",)], "code string")
    got = {r.code: r.block for r in pit.longest_prefix(codes, "code", rules, [1, 2, 3]).collect()}
    assert got == {"S720": "b", "S790": "a", "W19": "c"}


def test_code_range_expansion(spark):
    r = frame(spark, [("800-803",), ("E880-E881",), ("V15",)], "codes string")
    got = sorted(x.prefix for x in scalars.expand_code_ranges(r).collect())
    assert got == ["800", "801", "802", "803", "E880", "E881", "V15"]


@pytest.mark.parametrize("seed", [1, 2])
def test_deleting_the_future_changes_no_predictor(spark, seed):
    """Metamorphic: records on or after the index day, or known only then, never matter."""
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        o = rng.randint(-900, 300)
        late = rng.random() < 0.2
        rows.append((rng.randint(1, 20), rng.choice(["weight_kg", "height_m", "bmi"]), rng.uniform(1, 90), day(o), day(o + (rng.randint(1, 400) if late else 0))))
    schema = "entity_id long, kind string, value double, record_date date, available_date date"
    every = frame(spark, rows, schema)
    past = frame(spark, [r for r in rows if r[3] < IDX and r[4] < IDX], schema)
    index = frame(spark, [(i, IDX, D(1940, 1, 1), "male") for i in range(1, 21)], "entity_id long, index_date date, birth_date date, sex string")
    rules = pit.DerivationRules(body_range=(5.0, 60.0))
    a = sorted((r.entity_id, r.body_index) for r in pit.body_index(pit.usable_records(index, every), rules).collect())
    b = sorted((r.entity_id, r.body_index) for r in pit.body_index(pit.usable_records(index, past), rules).collect())
    assert a == b and a


@pytest.mark.parametrize("offset,inside", [(-1, False), (0, True), (179, True), (180, False)])
def test_outcome_window(spark, offset, inside):
    enc = frame(spark, [(1, 7, day(offset))], "entity_id long, encounter_id long, event_date date")
    assert (pit.outcome_pairs(row_df(spark), enc, pit.OutcomeRules(days=180)).count() == 1) is inside


def test_outcome_statuses_in_order(spark):
    cols = "entity_id long, index_date date, event_date date, code string, code_system string, encounter_type string, admission_method string, spell_start_date date, position int, kind string, code_status string"
    base = [1, IDX, day(3), "S720", "ICD-10", "hospital_admission", "emergency", None, 1, "fracture", "CANDIDATE"]

    def with_(**kw):
        names = [c.split()[0] for c in cols.split(", ")]
        return tuple(kw.get(n, v) for n, v in zip(names, base))

    cases = [(with_(), "qualifying"), (with_(code_status="REVIEW", encounter_type="other"), "icd9cm_review_not_counted"), (with_(code="S72001D", code_system="ICD-10-CM"), "icd10cm_excluded_7th_character"),
             (with_(encounter_type="other"), "encounter_type_not_qualifying"), (with_(spell_start_date=day(-1)), "spell_started_before_index"), (with_(admission_method=None), "unknown_admission_method"),
             (with_(admission_method="elective"), "admission_not_non_elective"), (with_(position=2), "position_rule"), (with_(position=2, kind="fall"), "qualifying")]
    got = pit.outcome_status(frame(spark, [c for c, _ in cases], cols).withColumn("i", F.monotonically_increasing_id()), pit.OutcomeRules()).orderBy("i").collect()
    assert [r.status for r in got] == [s for _, s in cases]


def test_missing_status_stays_null(spark):
    assert [r.v for r in spark.createDataFrame([(None,), (2,)], "r int").select(pit.level_name(F.col("r"), pit.SMOKING_LEVELS).alias("v")).collect()] == [None, "current"]


def test_input_problems_stop_the_derivation(spark):
    d = lambda s: f"DATE'{s}'"
    index = spark.sql(f"SELECT * FROM VALUES (1L, {d('2020-01-01')}), (1L, {d('2020-01-01')}), (CAST(NULL AS LONG), {d('2020-01-01')}) AS t(entity_id, index_date)")
    persons = spark.sql(f"SELECT * FROM VALUES (1L, {d('1940-01-01')}, 'male', '1', CAST(NULL AS DATE), {d('2010-01-01')}, {d('2015-01-01')}), (1L, {d('1941-01-01')}, 'male', '1', NULL, {d('2014-01-01')}, {d('2013-01-01')}) AS t(entity_id, birth_date, sex, site, death_date, start_date, end_date)")
    events = spark.sql(f"SELECT 1L AS entity_id, {d('2019-01-02')} AS record_date, {d('2019-01-01')} AS available_date")
    found = {r.check_name: r.n for r in pit.input_problems({"persons": persons, "conditions": events}, index).collect()}
    assert {k for k, n in found.items() if n} == {"index_null_key", "index_repeated", "persons_overlapping", "persons_end_before_start", "persons_varying_birth_date", "conditions_available_before_record"}
    with pytest.raises(ContractError, match="index_repeated: 1.*persons_overlapping: 1"):
        pit.derive_checked({"persons": persons, "conditions": events}, index, None, (), None)


def test_counters_name_the_fate_of_every_pair(spark):
    rules = pit.DerivationRules(item_window_days=120, excluded_chapters=(3,), body_window_years=2, alcohol_window_years=3, undeclared=frozenset({"lifestyle"}), lag_days=14,
                                windows=(pit.WindowRule("alpha", lookback_days=30), pit.WindowRule("pressure", lookback_days=50)),
                                readings=(pit.ReadingRule("pressure", 1, (("sbp", ">=", 150.0),)),))
    tables = {
        "conditions": frame(spark, [(1, f, day(o), day(a)) for f, o, a in (("alpha", -30, -30), ("alpha", -31, -31), ("other", -1, -1), ("alpha", 0, 0), ("alpha", -3, 0), (None, -3, -3))],
                            "entity_id long, feature string, record_date date, available_date date"),
        "prescriptions": frame(spark, [(1, 7, c, d, day(o), day(o)) for c, d, o in ((1, True, -120), (1, True, -121), (3, True, -1), (1, False, -1), (1, None, -1))],
                               "entity_id long, item long, chapter int, is_drug boolean, record_date date, available_date date"),
        "measurements": meas(spark, [("bmi", 25, -10), ("bmi", 9.9, -10), ("bmi", 25, -800), ("sbp", 100, -50), ("sbp", 160, -51), ("pulse", 60, -1), ("weight_kg", 70, 1)]),
        "lifestyle": frame(spark, [(1, k, v, u, day(o), None) for k, v, u, o in (("smoking", "never", None, -4000), ("smoking", "?", None, -20), ("alcohol", "zero", None, -2000),
                           ("alcohol_units_week", None, None, -20), ("alcohol_units_week", None, 3.0, -20), ("smoking", "ex", None, -14), ("diet", "x", None, -20))],
                           "entity_id long, kind string, value string, units double, record_date date, available_date date"),
    }
    got = {(r.table_name, r.counter): r.n for r in pit.derivation_counters(row_df(spark), tables, rules).collect()}
    assert got == {
        ("conditions", "used"): 1, ("conditions", "outside_window"): 1, ("conditions", "not_declared"): 2, ("conditions", "record_on_or_after_index"): 1, ("conditions", "available_on_or_after_index"): 1,
        ("prescriptions", "used"): 1, ("prescriptions", "outside_window"): 1, ("prescriptions", "not_declared"): 3,
        ("measurements", "used"): 2, ("measurements", "value_unusable"): 1, ("measurements", "outside_window"): 2, ("measurements", "not_declared"): 1, ("measurements", "record_on_or_after_index"): 1,
        ("lifestyle", "used"): 2, ("lifestyle", "value_unusable"): 2, ("lifestyle", "outside_window"): 1, ("lifestyle", "not_declared"): 1, ("lifestyle", "within_unknown_availability_lag"): 1,
    }
