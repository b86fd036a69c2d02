"""Point-in-time queries: eligibility, record joins, look-back features, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import dates
from asofkit.operators import pit
from asofkit.queries import roles
from asofkit.queries.registry import Tables, query
from asofkit.queries.roles import roles_sql

RULES = roles.RULES


def elig(t: Tables) -> DataFrame:
    return pit.prepared_rows(pit.eligible_rows(roles.index_table(t), roles.persons(t), RULES.age_min))


def usable(t: Tables, name: str, rows: DataFrame | None = None, start: Column | None = None) -> DataFrame:
    rows = elig(t) if rows is None else rows
    return pit.usable_records(rows, getattr(roles, name)(t), declared=name not in RULES.undeclared, lag_days=RULES.lag_days, since=start)


def since(*, years: int | None = None, days: int | None = None) -> Column:
    return dates.window_start("index_date", years=years, days=days)


@query("asof_membership", "J01", "entity_id:l index_date:d start_date:d end_date:d site:s covers:b has_person:b",
       roles_sql("SELECT entity_id, index_date, start_date, end_date, site, covers, has_person FROM asof_rows"))
def _(t):
    return pit.as_of_membership(roles.index_table(t), roles.persons(t))


@query("eligibility_first_reason", "P10 P07", "reason:s rows:l mean_age:f",
       roles_sql("SELECT coalesce(reason, 'eligible') AS reason, count(*) AS rows, avg(age) AS mean_age FROM reasons GROUP BY 1"))
def _(t):
    return (pit.eligibility(roles.index_table(t), roles.persons(t), RULES.age_min)
            .groupBy(F.coalesce("exclusion_reason", F.lit("eligible")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("age").alias("mean_age")))


@query("record_rejections", "J02 A05", "table_name:s reason:s n:l", roles_sql("""
SELECT table_name, reason, count(*) AS n FROM (
 SELECT 'prescriptions' AS table_name, CASE WHEN record_date >= index_date THEN 'record_on_or_after_index' WHEN available_date >= index_date THEN 'available_on_or_after_index' END AS reason FROM elig JOIN prescriptions USING (entity_id)
 UNION ALL SELECT 'lifestyle', CASE WHEN record_date >= index_date THEN 'record_on_or_after_index' WHEN record_date >= index_date - 14 THEN 'within_unknown_availability_lag' WHEN available_date >= index_date THEN 'available_on_or_after_index' END FROM elig JOIN lifestyle USING (entity_id)
) WHERE reason IS NOT NULL GROUP BY ALL"""))
def _(t):
    rows = elig(t)
    return pit.rejection_counts({
        "prescriptions": pit.record_pairs(rows, roles.prescriptions(t)),
        "lifestyle": pit.record_pairs(rows, roles.lifestyle(t), declared=False, lag_days=RULES.lag_days)})


_LATE = "CASE WHEN record_date >= index_date THEN 'record_on_or_after_index' WHEN available_date >= index_date THEN 'available_on_or_after_index'"


@query("derivation_counters", "A05 J02", "table_name:s counter:s n:l", roles_sql(f"""
SELECT table_name, counter, count(*) AS n FROM (
 SELECT 'conditions' AS table_name, {_LATE} WHEN feature NOT IN ('alpha', 'beta', 'gamma', 'delta') THEN 'not_declared'
  WHEN (feature = 'beta' AND record_date < CAST(index_date - INTERVAL 1 YEAR AS DATE)) OR (feature = 'gamma' AND record_date < index_date - 400) OR (feature = 'delta' AND (record_date - birth_date) / 365.25 < 70) THEN 'outside_window' ELSE 'used' END AS counter
  FROM elig JOIN conditions USING (entity_id)
 UNION ALL SELECT 'prescriptions', {_LATE} WHEN NOT is_drug OR chapter IN (3, 7) THEN 'not_declared' WHEN record_date < index_date - 120 THEN 'outside_window' ELSE 'used' END FROM elig JOIN prescriptions USING (entity_id)
 UNION ALL SELECT 'measurements', {_LATE} WHEN kind <> 'hb_g_dl' AND record_date < CAST(index_date - INTERVAL 2 YEAR AS DATE) THEN 'outside_window'
  WHEN kind = 'bmi' AND value NOT BETWEEN 10 AND 80 THEN 'value_unusable' ELSE 'used' END FROM elig JOIN measurements USING (entity_id)
 UNION ALL SELECT 'lifestyle', CASE WHEN record_date >= index_date THEN 'record_on_or_after_index' WHEN record_date >= index_date - 14 THEN 'within_unknown_availability_lag'
  WHEN kind <> 'smoking' AND record_date < CAST(index_date - INTERVAL 3 YEAR AS DATE) THEN 'outside_window' ELSE 'used' END FROM elig JOIN lifestyle USING (entity_id)
) GROUP BY ALL"""))
def _(t):
    return pit.derivation_counters(elig(t), roles.event_tables(t), RULES)


@query("usable_record_counts", "J02", "entity_id:l index_date:d records:l latest:d",
       roles_sql("SELECT entity_id, index_date, count(*) AS records, max(record_date) AS latest FROM rx GROUP BY ALL"))
def _(t):
    return usable(t, "prescriptions").groupBy(*pit.ROW).agg(F.count(F.lit(1)).alias("records"), F.max("record_date").alias("latest"))


@query("distinct_items_120d", "A01 P08", "entity_id:l index_date:d item_count:l",
       roles_sql("SELECT entity_id, index_date, coalesce(item_count, 0) AS item_count FROM elig LEFT JOIN items USING (entity_id, index_date)"))
def _(t):
    rows = elig(t)
    used = usable(t, "prescriptions", rows, since(days=120))
    counts = pit.distinct_items(used, window_days=120, excluded_chapters=RULES.excluded_chapters)
    return rows.join(counts, pit.ROW, "left").select(*pit.ROW, F.coalesce("item_count", F.lit(0)).alias("item_count"))


@query("latest_day_mean", "W02", "entity_id:l index_date:d recorded:f",
       roles_sql("SELECT entity_id, index_date, recorded FROM rec_bmi"))
def _(t):
    win = pit.body_window(usable(t, "measurements", start=since(years=RULES.body_window_years)), RULES)
    return pit.latest_day_mean(win.where((F.col("kind") == "bmi") & F.col("value").between(10.0, 80.0)), "value", "recorded")


@query("nearest_match", "J03 W04", "entity_id:l index_date:d record_date:d value:f match_date:d match_value:f",
       roles_sql("SELECT entity_id, index_date, record_date, value, match_date, match_value FROM matched"))
def _(t):
    return pit.nearest_match(pit.body_window(usable(t, "measurements", start=since(years=RULES.body_window_years)), RULES), "weight_kg", "height_m", 30)


@query("body_index", "J03 W02 W04", "entity_id:l index_date:d body_index:f", roles_sql("SELECT entity_id, index_date, body_index FROM body"))
def _(t):
    return pit.body_index(usable(t, "measurements", start=since(years=RULES.body_window_years)), RULES)


@query("latest_status_by_precedence", "W03", "entity_id:l index_date:d smoking_status:s",
       roles_sql("SELECT entity_id, index_date, smoking_status FROM smoke"))
def _(t):
    return pit.latest_status(usable(t, "lifestyle"))


@query("highest_level_in_window", "W05", "entity_id:l index_date:d alcohol_level:s",
       roles_sql("SELECT entity_id, index_date, alcohol_level FROM alc"))
def _(t):
    return pit.highest_level(usable(t, "lifestyle", start=since(years=RULES.alcohol_window_years)), RULES.alcohol_window_years)


@query("same_day_anti_join", "J04", "entity_id:l index_date:d record_date:d units:f", roles_sql("""
SELECT entity_id, index_date, record_date, units FROM alcwin u WHERE kind = 'alcohol_units_week' AND NOT EXISTS
 (SELECT 1 FROM alcwin c WHERE c.kind = 'alcohol' AND c.entity_id = u.entity_id AND c.index_date = u.index_date AND c.record_date = u.record_date)"""))
def _(t):
    al = pit.alcohol_window(usable(t, "lifestyle"), RULES.alcohol_window_years)
    return pit.same_day_anti(al.where("kind = 'alcohol_units_week'"), al.where("kind = 'alcohol'"))


@query("superseded_evidence", "J05", "entity_id:l index_date:d record_date:d", roles_sql("SELECT entity_id, index_date, record_date FROM anaemia"))
def _(t):
    return pit.sex_cut_evidence(usable(t, "measurements"), RULES.sex_cuts[0], RULES.windows[5])


@query("reading_count_rule", "A04", "entity_id:l index_date:d record_date:d", roles_sql("SELECT entity_id, index_date, record_date FROM pressure"))
def _(t):
    return pit.reading_evidence(usable(t, "measurements"), RULES.readings[0], RULES.windows[4])


@query("evidence_pivot", "A03 C02", "entity_id:l index_date:d alpha:l beta:l gamma:l delta:l pressure:l anaemia:l",
       roles_sql("SELECT * FROM binaries"))
def _(t):
    rows = elig(t)
    return pit.pivot_evidence(pit.evidence(usable(t, "conditions", rows), usable(t, "measurements", rows), RULES), RULES.windows)


@query("latest_evidence_date", "A02", "entity_id:l index_date:d max_record_date:d", roles_sql("""
SELECT entity_id, index_date, max(record_date) AS max_record_date FROM (SELECT entity_id, index_date, record_date FROM itemwin UNION ALL SELECT entity_id, index_date, record_date FROM smokewin) GROUP BY ALL"""))
def _(t):
    rows = elig(t)
    rx = usable(t, "prescriptions", rows, since(days=120)).where(pit.drug_in_window(120, RULES.excluded_chapters))
    return pit.latest_evidence([rx, usable(t, "lifestyle", rows).where("kind = 'smoking'")])


@query("longest_prefix_match", "J06 P20", "code:s prefix:s code_status:s n:l", roles_sql("""
SELECT code, prefix, code_status, count(*) AS n FROM encounters JOIN best_rule USING (code) GROUP BY ALL"""))
def _(t):
    hit = pit.longest_prefix(roles.encounters(t), "code", roles.code_rules(t), roles.CODE_LENGTHS)
    return hit.groupBy("code", "prefix", "code_status").agg(F.count(F.lit(1)).alias("n"))


def statused(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    pairs = pit.outcome_pairs(elig(t) if rows is None else rows, roles.encounters(t), RULES.outcome)
    return pit.outcome_status(pit.longest_prefix(pairs, "code", roles.code_rules(t), roles.CODE_LENGTHS), RULES.outcome)


@query("outcome_status", "J07 P09", "status:s pairs:l rows:l first:d", roles_sql("""
SELECT status, count(*) AS pairs, count(DISTINCT CAST(entity_id AS VARCHAR) || '|' || CAST(index_date AS VARCHAR)) AS rows, min(event_date) AS first FROM stat GROUP BY 1"""))
def _(t):
    return statused(t).groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("entity_id", "index_date").alias("rows"),
                                             F.min("event_date").alias("first"))


@query("first_event", "A06", "entity_id:l index_date:d first_event_date:d outcome:l", roles_sql("""
SELECT entity_id, index_date, first_event_date, CAST(first_event_date IS NOT NULL AS INTEGER) AS outcome FROM elig LEFT JOIN first_ev USING (entity_id, index_date)"""))
def _(t):
    rows = elig(t)
    return rows.join(pit.first_event(statused(t, rows)), pit.ROW, "left").withColumn("outcome", F.col("first_event_date").isNotNull().cast("int"))


@query("outcome_audit", "A07", "code_system:s code_block:s kind:s code_status:s encounter_type:s admission_method:s position:s status:s n_records:l", roles_sql("""
SELECT code_system, code_block, kind, code_status, encounter_type, coalesce(admission_method, 'unknown') AS admission_method,
 CASE WHEN position = 1 THEN 'principal' ELSE 'secondary' END AS position, status, count(*) AS n_records FROM stat GROUP BY ALL"""))
def _(t):
    return pit.outcome_audit(statused(t))


@query("interval_overlap", "W01", "entity_id:l intervals:l overlap_count:l", """
WITH m AS (SELECT o_custkey AS entity_id, o_orderstatus, min(CAST(o_orderdate AS DATE)) AS s, CASE WHEN max(o_orderdate) < DATE '2001-06-01' THEN max(CAST(o_orderdate AS DATE)) END AS e FROM orders GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s, o_orderstatus) AS k, lag(e) OVER (PARTITION BY entity_id ORDER BY s, o_orderstatus) AS pe FROM m)
SELECT entity_id, count(*) AS intervals, count_if(k > 1 AND (pe IS NULL OR s <= pe)) AS overlap_count FROM w GROUP BY 1""")
def _(t):
    d = F.col("o_orderdate").cast("date")
    m = (t.orders.groupBy(F.col("o_custkey").alias("entity_id"), "o_orderstatus").agg(F.min(d).alias("start_date"), F.max(d).alias("m"))
         .withColumn("end_date", F.when(F.col("m") < F.lit("2001-06-01").cast("date"), F.col("m"))))
    return (pit.overlapping_intervals(m, ["start_date", "o_orderstatus"]).groupBy("entity_id")
            .agg(F.count(F.lit(1)).alias("intervals"), F.count_if("overlaps").alias("overlap_count")))


CHECK_SQL = """SELECT 'index_null_key' AS check_name, count_if(entity_id IS NULL OR index_date IS NULL) AS n FROM idx UNION ALL SELECT 'index_repeated', count(*) - (SELECT count(*) FROM (SELECT DISTINCT entity_id, index_date FROM idx)) FROM idx
 UNION ALL SELECT 'persons_null_key', count_if(entity_id IS NULL OR start_date IS NULL) FROM persons UNION ALL SELECT 'persons_end_before_start', count_if(end_date < start_date) FROM persons
 UNION ALL SELECT 'persons_overlapping', count_if(k > 1 AND (pe IS NULL OR start_date <= pe)) FROM (SELECT start_date, row_number() OVER w AS k, lag(end_date) OVER w AS pe FROM persons WINDOW w AS (PARTITION BY entity_id ORDER BY start_date, end_date NULLS FIRST))"""
CHECK_SQL += "".join(f" UNION ALL SELECT 'persons_varying_{f}', count_if(n > 1) FROM (SELECT entity_id, count(DISTINCT coalesce(CAST({f} AS VARCHAR), '')) AS n FROM persons GROUP BY 1)" for f in pit.PERSON_FACTS)
for _name, _date, _available in (("prescriptions", "record_date", True), ("conditions", "record_date", True), ("measurements", "record_date", True), ("lifestyle", "record_date", True), ("encounters", "event_date", False)):
    CHECK_SQL += f" UNION ALL SELECT '{_name}_null_key', count_if(entity_id IS NULL OR {_date} IS NULL) FROM {_name}"
    CHECK_SQL += f" UNION ALL SELECT '{_name}_available_before_record', coalesce(count_if(available_date < {_date}), 0) FROM {_name}" if _available else ""


@query("derivation_input_problems", "A59", "check_name:s n:l", roles_sql(CHECK_SQL))
def _(t):
    return pit.input_problems(roles.event_tables(t), roles.index_table(t))


DERIVED = ("entity_id:l index_date:d max_record_date:d outcome:l first_event_date:d age:f sex:s site:s item_count:l body_index:f "
           "smoking_status:s alcohol_level:s alpha:l beta:l gamma:l delta:l pressure:l anaemia:l followup_end_date:d")
DERIVED_SQL = roles_sql("""
SELECT e.entity_id, e.index_date, max_record_date, CAST(first_event_date IS NOT NULL AS INTEGER) AS outcome, first_event_date, age, sex, site,
 coalesce(item_count, 0) AS item_count, body_index, smoking_status, alcohol_level, coalesce(alpha, 0) AS alpha, coalesce(beta, 0) AS beta, coalesce(gamma, 0) AS gamma,
 coalesce(delta, 0) AS delta, coalesce(pressure, 0) AS pressure, coalesce(anaemia, 0) AS anaemia, least(death_date, end_date, index_date + 179) AS followup_end_date
FROM elig e LEFT JOIN used USING (entity_id, index_date) LEFT JOIN first_ev USING (entity_id, index_date) LEFT JOIN items USING (entity_id, index_date)
LEFT JOIN body USING (entity_id, index_date) LEFT JOIN smoke USING (entity_id, index_date) LEFT JOIN alc USING (entity_id, index_date) LEFT JOIN binaries USING (entity_id, index_date)""")


@query("pit_features", "A08 C06", DERIVED, DERIVED_SQL)
def _(t):
    return pit.derive(roles.event_tables(t), roles.index_table(t), roles.code_rules(t), roles.CODE_LENGTHS, RULES)


@query("derivation_leak_check", "A08 A15", "rows:l leaks:l",
       roles_sql("SELECT count(*) AS rows, count_if(max_record_date >= index_date) AS leaks FROM elig LEFT JOIN used USING (entity_id, index_date)"))
def _(t):
    return pit.leak_count(pit.derive(roles.event_tables(t), roles.index_table(t), roles.code_rules(t), roles.CODE_LENGTHS, RULES))
