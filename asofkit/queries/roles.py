"""The canonical event tables played by the shared test tables, once in Spark and once in SQL.

Both sides state the same mapping; whole tables are read, nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators.pit import DerivationRules, OutcomeRules, ReadingRule, SexCutRule, WindowRule
from asofkit.queries.registry import Tables

INDEX_DATES = ("1997-07-01", "1998-07-01", "1999-07-01")

CODE_RULES = [  # prefix, block, kind, status
    ("BRAND#1", "block-1", "fracture", "CANDIDATE"),
    ("BRAND#12", "block-12", "fall", "CANDIDATE"),
    ("BRAND#2", "block-2", "fracture", "REVIEW"),
    ("BRAND#25", "block-25", "fracture", "EXCLUDE"),
    ("BRAND#3", "block-3", "fall", "CANDIDATE"),
]

RULES = DerivationRules(
    age_min=65.0, lag_days=14, undeclared=frozenset({"lifestyle"}), item_window_days=120, excluded_chapters=(3, 7),
    body_window_years=2, pair_gap_days=30, alcohol_window_years=3,
    windows=(WindowRule("alpha"), WindowRule("beta", lookback_years=1), WindowRule("gamma", lookback_days=400, resolved_by=("alpha",)),
             WindowRule("delta", age_at_record_min=70.0), WindowRule("pressure", lookback_years=2), WindowRule("anaemia")),
    readings=(ReadingRule("pressure", 2, (("sbp", ">=", 150.0), ("dbp", ">=", 80.0))),),
    sex_cuts=(SexCutRule("anaemia", "hb_g_dl", {"male": 13.0, "female": 11.5}),),
    outcome=OutcomeRules(days=180),
)


def index_table(t: Tables) -> DataFrame:
    dates = F.array(*[F.lit(d).cast("date") for d in INDEX_DATES])
    return t.orders.select(F.col("o_custkey").alias("entity_id")).distinct().select("entity_id", F.explode(dates).alias("index_date"))


def intervals(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    out = (t.orders.groupBy(F.col("o_custkey").alias("entity_id"), F.floor(F.year("o_orderdate") / 2).alias("block"))
           .agg(F.min(day).alias("start_date"), F.max(day).alias("last_date")))
    return out.select("entity_id", "start_date", F.when(F.year("last_date") < 2001, F.col("last_date")).alias("end_date"))


def persons(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    c = t.customer.where("c_nationkey <> 7").select(
        F.col("c_custkey").alias("entity_id"),
        F.when(F.col("c_nationkey") != 3, F.date_add(F.lit("1905-01-01").cast("date"), (F.floor(F.abs("c_acctbal")) % 14000).cast("int"))).alias("birth_date"),
        F.when(seg == "FURNITURE", "unknown").when(seg.isin("MACHINERY", "AUTOMOBILE"), "male").otherwise("female").alias("sex"),
        F.col("c_nationkey").cast("string").alias("site"),
        F.when(F.col("c_acctbal") < 500, F.lit("1998-06-30").cast("date")).alias("death_date"))
    return c.join(intervals(t), "entity_id")


def order_lines(t: Tables, *columns: Column) -> DataFrame:
    """Lines with their order; ``columns`` of a line are made before the join, so that it moves no more than them."""
    lines = t.lineitem.withColumn("sd", F.col("l_shipdate").cast("date"))
    lines = lines.select("l_orderkey", *columns) if columns else lines
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("od", F.col("o_orderdate").cast("date"))


def prescriptions(t: Tables) -> DataFrame:
    lines = order_lines(t, F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 20).alias("chapter"), (F.col("l_linestatus") == "O").alias("is_drug"), F.col("sd"))
    return lines.select(
        F.col("o_custkey").alias("entity_id"), "item", "chapter", "is_drug", F.col("od").alias("record_date"), F.greatest("od", "sd").alias("available_date"))


def conditions(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    name = F.element_at(F.array(*[F.lit(v) for v in ("alpha", "beta", "gamma", "delta", "other")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("entity_id"), name.alias("feature"), d.alias("record_date"),
                           F.date_add(d, (F.floor("o_totalprice") % 60).cast("int")).alias("available_date"))


def measurements(t: Tables) -> DataFrame:
    k = F.concat("l_returnflag", "l_linestatus")
    q = F.col("l_quantity")
    kind = (F.when(k == "RF", "weight_kg").when(k == "AF", "height_m").when(k == "NF", "bmi")
            .when(k == "RO", "sbp").when(k == "AO", "dbp").otherwise("hb_g_dl"))
    value = (F.when(k == "RF", 40 + q * 2).when(k == "AF", 1.4 + q / 100).when(k == "NF", 8 + q * 2)
             .when(k == "RO", 100 + q * 2).when(k == "AO", 50 + q).otherwise(9 + q / 8))
    rec = F.date_add("od", F.col("l_linenumber"))
    lines = order_lines(t, F.col("l_linenumber"), kind.alias("kind"), value.alias("value"))
    return lines.select(F.col("o_custkey").alias("entity_id"), "kind", "value",
                                 rec.alias("record_date"), rec.alias("available_date"))


def lifestyle(t: Tables) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    price = F.floor("o_totalprice")
    st = F.col("o_orderstatus")
    level = F.element_at(F.array(*[F.lit(v) for v in ("zero", "lower_risk", "previous_higher_risk_or_harmful", "higher_risk", "harmful")]), (price % 5 + 1).cast("int"))
    return t.orders.select(
        F.col("o_custkey").alias("entity_id"),
        F.when(st == "F", "smoking").when(st == "O", "alcohol").otherwise("alcohol_units_week").alias("kind"),
        F.when(st == "F", F.when(digit <= 3, "never").when(digit == 4, "ex").otherwise("current")).when(st == "O", level).alias("value"),
        F.when(st == "P", (price % 60).cast("double")).alias("units"),
        F.trunc("o_orderdate", "month").alias("record_date"), F.lit(None).cast("date").alias("available_date"))


def encounters(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    ty = F.col("p_type")
    return order_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("entity_id"), F.col("l_orderkey").alias("encounter_id"),
        F.when(F.col("l_linestatus") == "F", "hospital_admission").when(F.col("l_tax") > 0.06, "other").otherwise("ed_attendance").alias("encounter_type"),
        F.when(flag == "R", "emergency").when(flag == "A", "elective").alias("admission_method"),
        F.when(F.col("od") < F.col("sd"), F.col("od")).alias("spell_start_date"), F.col("sd").alias("event_date"),
        F.upper(F.trim(F.replace(F.col("p_brand"), F.lit("."), F.lit("")))).alias("code"), F.col("l_linenumber").alias("position"),
        F.when(ty == "ECONOMY", "ICD-9-CM").when(ty == "PROMO", "ICD-10-CM").otherwise("ICD-10").alias("code_system"))


def code_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(CODE_RULES, "prefix string, code_block string, kind string, code_status string")


CODE_LENGTHS = (7, 8)


def event_tables(t: Tables) -> dict[str, DataFrame]:
    return {"persons": persons(t), "conditions": conditions(t), "prescriptions": prescriptions(t), "measurements": measurements(t),
            "lifestyle": lifestyle(t), "encounters": encounters(t)}


# ------------------------------------------------------------------ the same in SQL
_DATES = ", ".join(f"DATE '{d}'" for d in INDEX_DATES)
_CODES = ", ".join(str(r) for r in CODE_RULES)
ROLES_SQL = f"""
idx AS (SELECT entity_id, unnest([{_DATES}]) AS index_date FROM (SELECT DISTINCT o_custkey AS entity_id FROM orders)),
intervals AS (SELECT o_custkey AS entity_id, min(CAST(o_orderdate AS DATE)) AS start_date,
  CASE WHEN year(max(o_orderdate)) < 2001 THEN max(CAST(o_orderdate AS DATE)) END AS end_date
  FROM orders GROUP BY o_custkey, year(o_orderdate) // 2),
persons AS (SELECT c_custkey AS entity_id,
  CASE WHEN c_nationkey <> 3 THEN DATE '1905-01-01' + CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 14000 AS INTEGER) END AS birth_date,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'unknown' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'male' ELSE 'female' END AS sex,
  CAST(c_nationkey AS VARCHAR) AS site, CASE WHEN c_acctbal < 500 THEN DATE '1998-06-30' END AS death_date, start_date, end_date
  FROM customer JOIN intervals ON c_custkey = entity_id WHERE c_nationkey <> 7),
lines AS (SELECT *, CAST(o_orderdate AS DATE) AS od, CAST(l_shipdate AS DATE) AS sd FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
prescriptions AS (SELECT o_custkey AS entity_id, l_partkey AS item, l_suppkey % 20 AS chapter, l_linestatus = 'O' AS is_drug,
  od AS record_date, greatest(od, sd) AS available_date FROM lines),
conditions AS (SELECT o_custkey AS entity_id, ['alpha', 'beta', 'gamma', 'delta', 'other'][CAST(o_orderpriority[1] AS INTEGER)] AS feature,
  CAST(o_orderdate AS DATE) AS record_date, CAST(o_orderdate AS DATE) + CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS INTEGER) AS available_date FROM orders),
measurements AS (SELECT o_custkey AS entity_id,
  CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'weight_kg' WHEN 'AF' THEN 'height_m' WHEN 'NF' THEN 'bmi' WHEN 'RO' THEN 'sbp' WHEN 'AO' THEN 'dbp' ELSE 'hb_g_dl' END AS kind,
  CASE l_returnflag || l_linestatus WHEN 'RF' THEN 40 + l_quantity * 2 WHEN 'AF' THEN CAST(1.4 AS DOUBLE) + l_quantity / 100 WHEN 'NF' THEN 8 + l_quantity * 2 WHEN 'RO' THEN 100 + l_quantity * 2 WHEN 'AO' THEN 50 + l_quantity ELSE 9 + l_quantity / 8 END AS value,
  od + l_linenumber AS record_date, od + l_linenumber AS available_date FROM lines),
lifestyle AS (SELECT o_custkey AS entity_id,
  CASE o_orderstatus WHEN 'F' THEN 'smoking' WHEN 'O' THEN 'alcohol' ELSE 'alcohol_units_week' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN CASE WHEN CAST(o_orderpriority[1] AS INTEGER) <= 3 THEN 'never' WHEN CAST(o_orderpriority[1] AS INTEGER) = 4 THEN 'ex' ELSE 'current' END
   WHEN 'O' THEN ['zero', 'lower_risk', 'previous_higher_risk_or_harmful', 'higher_risk', 'harmful'][CAST(floor(o_totalprice) AS BIGINT) % 5 + 1] END AS value,
  CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS DOUBLE) END AS units,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS record_date, CAST(NULL AS DATE) AS available_date FROM orders),
encounters AS (SELECT o_custkey AS entity_id, l_orderkey AS encounter_id,
  CASE WHEN l_linestatus = 'F' THEN 'hospital_admission' WHEN l_tax > 0.06 THEN 'other' ELSE 'ed_attendance' END AS encounter_type,
  CASE l_returnflag WHEN 'R' THEN 'emergency' WHEN 'A' THEN 'elective' END AS admission_method,
  CASE WHEN od < sd THEN od END AS spell_start_date, sd AS event_date, upper(trim(replace(p_brand, '.', ''))) AS code, l_linenumber AS position,
  CASE p_type WHEN 'ECONOMY' THEN 'ICD-9-CM' WHEN 'PROMO' THEN 'ICD-10-CM' ELSE 'ICD-10' END AS code_system
  FROM lines JOIN part ON l_partkey = p_partkey),
code_rules AS (SELECT * FROM (VALUES {_CODES}) AS v(prefix, code_block, kind, code_status)),
asof_rows AS (SELECT * FROM (SELECT i.entity_id, i.index_date, p.birth_date, p.sex, p.site, p.death_date, p.start_date, p.end_date, p.entity_id IS NOT NULL AS has_person,
  coalesce(p.start_date <= i.index_date AND (p.end_date IS NULL OR p.end_date >= i.index_date), false) AS covers,
  row_number() OVER (PARTITION BY i.entity_id, i.index_date ORDER BY coalesce(p.start_date <= i.index_date AND (p.end_date IS NULL OR p.end_date >= i.index_date), false) DESC, p.start_date) AS rk
  FROM idx i LEFT JOIN persons p USING (entity_id)) WHERE rk = 1),
reasons AS (SELECT *, (index_date - birth_date) / 365.25 AS age, CASE WHEN NOT has_person THEN 'missing_person_record' WHEN birth_date IS NULL THEN 'missing_date_of_birth'
  WHEN coalesce(sex, '') NOT IN ('female', 'male') THEN 'invalid_sex' WHEN death_date < index_date THEN 'died_before_index'
  WHEN NOT covers THEN 'not_member_at_index' WHEN (index_date - birth_date) / 365.25 < 65 THEN 'age_below_minimum' END AS reason FROM asof_rows),
elig AS (SELECT * FROM reasons WHERE reason IS NULL),
rx AS (SELECT e.entity_id, e.index_date, r.* EXCLUDE (entity_id) FROM elig e JOIN prescriptions r USING (entity_id) WHERE record_date < index_date AND NOT coalesce(available_date >= index_date, false)),
cond AS (SELECT e.entity_id, e.index_date, e.birth_date, r.* EXCLUDE (entity_id) FROM elig e JOIN conditions r USING (entity_id) WHERE record_date < index_date AND NOT coalesce(available_date >= index_date, false)),
meas AS (SELECT e.entity_id, e.index_date, e.birth_date, e.sex, r.* EXCLUDE (entity_id) FROM elig e JOIN measurements r USING (entity_id) WHERE record_date < index_date AND NOT coalesce(available_date >= index_date, false)),
life AS (SELECT e.entity_id, e.index_date, r.* EXCLUDE (entity_id) FROM elig e JOIN lifestyle r USING (entity_id) WHERE record_date < index_date - 14 AND NOT coalesce(available_date >= index_date, false)),
itemwin AS (SELECT * FROM rx WHERE is_drug AND chapter NOT IN (3, 7) AND record_date >= index_date - 120),
bodywin AS (SELECT * FROM meas WHERE kind IN ('bmi', 'weight_kg', 'height_m') AND record_date >= CAST(index_date - INTERVAL 2 YEAR AS DATE)),
smokewin AS (SELECT * FROM life WHERE kind = 'smoking'),
alcwin AS (SELECT * FROM life WHERE kind IN ('alcohol', 'alcohol_units_week') AND record_date >= CAST(index_date - INTERVAL 3 YEAR AS DATE)),
items AS (SELECT entity_id, index_date, count(DISTINCT item) AS item_count FROM itemwin GROUP BY ALL),
rec_bmi AS (SELECT entity_id, index_date, avg(value) AS recorded FROM (SELECT *, max(record_date) OVER (PARTITION BY entity_id, index_date) AS m FROM bodywin WHERE kind = 'bmi' AND value BETWEEN 10 AND 80) WHERE record_date = m GROUP BY ALL),
heights AS (SELECT entity_id, index_date, record_date, max(value) AS hv FROM bodywin WHERE kind = 'height_m' GROUP BY ALL),
weights AS (SELECT *, row_number() OVER () AS wid FROM bodywin WHERE kind = 'weight_kg'),
matched AS (SELECT entity_id, index_date, record_date, value, match_date, match_value FROM (SELECT w.entity_id, w.index_date, w.record_date, w.value, h.record_date AS match_date, h.hv AS match_value,
  row_number() OVER (PARTITION BY w.wid ORDER BY abs(w.record_date - h.record_date), h.record_date DESC) AS rk
  FROM weights w JOIN heights h ON w.entity_id = h.entity_id AND w.index_date = h.index_date AND abs(w.record_date - h.record_date) <= 30) WHERE rk = 1),
comp_bmi AS (SELECT entity_id, index_date, avg(bmi) AS computed FROM (SELECT *, max(record_date) OVER (PARTITION BY entity_id, index_date) AS m FROM (SELECT *, value / (match_value * match_value) AS bmi FROM matched) WHERE bmi BETWEEN 10 AND 80) WHERE record_date = m GROUP BY ALL),
body AS (SELECT entity_id, index_date, coalesce(recorded, computed) AS body_index FROM rec_bmi FULL JOIN comp_bmi USING (entity_id, index_date)),
smoke AS (SELECT entity_id, index_date, CASE WHEN last_value = 'never' AND ever THEN 'ex' ELSE last_value END AS smoking_status FROM
  (SELECT entity_id, index_date, arg_max(value, strftime(record_date, '%Y%m%d') || CAST(list_position(['never', 'ex', 'current'], value) AS VARCHAR)) AS last_value, bool_or(value <> 'never') AS ever FROM smokewin GROUP BY ALL)),
alc_ranked AS (SELECT entity_id, index_date, list_position(['zero', 'lower_risk', 'previous_higher_risk_or_harmful', 'higher_risk', 'harmful'], value) AS r FROM alcwin WHERE kind = 'alcohol'
  UNION ALL SELECT u.entity_id, u.index_date, CASE WHEN units = 0 THEN 1 WHEN units < 21 THEN 2 WHEN units < 49 THEN 4 ELSE 5 END FROM alcwin u WHERE kind = 'alcohol_units_week'
   AND NOT EXISTS (SELECT 1 FROM alcwin c WHERE c.kind = 'alcohol' AND c.entity_id = u.entity_id AND c.index_date = u.index_date AND c.record_date = u.record_date)),
alc AS (SELECT entity_id, index_date, ['zero', 'lower_risk', 'previous_higher_risk_or_harmful', 'higher_risk', 'harmful'][max(r)] AS alcohol_level FROM alc_ranked GROUP BY ALL),
pressure_win AS (SELECT * FROM meas WHERE kind IN ('sbp', 'dbp') AND record_date >= CAST(index_date - INTERVAL 2 YEAR AS DATE)),
press_hits AS (SELECT entity_id, index_date, kind, count(*) AS n, max(record_date) AS d FROM pressure_win WHERE (kind = 'sbp' AND value >= 150) OR (kind = 'dbp' AND value >= 80) GROUP BY ALL),
pressure AS (SELECT entity_id, index_date, max(d) AS record_date FROM press_hits WHERE n >= 2 GROUP BY ALL),
hb AS (SELECT *, value < CASE sex WHEN 'male' THEN 13.0 ELSE 11.5 END AS low FROM meas WHERE kind = 'hb_g_dl'),
anaemia AS (SELECT entity_id, index_date, max(record_date) FILTER (WHERE low) AS record_date FROM hb GROUP BY ALL
  HAVING max(record_date) FILTER (WHERE low) IS NOT NULL AND NOT coalesce(max(record_date) FILTER (WHERE NOT low) > max(record_date) FILTER (WHERE low), false)),
ev AS (SELECT entity_id, index_date, feature, record_date FROM cond WHERE feature = 'alpha' OR (feature = 'beta' AND record_date >= CAST(index_date - INTERVAL 1 YEAR AS DATE))
   OR (feature = 'gamma' AND record_date >= index_date - 400) OR (feature = 'delta' AND (record_date - birth_date) / 365.25 >= 70)
  UNION ALL SELECT entity_id, index_date, 'pressure', record_date FROM pressure UNION ALL SELECT entity_id, index_date, 'anaemia', record_date FROM anaemia),
latest AS (SELECT entity_id, index_date, max(record_date) FILTER (WHERE feature = 'alpha') AS alpha, max(record_date) FILTER (WHERE feature = 'beta') AS beta,
  max(record_date) FILTER (WHERE feature = 'gamma') AS gamma, max(record_date) FILTER (WHERE feature = 'delta') AS delta,
  max(record_date) FILTER (WHERE feature = 'pressure') AS pressure, max(record_date) FILTER (WHERE feature = 'anaemia') AS anaemia FROM ev GROUP BY ALL),
binaries AS (SELECT entity_id, index_date, CAST(alpha IS NOT NULL AS INTEGER) AS alpha, CAST(beta IS NOT NULL AS INTEGER) AS beta,
  CAST(gamma IS NOT NULL AND NOT coalesce(alpha >= gamma, false) AS INTEGER) AS gamma, CAST(delta IS NOT NULL AS INTEGER) AS delta,
  CAST(pressure IS NOT NULL AS INTEGER) AS pressure, CAST(anaemia IS NOT NULL AS INTEGER) AS anaemia FROM latest),
used AS (SELECT entity_id, index_date, max(record_date) AS max_record_date FROM (SELECT entity_id, index_date, record_date FROM ev UNION ALL SELECT entity_id, index_date, record_date FROM itemwin
  UNION ALL SELECT entity_id, index_date, record_date FROM bodywin UNION ALL SELECT entity_id, index_date, record_date FROM smokewin UNION ALL SELECT entity_id, index_date, record_date FROM alcwin
  UNION ALL SELECT entity_id, index_date, record_date FROM pressure_win UNION ALL SELECT entity_id, index_date, record_date FROM hb) GROUP BY ALL),
best_rule AS (SELECT * FROM (SELECT c.code, r.*, row_number() OVER (PARTITION BY c.code ORDER BY length(r.prefix) DESC) AS rk FROM (SELECT DISTINCT code FROM encounters) c JOIN code_rules r ON starts_with(c.code, r.prefix)) WHERE rk = 1),
enc AS (SELECT e.entity_id, e.index_date, n.* EXCLUDE (entity_id), b.prefix, b.code_block, b.kind, b.code_status FROM elig e JOIN encounters n USING (entity_id) JOIN best_rule b USING (code) WHERE event_date BETWEEN index_date AND index_date + 179),
stat AS (SELECT *, CASE WHEN code_status = 'REVIEW' THEN 'icd9cm_review_not_counted' WHEN code_status = 'EXCLUDE' THEN 'icd9cm_excluded_code'
  WHEN code_system = 'ICD-10-CM' AND length(code) = 7 AND code[7] NOT IN ('A', 'B', 'C') THEN 'icd10cm_excluded_7th_character'
  WHEN encounter_type = 'other' THEN 'encounter_type_not_qualifying' WHEN spell_start_date < index_date THEN 'spell_started_before_index'
  WHEN encounter_type = 'hospital_admission' AND admission_method IS NULL AND code_status = 'CANDIDATE' THEN 'unknown_admission_method'
  WHEN encounter_type = 'hospital_admission' AND admission_method IS NOT NULL AND admission_method NOT IN ('emergency', 'urgent', 'via_ed') THEN 'admission_not_non_elective'
  WHEN kind = 'fracture' AND position <> 1 THEN 'position_rule' ELSE 'qualifying' END AS status FROM enc),
first_ev AS (SELECT entity_id, index_date, min(event_date) AS first_event_date FROM stat WHERE status = 'qualifying' GROUP BY ALL)
"""


def roles_sql(select: str) -> str:
    return f"WITH {ROLES_SQL} {select}"
