"""DuckDB SQL for every registered query, over the same tables."""

from __future__ import annotations

NY = "America/New_York"
ORACLE: dict[str, str] = {}
PRE = "HKQuantityTypeIdentifier"
STEPS, HRV, RHR = PRE + "StepCount", PRE + "HeartRateVariabilitySDNN", PRE + "RestingHeartRate"
SLEEP, WORKOUT = "HKCategoryTypeIdentifierSleepAnalysis", "HKWorkoutTypeIdentifier"
SPO2, RESP, WEIGHT = PRE + "OxygenSaturation", PRE + "RespiratoryRate", PRE + "BodyMass"
VO2, ENERGY = PRE + "VO2Max", PRE + "ActiveEnergyBurned"
BASE = (STEPS, HRV, RHR, SLEEP, WORKOUT)
QUANTITIES = (STEPS, HRV, RHR)


def rnd(x, n):
    """Half-up rounding of a double snapped to eight decimals."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), {n}) AS DOUBLE)"


def day(ts, tz=NY):
    return f"CAST((({ts}) AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS DATE)"


def wall(ts, tz=NY):
    return f"((({ts}) AT TIME ZONE 'UTC') AT TIME ZONE '{tz}')"


def midnight(d, tz=NY):
    """UTC wall-clock time of a local day's first instant."""
    return f"((CAST({d} AS TIMESTAMP) AT TIME ZONE '{tz}') AT TIME ZONE 'UTC')"


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_NULLS = "NULL::TIMESTAMP ended_at, NULL::VARCHAR wtype, NULL::DOUBLE wsec, NULL::DOUBLE wcal"
_DEV = "CASE WHEN event_id % 4 = 0 THEN 'Apple Watch Series 9' ELSE 'Oura Ring' END"


def _branch(metric):
    def plain(types, value, unit, device=_DEV, tail=_NULLS, seq="event_id * 2 + 1"):
        return (f"SELECT user_id, '{metric}' metric_type, {value} AS value, '{unit}' unit, {device} source_device, "
                f"ts started_at, {tail}, {seq} seq FROM events WHERE event_type IN ({types})")

    if metric == STEPS:
        return plain("'view','click','error','signup','purchase'", "value", "count", "'iPhone'", seq="event_id * 2")
    if metric == HRV:
        return plain("'view','click'", "value", "ms")
    if metric == RHR:
        return plain("'error'", "value", "count/min")
    if metric == SLEEP:
        return plain("'signup'", f"CAST({_K} % 6 AS DOUBLE)", "category",
                     tail=f"ts + to_minutes(10 + {_K}) ended_at, NULL::VARCHAR wtype, NULL::DOUBLE wsec, NULL::DOUBLE wcal")
    if metric == WORKOUT:
        return plain("'purchase'", f"CAST(60 * {_K} AS DOUBLE)", "seconds", tail=(
            f"ts + to_minutes({_K}) ended_at, CASE {_K} % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Cycling' ELSE 'Yoga' END wtype, "
            f"CAST(60 * {_K} AS DOUBLE) wsec, value wcal"))
    if metric == SPO2:
        return plain("'view'", f"CAST(0.9 AS DOUBLE) + CAST({_K} AS DOUBLE) / 1000", "%")
    if metric == RESP:
        return plain("'click'", f"12 + CAST({_K} AS DOUBLE) / 10", "count/min")
    if metric == WEIGHT:
        return plain("'signup'", f"60 + CAST({_K} AS DOUBLE) / 5", "kg")
    if metric == VO2:
        return plain("'error'", f"35 + CAST({_K} AS DOUBLE) / 5", "ml/kg·min")
    if metric == ENERGY:
        return plain("'purchase'", "value", "kcal")
    raise KeyError(metric)


def samples(*metrics):
    return "samples AS (" + " UNION ALL ".join(_branch(m) for m in metrics or BASE) + ")"


LONG = f"""long AS (SELECT o_custkey % 100 user_id,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN '{STEPS}' ELSE '{RHR}' END metric_type,
  o_totalprice AS value, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'count' ELSE 'count/min' END unit,
  'iPhone' source_device, o_orderdate + INTERVAL 12 HOUR started_at, o_orderkey seq FROM orders)"""

Q_ONLY = "metric_type LIKE 'HKQuantityType%'"


def daily(name="daily", src="samples", where="TRUE", tz=NY):
    return f"""{name} AS (SELECT user_id, metric_type, {day('started_at', tz)} AS date, {rnd('avg(value)', 4)} avg_value,
  min(value) min_value, max(value) max_value, {rnd('sum(value)', 4)} sum_value, count(value) sample_count, max(unit) unit
  FROM {src} WHERE value IS NOT NULL AND ({where}) GROUP BY 1, 2, 3)"""


CUM = f"metric_type = '{STEPS}'"
WMEAN = rnd("sum(sum_value) / sum(sample_count)", 2)
TMEAN = rnd("avg(sum_value)", 1)
KMEAN = f"CASE WHEN {CUM} THEN {TMEAN} ELSE {WMEAN} END"
VTYPE = f"CASE WHEN {CUM} THEN 'daily_total' ELSE 'daily_avg' END"
KVAL = f"CASE WHEN {CUM} THEN sum_value ELSE avg_value END"
POINT = "user_id, metric_type, date, avg_value, min_value, max_value, sum_value, sample_count"


def add(name, *parts):
    *ctes, body = parts
    ORACLE[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def win(days, as_of="2024-01-31", col="started_at"):
    return f"{day(col)} BETWEEN DATE '{as_of}' - {days} AND DATE '{as_of}'"


# --- scans -----------------------------------------------------------------
add("scan_recent", samples(HRV), f"""SELECT user_id, value, source_device, started_at FROM samples WHERE {win(14)}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, seq DESC) <= 10""")
add("scan_range", samples(RHR), f"""SELECT user_id, value, unit, source_device, started_at FROM samples
WHERE {day('started_at')} >= DATE '2024-01-05' AND {day('started_at')} < DATE '2024-01-20'""")
add("scan_day", samples(), f"""SELECT user_id, metric_type, value, unit, started_at FROM samples
WHERE {day('started_at')} = DATE '2024-01-15'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY metric_type, started_at, seq) <= 1000""")
SUMM = daily("summ", where=f"{Q_ONLY} AND {day('started_at')} < DATE '2024-01-21'")
add("scan_summary", samples(STEPS), SUMM, """SELECT user_id, date, avg_value, sum_value, sample_count FROM summ
WHERE date >= DATE '2024-01-05' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 5""")
add("source_filter", samples(HRV), f"""SELECT user_id, value, source_device, started_at FROM samples
WHERE {win(30)} AND source_device ILIKE '%apple watch%'""")
add("types_before_cutoff", samples(), f"""SELECT DISTINCT metric_type, {Q_ONLY} AS summarisable FROM samples
WHERE {day('started_at')} < DATE '2024-01-21'""")
KIND = "CASE WHEN metric_type LIKE 'HKCategory%' THEN 'category' WHEN metric_type LIKE 'HKWorkout%' THEN 'workout' ELSE 'quantity' END"
add("kind_counts", samples(), f"""SELECT {KIND} kind, count(*) samples, count(DISTINCT metric_type) metric_types
FROM samples GROUP BY 1""")
add("backfill_chunks", LONG, """SELECT metric_type,
CAST(floor(date_diff('day', DATE '2013-01-01', CAST(started_at + INTERVAL 18 YEAR AS DATE)) / 90.0) AS BIGINT) chunk,
count(*) samples, min(started_at + INTERVAL 18 YEAR) first_at, max(started_at + INTERVAL 18 YEAR) last_at
FROM long GROUP BY 1, 2""")
add("local_day", samples(), f"SELECT user_id, {day('started_at')} date, count(*) samples FROM samples GROUP BY 1, 2")
add("day_bounds", LONG, f"""SELECT date, {midnight('date')} starts_at, {midnight('date + 1')} ends_at,
CAST(date_diff('second', {midnight('date')}, {midnight('date + 1')}) / 3600.0 AS DOUBLE) AS hours
FROM (SELECT DISTINCT {day('started_at')} date FROM long)""")
add("type_filter", f"""ids AS (SELECT unnest([p || n, p || n || 'B12', 'HKClinicalTypeIdentifier' || n, 'HK-' || n, '{WORKOUT}']) metric_type
FROM (SELECT '{PRE}' p, upper(event_type[1]) || event_type[2:] n FROM events))""", f"""SELECT metric_type,
regexp_matches(metric_type, '^HK[A-Za-z0-9]+TypeIdentifier[A-Za-z0-9]+$') AS valid,
NOT (starts_with(metric_type, '{WORKOUT}') OR starts_with(metric_type, 'HKClinical')) AS importable, count(*) n
FROM ids GROUP BY 1, 2, 3""")

# --- ingest ----------------------------------------------------------------
PAYLOAD = f"""batches AS (SELECT user_id, event_id batch_no, value, ts, {_K} k,
  CAST(CASE WHEN {_K} < 10 THEN 0 ELSE {_K} // 10 + 1 END AS BIGINT) sample_count FROM events)"""
VERDICT = "CASE WHEN sample_count = 0 THEN 'empty' WHEN sample_count > 9 THEN 'too many samples' WHEN k * 3 > 256 THEN 'string too long' ELSE 'accepted' END"
ACCEPTED = f"""rows AS (SELECT user_id, batch_no, p pos, value + p AS value,
  date_trunc('microsecond', ts) + to_minutes(CAST(CASE WHEN p = sample_count - 1 THEN p ELSE p + 1 END AS BIGINT)) started_at
  FROM (SELECT *, unnest(range(sample_count)) p FROM batches WHERE {VERDICT} = 'accepted'))"""
add("ingest_validate", PAYLOAD, f"SELECT user_id, batch_no, sample_count, {VERDICT} verdict FROM batches")
add("ingest_batch", PAYLOAD, ACCEPTED, f"""SELECT CAST(user_id AS VARCHAR) user_id, '{STEPS}' metric_type, value, started_at, 'Watch' source_device FROM rows
QUALIFY row_number() OVER (PARTITION BY user_id, epoch_ms(started_at) ORDER BY batch_no DESC, pos DESC) = 1""")
add("ingest_parse", PAYLOAD, "SELECT user_id, batch_no, sample_count FROM batches")
RESENT = """resent AS (SELECT * FROM samples UNION ALL SELECT * REPLACE (value + 1 AS value, seq + 1000000000000 AS seq)
  FROM samples WHERE source_device = 'Oura Ring')"""
add("ingest_dedupe", samples(), RESENT, """SELECT user_id, metric_type, started_at, value, source_device, seq FROM resent
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type, epoch_ms(started_at) ORDER BY seq DESC) = 1""")
add("upsert_latest", LONG, f"""SELECT user_id, metric_type, started_at, {rnd('value + 1', 2)} AS value, seq FROM long
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type, started_at ORDER BY seq DESC) = 1""")
add("insert_ignore", LONG, """SELECT user_id, metric_type, started_at, value, seq FROM long WHERE started_at >= TIMESTAMP '1999-01-01'
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type, started_at ORDER BY seq) = 1""")
add("import_top_types", samples(), f"""SELECT replace(replace(metric_type, '{PRE}', ''), 'HKCategoryTypeIdentifier', 'Cat:') metric,
records FROM (SELECT metric_type, count(*) records FROM samples GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)""")
add("unit_normalise", f"""SELECT event_id,
CASE event_type WHEN 'view' THEN '{PRE}DistanceWalkingRunning' WHEN 'click' THEN '{WEIGHT}' WHEN 'error' THEN '{PRE}BodyTemperature'
 WHEN 'signup' THEN '{PRE}HeartRate' ELSE '{PRE}FutureEnergyMetric' END metric_type,
{rnd('''CASE event_type WHEN 'view' THEN value * (CASE WHEN event_id % 2 = 1 THEN 1609.344 ELSE 1000 END)
 WHEN 'click' THEN value * (CASE WHEN event_id % 2 = 1 THEN 0.45359237 ELSE 0.001 END)
 WHEN 'error' THEN (value - 32) * 5 / 9 WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN value END
 ELSE value / 4.184 END''', 6)} AS value,
CASE event_type WHEN 'view' THEN 'm' WHEN 'click' THEN 'kg' WHEN 'error' THEN 'degC' WHEN 'signup' THEN
 CASE WHEN event_id % 2 = 0 THEN 'count/min' ELSE 'unsupported' END ELSE 'kcal' END unit,
CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'preferred' ELSE 'unsupported' END
 WHEN 'purchase' THEN 'fallback' ELSE 'preferred' END unit_status FROM events""")
add("sample_normalise", f"""SELECT user_id, CASE event_type WHEN 'signup' THEN '{SLEEP}' WHEN 'purchase' THEN '{WORKOUT}' ELSE '{HRV}' END metric_type,
ts started_at, CASE event_type WHEN 'signup' THEN CAST(k % 7 AS DOUBLE) WHEN 'purchase' THEN k * 60.0::DOUBLE ELSE value END AS value,
CASE event_type WHEN 'signup' THEN 'category' WHEN 'purchase' THEN 'seconds' ELSE 'ms' END unit,
CASE WHEN k % 2 = 0 THEN 'Ring' ELSE 'Phone' END source_device, CAST(k AS BIGINT) k,
CASE WHEN event_type = 'signup' THEN 'HKCategoryValueSleepAnalysis' || (CASE k % 7 WHEN 0 THEN 'InBed' WHEN 1 THEN 'AsleepUnspecified'
 WHEN 2 THEN 'Awake' WHEN 3 THEN 'AsleepCore' WHEN 4 THEN 'AsleepDeep' WHEN 5 THEN 'AsleepREM' ELSE 'Unknown' END) END sleep_stage,
CASE WHEN event_type = 'purchase' THEN 'HKWorkoutActivityTypeRowing' END workout_type,
CASE WHEN event_type = 'purchase' THEN k * 60.0::DOUBLE END duration_seconds,
CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN k * 100.0::DOUBLE END distance,
CASE WHEN event_type = 'purchase' THEN value END energy FROM (SELECT *, {_K} k FROM events)""")
add("workout_type_dim", """SELECT 'HKWorkoutActivityType' || name raw_name, CASE WHEN name = 'Juggling' THEN 'Unknown' ELSE name END display_name, count(*) n
FROM (SELECT CASE event_type WHEN 'view' THEN 'Running' WHEN 'click' THEN 'WaterPolo' WHEN 'error' THEN 'Other' WHEN 'signup' THEN 'Juggling'
 ELSE 'TaiChi' END name FROM events) GROUP BY 1, 2""")
add("pseudonymise", "SELECT sha256(CAST(user_id AS VARCHAR)) user_hash, count(*) samples FROM events GROUP BY 1")
add("contact_hygiene", """raw AS (SELECT unnest([upper(n || '@Example.com'), '  ' || lower(n) || '@example.com ', n || '@nowhere']) email,
 make_timestamp((1704067200 + c_custkey * 10 + unnest([0, 1, 2])) * 1000000) created_at
 FROM (SELECT c_custkey, replace(c_name, '#', '.') n FROM customer))""", """SELECT lower(trim(email)) email, min(created_at) created_at, count(*) signups
FROM raw WHERE length(lower(trim(email))) <= 254 AND regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') GROUP BY 1""")

# --- daily tiers -----------------------------------------------------------
add("daily_from_raw", samples(), daily(), f"SELECT {POINT}, 'raw' source FROM daily")
add("daily_summary", samples(), daily(where=Q_ONLY), f"SELECT {POINT}, unit FROM daily")


def tiered(start):
    return f"""points AS (SELECT *, CASE WHEN date >= DATE '2024-01-21' THEN 'raw' ELSE 'summary' END source
  FROM daily WHERE {Q_ONLY} AND date BETWEEN {start} AND DATE '2024-01-31')"""


add("tiered_daily", samples(*QUANTITIES), daily(), tiered("DATE '2024-01-31' - 25"), f"SELECT {POINT}, source FROM points")
# On the one day both tiers hold, the raw rows win, so the summary side shows days before it.
add("series_range", samples(*QUANTITIES), daily(),
    f"""SELECT {POINT}, CASE WHEN date >= DATE '2024-01-21' THEN 'raw' ELSE 'summary' END source FROM daily
WHERE date BETWEEN DATE '2024-01-04' AND DATE '2024-01-28'""")
add("view_daily_quantity", samples(), daily(where=Q_ONLY), """SELECT user_id, metric_type, date AS day, avg_value, min_value, max_value,
sum_value, sample_count FROM daily""")
add("view_daily_quantity_utc", samples(), daily(where=Q_ONLY, tz="UTC"), """SELECT user_id, metric_type, date AS day, avg_value, min_value,
max_value, sum_value, sample_count, unit, CASE WHEN date < DATE '2024-01-21' THEN 'summary' ELSE 'raw' END source FROM daily""")
add("retention_apply", samples(), daily(where=f"{Q_ONLY} AND {day('started_at')} < DATE '2024-01-21'"), f"SELECT {POINT}, unit FROM daily")
add("retention_keep", samples(), f"""SELECT user_id, metric_type, value, started_at, seq FROM samples
WHERE NOT ({Q_ONLY}) OR {day('started_at')} >= DATE '2024-01-21'""")
add("retention_report", samples(), f"""SELECT user_id, metric_type, count(*) raw_count, count(DISTINCT {day('started_at')}) summary_days
FROM samples WHERE {Q_ONLY} AND {day('started_at')} < DATE '2024-01-21' GROUP BY 1, 2""")
add("retention_dry_run", samples(), f"""SELECT metric_type, count(*) raw_rows, {KIND} kind, CASE WHEN {Q_ONLY} THEN 'summarise' ELSE 'keep raw' END AS action
FROM samples WHERE {day('started_at')} < DATE '2024-01-21' GROUP BY 1""")

# --- statistics ------------------------------------------------------------
add("weighted_mean", samples(HRV, RHR), daily(), f"SELECT user_id, metric_type, {WMEAN} weighted_mean FROM daily GROUP BY 1, 2")
add("avg_daily_total", samples(STEPS), daily(), f"SELECT user_id, metric_type, {TMEAN} avg_daily_total FROM daily GROUP BY 1, 2")
add("kind_dispatch", samples(*QUANTITIES), daily(), f"""SELECT user_id, metric_type, {KMEAN} AS avg, count(*) AS days, {VTYPE} value_type
FROM daily GROUP BY 1, 2""")
VALUED = f"valued AS (SELECT *, {KVAL} v FROM daily)"
_P = [rnd(f"quantile_cont(v, {p})", 2) for p in (0.10, 0.25, 0.50, 0.75, 0.90)]
STATS = f"""stats AS (SELECT user_id, metric_type, {VTYPE} value_type, count(*) data_points, {rnd('min(v)', 2)} AS min, {rnd('max(v)', 2)} AS max,
  {rnd('avg(v)', 2)} mean, {rnd('stddev_pop(v)', 2)} std_dev, {_P[0]} p10, {_P[1]} p25, {_P[2]} p50, {_P[3]} p75, {_P[4]} p90
  FROM valued GROUP BY 1, 2)"""
add("metric_stats", samples(*QUANTITIES), daily(), VALUED, STATS, "SELECT *, p75 good_day_above, p25 poor_day_below FROM stats")
SRC = "CASE WHEN date >= DATE '2024-01-21' THEN 'raw' ELSE 'summary' END"
add("search_records", samples(*QUANTITIES), daily(), VALUED, f"""SELECT user_id, metric_type, date, {rnd('v', 2)} AS value, {VTYPE} value_type, {SRC} source
FROM valued WHERE v BETWEEN 20 AND 120
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY {rnd('v', 2)} DESC, date) <= 10""")
add("search_counts", samples(*QUANTITIES), daily(), VALUED, """SELECT user_id, metric_type, count(*) days_searched,
count(*) FILTER (v BETWEEN 20 AND 120) days_matched FROM valued GROUP BY 1, 2""")


def period(tag, a, b):
    f = f"FILTER (date BETWEEN DATE '{a}' AND DATE '{b}')"
    wm = rnd(f"sum(sum_value) {f} / sum(sample_count) {f}", 2)
    return (f"count(v) {f} {tag}_points, CASE WHEN {CUM} THEN {rnd(f'avg(sum_value) {f}', 1)} ELSE {wm} END {tag}_avg, "
            f"{rnd(f'min(v) {f}', 2)} {tag}_min, {rnd(f'max(v) {f}', 2)} {tag}_max")


add("compare_periods", samples(*QUANTITIES), daily(), VALUED, f"""p AS (SELECT user_id, metric_type, {period('a', '2024-01-03', '2024-01-16')},
 {period('b', '2024-01-14', '2024-01-29')} FROM valued WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-29' GROUP BY 1, 2)""",
    f"q AS (SELECT *, {VTYPE} value_type, {rnd('b_avg - a_avg', 2)} delta FROM p)",
    f"""SELECT *, {rnd('delta / nullif(a_avg, 0) * 100', 1)} pct_change, CASE WHEN delta IS NULL THEN 'insufficient data'
 ELSE 'late is ' || (CASE WHEN delta > 0 THEN 'higher' WHEN delta < 0 THEN 'lower' ELSE 'the same' END) || ' than early' END verdict FROM q""")
LDAILY = daily("daily", "long")
LSRC = "date >= DATE '2001-08-02' - 30"
LWIN = "date BETWEEN DATE '2001-08-02' - 2400 AND DATE '2001-08-02'"
add("long_term_monthly", LONG, LDAILY, f"""SELECT user_id, metric_type, CAST(date_trunc('month', date) AS DATE) AS month, {KMEAN} AS avg,
count(*) days_with_data, bool_or({LSRC}) has_raw, bool_or(NOT ({LSRC})) has_summary FROM daily WHERE {LWIN} GROUP BY 1, 2, 3""")
OVERALL = f"count(*) days_with_data, {KMEAN} AS avg, min(min_value) AS min, max(max_value) AS max"
add("long_term_overall", LONG, LDAILY, f"SELECT user_id, metric_type, {OVERALL} FROM daily WHERE {LWIN} GROUP BY 1, 2")

# --- reports ---------------------------------------------------------------


def m(metric, x):
    return f"CASE WHEN metric_type = '{metric}' THEN {x} END"


add("health_summary", samples(), f"""w AS (SELECT *, {day('started_at')} d FROM samples WHERE {win(7)})""",
    f"st AS (SELECT user_id, d, sum(value) t FROM w WHERE metric_type = '{STEPS}' GROUP BY 1, 2)",
    f"""sd AS (SELECT user_id, {rnd('sum(t)', 0)} steps_total, {rnd('avg(t)', 1)} steps_daily_avg, count(*) steps_days_with_data FROM st GROUP BY 1)""",
    f"""rest AS (SELECT user_id, {rnd('avg(' + m(HRV, 'value') + ')', 1)} hrv_avg, arg_max({m(HRV, 'value')}, {m(HRV, 'started_at')}) hrv_latest,
 count({m(HRV, 1)}) hrv_readings, {rnd('avg(' + m(RHR, 'value') + ')', 1)} resting_hr_avg, arg_max({m(RHR, 'value')}, {m(RHR, 'started_at')}) resting_hr_latest,
 count({m(SLEEP, 1)}) sleep_records, 0::BIGINT sleep_stage_records, count({m(WORKOUT, 1)}) workout_count,
 coalesce(string_agg(DISTINCT wtype, ',' ORDER BY wtype), '') workout_types FROM w GROUP BY 1)""",
    "SELECT * FROM rest LEFT JOIN sd USING (user_id)")
MIN = "date_diff('microsecond', started_at, ended_at) / 60000000.0::DOUBLE"
NIGHT = f"CAST({wall('started_at')} - INTERVAL 6 HOUR AS DATE)"


def segs(where="source_device ILIKE '%Oura%'", name="segs"):
    return f"""{name} AS (SELECT user_id, {NIGHT} night_date, CASE value WHEN 3 THEN 'core' WHEN 4 THEN 'deep' ELSE 'rem' END stage, started_at, ended_at,
  source_device, {MIN} AS minutes FROM samples WHERE value IN (3, 4, 5) AND ended_at IS NOT NULL AND {where})"""


def _st(s):
    return f"sum(CASE WHEN stage = '{s}' THEN minutes ELSE 0 END)"


NIGHT_COLS = (f"{rnd(_st('core'), 1)} core_minutes, {rnd(_st('deep'), 1)} deep_minutes, {rnd(_st('rem'), 1)} rem_minutes, "
              f"{rnd('sum(minutes)', 1)} total_minutes, {rnd('sum(minutes) / 60', 2)} sleep_hours, count(*) segment_count, min(started_at) bedtime")
NIGHTS = f"nights AS (SELECT user_id, night_date, {NIGHT_COLS} FROM segs GROUP BY 1, 2)"
S21 = segs(f"source_device ILIKE '%Oura%' AND {NIGHT} BETWEEN DATE '2024-01-31' - 21 AND DATE '2024-01-31'")
add("sleep_segments", samples(SLEEP), S21, f"SELECT user_id, night_date, stage, started_at, ended_at, {rnd('minutes', 1)} duration_minutes FROM segs")
add("sleep_nights", samples(SLEEP), S21, NIGHTS, "SELECT * FROM nights")
add("sleep_summary", samples(SLEEP), S21, NIGHTS, f"""SELECT user_id, count(*) nights,
{rnd('avg(CASE WHEN total_minutes > 0 THEN total_minutes / 60 END)', 1)} avg_sleep_hours FROM nights GROUP BY 1""")
add("sleep_nightly", samples(SLEEP), segs(), NIGHTS,
    "SELECT user_id, night_date, sleep_hours, deep_minutes, rem_minutes, segment_count FROM nights")
add("sleep_nights_priority", samples(SLEEP), segs("TRUE", "every"),
    """segs AS (SELECT * FROM (SELECT *, CASE WHEN source_device ILIKE '%Oura%' THEN 0 ELSE 1 END r FROM every)
  QUALIFY r = min(r) OVER (PARTITION BY user_id, night_date))""", NIGHTS, "SELECT * FROM nights")
add("search_sleep_minutes", samples(SLEEP), segs(), NIGHTS, f"""SELECT user_id, '{SLEEP}' metric_type, night_date AS date,
{rnd('total_minutes', 2)} AS value, 'daily_avg' value_type, 'raw' source FROM nights WHERE total_minutes <= 100""")
add("sleep_stage_rows", samples(SLEEP), f"""SELECT user_id, started_at, ended_at, value, {rnd(MIN, 1)} duration_min,
CASE value WHEN 2 THEN 'Awake' WHEN 3 THEN 'Core' WHEN 4 THEN 'Deep' ELSE 'REM' END stage FROM samples WHERE value IN (2, 3, 4, 5)""")
add("sleep_sessions", samples(SLEEP), """o AS (SELECT *, max(ended_at) OVER (PARTITION BY user_id ORDER BY started_at
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM samples)""", """n AS (SELECT *, sum(CASE WHEN reach IS NULL OR started_at >= reach + INTERVAL 240 MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY started_at ROWS UNBOUNDED PRECEDING) n FROM o)""", f"""SELECT user_id, min(started_at) session_start, max(ended_at) session_end,
count(*) segments, {rnd("date_diff('microsecond', min(started_at), max(ended_at)) / 60000000.0::DOUBLE", 1)} AS minutes FROM n GROUP BY user_id, n""")
HRV30 = f"d30 AS (SELECT * FROM daily WHERE date BETWEEN DATE '2024-01-31' - 30 AND DATE '2024-01-31')"
add("hrv_daily", samples(HRV), daily(), HRV30, f"SELECT user_id, date, {rnd('avg_value', 1)} avg_hrv_ms, {SRC} source FROM d30")
TREND = f"""r AS (SELECT *, {rnd('avg_value', 1)} d, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) rn FROM d30)"""
add("hrv_trend", samples(HRV), daily(), HRV30, TREND, f"""t AS (SELECT user_id, count(*) days_with_data, {WMEAN} avg_hrv_ms,
 max(d) FILTER (rn = 1) latest_hrv_ms, CASE WHEN count(*) >= 14 THEN {rnd('avg(d) FILTER (rn <= 7) - avg(d) FILTER (rn BETWEEN 8 AND 14)', 1)} END delta_ms
 FROM r GROUP BY 1)""", """SELECT *, CASE WHEN delta_ms > 0 THEN 'improving' WHEN delta_ms < 0 THEN 'declining' WHEN delta_ms = 0 THEN 'stable' END direction FROM t""")
add("query_metric_raw", samples(RHR), f"""SELECT user_id, value, unit, started_at, source_device AS source FROM samples WHERE {win(10)}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, seq DESC) <= 200""")
add("query_metric_stats", samples(RHR), f"r AS (SELECT * FROM samples WHERE {win(10)})",
    f"SELECT user_id, count(*) AS count, {rnd('avg(value)', 2)} AS avg, min(value) AS min, max(value) AS max FROM r GROUP BY 1")
add("query_metric_daily", samples(HRV), daily(), tiered("DATE '2024-01-31' - 28"), f"SELECT {POINT}, source FROM points")
add("query_metric_overall", samples(STEPS), daily(), tiered("DATE '2024-01-31' - 28"),
    f"SELECT user_id, metric_type, {OVERALL} FROM points GROUP BY 1, 2")
WORK = f"""work AS (SELECT user_id, {day('started_at')} date, started_at, wtype workout_type, {rnd('wsec / 60', 1)} duration_minutes,
  NULL::DOUBLE distance_km, wcal calories_burned, source_device AS source, seq FROM samples)"""
add("workouts", samples(WORKOUT), WORK, f"""SELECT * EXCLUDE (seq) FROM work WHERE {win(30)}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, seq DESC) <= 5""")
add("workouts_summary", samples(WORKOUT), WORK, f"""SELECT user_id, count(*) total_workouts, {rnd('sum(duration_minutes) / 60', 1)} total_duration_hours
FROM work WHERE {win(30)} GROUP BY 1""")
add("workouts_by_type", samples(WORKOUT), WORK, f"""SELECT user_id, workout_type, count(*) workouts, {rnd('sum(duration_minutes)', 1)} AS minutes
FROM work WHERE {win(30)} GROUP BY 1, 2""")
DAY15 = f"w AS (SELECT * FROM samples WHERE {day('started_at')} = DATE '2024-01-15')"
SNAP = (*BASE, WEIGHT, ENERGY)
add("daily_snapshot", samples(*SNAP), DAY15, f"""SELECT user_id, count(*) total_records, count(DISTINCT metric_type) metrics_present,
{rnd('sum(' + m(STEPS, 'value') + ')', 0)} steps, {rnd('sum(' + m(ENERGY, 'value') + ')', 0)} active_energy_cal,
arg_min({m(RHR, 'value')}, {m(RHR, 'started_at')}) resting_hr_bpm, arg_min({m(HRV, 'value')}, {m(HRV, 'started_at')}) hrv_sdnn_ms,
arg_min({m(WEIGHT, 'value')}, {m(WEIGHT, 'started_at')}) weight_kg, count({m(SLEEP, 1)}) sleep_records, count({m(WORKOUT, 1)}) workouts,
{rnd('sum(wsec) / 60', 1)} workout_minutes, {rnd('sum(wcal)', 1)} workout_calories, FALSE AS truncated FROM w GROUP BY 1""")
add("daily_snapshot_rows", samples(*SNAP), DAY15, """SELECT user_id, metric_type, value, unit, source_device, started_at FROM w""")

# --- coaching --------------------------------------------------------------
W7 = win(6)
REC = [f"rw AS (SELECT * FROM samples WHERE metric_type IN ('{HRV}', '{RHR}') AND {win(14)})", f"""hr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, seq DESC) rn
  FROM rw WHERE metric_type = '{HRV}')""", f"""hd AS (SELECT user_id, {rnd('avg(value) FILTER (rn <= 7) - avg(value) FILTER (rn > 7)', 1)} hrv_delta_samples FROM hr GROUP BY 1)""",
       f"""ra AS (SELECT user_id, arg_max({m(HRV, 'value')}, {m(HRV, 'started_at')}) hrv_latest_ms, arg_max({m(RHR, 'value')}, {m(RHR, 'started_at')}) resting_hr_latest_bpm,
  {rnd(f"avg(value) FILTER (metric_type = '{HRV}' AND {W7})", 1)} hrv_7d_avg_ms, {rnd(f"avg(value) FILTER (metric_type = '{RHR}' AND {W7})", 1)} resting_hr_7d_avg_bpm,
  {rnd('avg(' + m(RHR, 'value') + ')', 1)} resting_hr_14d_avg_bpm FROM rw GROUP BY 1)""",
       """rt AS (SELECT *, CASE WHEN hrv_delta_samples > 2 THEN 'improving' WHEN hrv_delta_samples < -2 THEN 'declining'
  WHEN hrv_delta_samples IS NOT NULL THEN 'stable' ELSE 'unknown' END hrv_trend FROM ra LEFT JOIN hd USING (user_id))""",
       """recovery AS (SELECT *, CASE hrv_trend WHEN 'improving' THEN 'Good recovery — normal or increased training load appropriate'
  WHEN 'declining' THEN 'Recovery declining — prioritize sleep, reduce intensity if trend continues' ELSE 'Recovery stable' END coaching_note FROM rt)"""]
add("coaching_recovery", samples(HRV, RHR), *REC, "SELECT * FROM recovery")
CSL = [f"""cn AS (SELECT user_id, {NIGHT} night_date, sum({MIN}) AS minutes FROM samples WHERE metric_type = '{SLEEP}' AND value IN (3, 4, 5)
  AND source_device ILIKE '%Oura%' AND {win(14)} GROUP BY 1, 2)""", """c7 AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY night_date DESC) <= 7)""",
       f"""cs AS (SELECT user_id, {rnd('avg(minutes) / 60', 1)} avg_hours_last_7_nights, count(*) nights_tracked FROM c7 GROUP BY 1)""",
       """csleep AS (SELECT *, CASE WHEN avg_hours_last_7_nights >= 7.5 THEN 'good' WHEN avg_hours_last_7_nights >= 6.5 THEN 'borderline' ELSE 'poor' END quality_flag FROM cs)"""]
add("coaching_sleep", samples(SLEEP), *CSL, "SELECT * FROM csleep")
CLOAD = f"""cload AS (SELECT user_id, CAST(sum(n) AS BIGINT) total_workouts, {rnd('sum(s) / 3600', 1)} total_hours, {rnd('sum(n) / 4.3::DOUBLE', 1)} weekly_avg_workouts,
  string_agg(wtype || ':' || n, ',' ORDER BY wtype) by_type FROM (SELECT user_id, wtype, count(*) n, sum(wsec) s FROM samples
  WHERE metric_type = '{WORKOUT}' AND {win(30)} GROUP BY 1, 2) GROUP BY 1)"""
add("coaching_load", samples(WORKOUT), CLOAD, "SELECT * FROM cload")
CACT = [daily("cd", where=f"metric_type IN ('{STEPS}', '{ENERGY}') AND {win(7)}"), f"""cact AS (SELECT user_id, {rnd('avg(' + m(STEPS, 'sum_value') + ')', 1)} avg_daily_steps,
  {rnd('avg(' + m(ENERGY, 'sum_value') + ')', 1)} avg_active_energy_cal FROM cd GROUP BY 1)"""]
add("coaching_activity", samples(STEPS, ENERGY), *CACT, "SELECT * FROM cact")
WT = f"CASE WHEN metric_type = '{WEIGHT}' AND {win(30)} THEN started_at END"
CMARK = f"""cmark AS (SELECT user_id, arg_max({m(VO2, 'value')}, {m(VO2, 'started_at')}) vo2max_latest, arg_max({m(WEIGHT, 'value')}, {WT}) weight_kg_latest,
  CASE WHEN count({WT}) > 1 THEN arg_min({m(WEIGHT, 'value')}, {WT}) END weight_kg_30d_ago
  FROM samples WHERE metric_type IN ('{VO2}', '{WEIGHT}') AND {win(365)} GROUP BY 1)"""
add("coaching_markers", samples(VO2, WEIGHT), CMARK, "SELECT * FROM cmark")
add("coaching_brief", samples(STEPS, HRV, RHR, SLEEP, WORKOUT, VO2, WEIGHT, ENERGY), *REC, *CSL, CLOAD, *CACT, CMARK,
    """SELECT * REPLACE (coalesce(hrv_trend, 'unknown') AS hrv_trend, coalesce(coaching_note, 'Recovery stable') AS coaching_note,
 coalesce(quality_flag, 'no data') AS quality_flag) FROM recovery FULL JOIN csleep USING (user_id) FULL JOIN cload USING (user_id)
 FULL JOIN cact USING (user_id) FULL JOIN cmark USING (user_id)""")

# --- recipes ---------------------------------------------------------------
add("inventory", samples(), "SELECT metric_type, count(*) sample_count, min(started_at) earliest, max(started_at) latest FROM samples GROUP BY 1")
_AGE = rnd(f"date_diff('microsecond', max(started_at), {midnight(chr(68) + 'ATE ' + chr(39) + '2024-01-31' + chr(39))}) / 3600000000.0::DOUBLE", 2)
add("freshness", samples(), f"""SELECT metric_type, count(*) AS rows, max(started_at) latest_record, {_AGE} hours_behind
FROM samples GROUP BY 1""")
add("recent_rows", samples(HRV), f"SELECT user_id, value, started_at, source_device FROM samples WHERE {win(7)}")
add("monthly_raw", LONG, f"""SELECT user_id, CAST(date_trunc('month', {day('started_at')}) AS DATE) AS month, {rnd('avg(value)', 2)} avg_value
FROM long WHERE metric_type = '{RHR}' GROUP BY 1, 2""")
LSUM = daily("summ", "long", f"metric_type = '{RHR}' AND {day('started_at')} < DATE '2001-08-02' - 30")
add("yearly_summary", LONG, LSUM, f"""SELECT user_id, CAST(date_trunc('year', date) AS DATE) AS year, {rnd('avg(avg_value)', 2)} avg_value, count(*) days_with_data
FROM summ GROUP BY 1, 2""")
add("monthly_summary", LONG, LSUM, f"""SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, {rnd('avg(avg_value)', 1)} avg_value, count(*) days_with_data
FROM summ GROUP BY 1, 2""")
add("weekly_digest", samples(STEPS, HRV, WORKOUT), SUMM, f"""dg AS (SELECT user_id, {rnd('avg(' + m(HRV, 'avg_value') + ')', 1)} avg_hrv, {rnd('min(' + m(HRV, 'avg_value') + ')', 1)} min_hrv,
 {rnd('max(' + m(HRV, 'avg_value') + ')', 1)} max_hrv, count({m(HRV, 1)}) hrv_days, {rnd('avg(' + m(STEPS, 'sum_value') + ')', 0)} avg_daily_steps,
 {rnd('sum(' + m(STEPS, 'sum_value') + ')', 2)} total_steps FROM summ WHERE date BETWEEN DATE '2024-01-14' AND DATE '2024-01-21' GROUP BY 1)""",
    f"""wk AS (SELECT user_id, count(*) c FROM samples WHERE metric_type = '{WORKOUT}' AND {win(7, '2024-01-21')} GROUP BY 1)""",
    "SELECT dg.* EXCLUDE (user_id), coalesce(dg.user_id, wk.user_id) user_id, coalesce(c, 0) workout_count FROM dg FULL JOIN wk ON dg.user_id = wk.user_id")
add("threshold_alert", samples(HRV), SUMM, "SELECT user_id, date, avg_value FROM summ WHERE date = DATE '2024-01-20' AND avg_value < 40")
add("monthly_two_metric", samples(HRV, RHR), SUMM, f"""SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month,
{rnd('avg(' + m(HRV, 'avg_value') + ')', 1)} avg_hrv, {rnd('avg(' + m(RHR, 'avg_value') + ')', 1)} avg_resting_hr
FROM summ WHERE date >= DATE '2023-07-31' GROUP BY 1, 2""")
add("source_audit", samples(), f"""SELECT user_id, {day('started_at')} date, metric_type, source_device, count(*) samples FROM samples GROUP BY 1, 2, 3, 4""")

# --- analyses --------------------------------------------------------------
HD = f"hrvd AS (SELECT user_id, date, avg_value hrv FROM daily WHERE metric_type = '{HRV}')"
HS = samples(HRV, SLEEP)
HSD = (HS, daily(where=f"metric_type = '{HRV}'"), HD, segs(f"metric_type = '{SLEEP}' AND source_device ILIKE '%Oura%'"), NIGHTS)
add("low_hrv_prior_sleep", *HSD, """SELECT h.user_id, h.date, h.hrv, n.sleep_hours, n.deep_minutes FROM hrvd h
LEFT JOIN nights n ON n.user_id = h.user_id AND n.night_date = h.date - 1 WHERE h.hrv < 30""")
AFTER = "after AS (SELECT n.*, h.hrv FROM nights n JOIN hrvd h ON h.user_id = n.user_id AND h.date = n.night_date + 1)"
add("deep_band_next_hrv", *HSD, AFTER, f"""SELECT user_id, CASE WHEN deep_minutes < 45 THEN 'under 45' WHEN deep_minutes < 60 THEN '45 to 60' ELSE '60 and over' END deep_band,
count(*) nights, {rnd('avg(hrv)', 1)} avg_next_hrv FROM after GROUP BY 1, 2""")


def corr(x, y):
    return f"CASE WHEN {rnd(f'stddev_pop({x})', 4)} > 0 AND {rnd(f'stddev_pop({y})', 4)} > 0 THEN {rnd(f'corr({x}, {y})', 4)} END"


add("corr_sleep_hrv", *HSD, AFTER, f"""SELECT user_id, count(*) pairs, {corr('deep_minutes', 'hrv')} deep_corr, {corr('total_minutes', 'hrv')} total_corr FROM after GROUP BY 1""")
HW = (samples(HRV, WORKOUT), daily(where=f"metric_type = '{HRV}'"), HD, WORK + f"", )
WK = f"wk AS (SELECT * FROM work WHERE workout_type IS NOT NULL)"
add("load_before_low_hrv", *HW, WK, f"""SELECT h.user_id, h.date, h.hrv, count(w.started_at) sessions, coalesce({rnd('sum(w.duration_minutes)', 1)}, 0) AS minutes FROM hrvd h
LEFT JOIN wk w ON w.user_id = h.user_id AND w.started_at >= {midnight('h.date')} - INTERVAL 48 HOUR AND w.started_at < {midnight('h.date')}
WHERE h.hrv < 30 GROUP BY 1, 2, 3""")
add("heavy_week_next_hrv", *HW, WK, "hv AS (SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, count(*) sessions FROM wk GROUP BY 1, 2 HAVING count(*) >= 3)",
    f"hm AS (SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, {rnd('avg(hrv)', 1)} hrv FROM hrvd GROUP BY 1, 2)",
    f"""SELECT hv.user_id, hv.week, hv.sessions, a.hrv week_hrv, b.hrv next_week_hrv, {rnd('b.hrv - a.hrv', 1)} AS change FROM hv
LEFT JOIN hm a ON a.user_id = hv.user_id AND a.week = hv.week LEFT JOIN hm b ON b.user_id = hv.user_id AND b.week = hv.week + 7""")
WSS = (samples(WORKOUT), WORK)


def per(p):
    return f"per AS (SELECT user_id, CAST(date_trunc('{p}', date) AS DATE) AS {p}, count(*) sessions, {rnd('sum(duration_minutes) / 60', 2)} AS hours FROM work GROUP BY 1, 2)"


add("weekly_volume", *WSS, per("week"), """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hours DESC, week) = 1 AS is_highest,
row_number() OVER (PARTITION BY user_id ORDER BY hours, week) = 1 AS is_lowest FROM per""")
add("monthly_volume_change", *WSS, per("month"), f"""SELECT c.*, p.sessions prev_sessions, p.hours prev_hours,
{rnd('(c.sessions / CAST(p.sessions AS DOUBLE) - 1) * 100', 1)} sessions_pct, {rnd('(c.hours / nullif(p.hours, 0) - 1) * 100', 1)} hours_pct
FROM per c LEFT JOIN per p ON p.user_id = c.user_id AND p.month = c.month - INTERVAL 1 MONTH""")
add("type_share", *WSS, f"t AS (SELECT user_id, workout_type, count(*) workouts, {rnd('sum(duration_minutes)', 1)} AS minutes FROM work GROUP BY 1, 2)",
    f"""SELECT *, {rnd('workouts / CAST(sum(workouts) OVER (PARTITION BY user_id) AS DOUBLE) * 100', 1)} session_pct,
{rnd('minutes / nullif(sum(minutes) OVER (PARTITION BY user_id), 0) * 100', 1)} time_pct FROM t""")


def top(by, k):
    return f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {by} DESC, started_at DESC, seq DESC) AS rank, started_at, workout_type,
duration_minutes, calories_burned FROM work WHERE {by} IS NOT NULL QUALIFY rank <= {k}"""


add("top_workouts", *WSS, top("duration_minutes", 5))
add("top_workouts_calories", *WSS, top("calories_burned", 10))
add("streaks", *WSS, "d AS (SELECT DISTINCT user_id, date FROM work)",
    "i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INT) g FROM d)",
    "SELECT user_id, min(date) first_day, max(date) last_day, count(*) AS days FROM i GROUP BY user_id, g HAVING count(*) >= 2")
HR = (samples(HRV, RHR), daily())
add("suppression_runs", *HR, f"""b AS (SELECT h.user_id, h.date, h.avg_value hrv, r.avg_value rhr, {rnd('avg(h.avg_value) OVER (PARTITION BY h.user_id)', 4)} hm,
 {rnd('avg(r.avg_value) OVER (PARTITION BY h.user_id)', 4)} rm FROM daily h JOIN daily r ON r.user_id = h.user_id AND r.date = h.date AND r.metric_type = '{RHR}'
 WHERE h.metric_type = '{HRV}')""", "i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INT) g FROM b WHERE hrv < hm AND rhr > rm)",
    f"""SELECT user_id, min(date) first_day, max(date) last_day, count(*) AS days, {rnd('avg(hrv)', 1)} avg_hrv, {rnd('avg(rhr)', 1)} avg_rhr FROM i GROUP BY user_id, g""")
add("declining_runs", samples(HRV), daily(), "f AS (SELECT *, coalesce(avg_value < lag(avg_value) OVER (PARTITION BY user_id ORDER BY date), false) falls FROM daily)",
    "g AS (SELECT *, sum(CASE WHEN falls THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY date) r FROM f)",
    """SELECT user_id, metric_type, min(date) first_day, max(date) last_day, count(*) AS days, min(avg_value) lowest FROM g WHERE falls
GROUP BY user_id, metric_type, r HAVING count(*) >= 3""")
SM, WM = "month(date) IN (6, 7, 8)", "month(date) IN (12, 1, 2)"
add("season_compare", LONG, LDAILY, VALUED, f"""s AS (SELECT user_id, metric_type, count(v) FILTER ({SM}) summer_days, {rnd(f'avg(v) FILTER ({SM})', 2)} summer_avg,
 count(v) FILTER ({WM}) winter_days, {rnd(f'avg(v) FILTER ({WM})', 2)} winter_avg FROM valued WHERE {SM} OR {WM} GROUP BY 1, 2)""",
    f"SELECT *, {rnd('summer_avg - winter_avg', 2)} delta FROM s")
add("yoy", LONG, LDAILY, VALUED, f"y AS (SELECT user_id, metric_type, CAST(year(date) AS INT) AS year, {rnd('avg(v)', 2)} AS avg, count(*) days_with_data FROM valued GROUP BY 1, 2, 3)",
    f"d AS (SELECT c.*, p.avg prev_avg, {rnd('c.avg - p.avg', 2)} delta FROM y c LEFT JOIN y p ON p.user_id = c.user_id AND p.metric_type = c.metric_type AND p.year = c.year - 1)",
    f"SELECT *, {rnd('delta / nullif(prev_avg, 0) * 100', 1)} pct_change FROM d")
add("weekday_pattern", samples(*QUANTITIES), daily(), VALUED, f"""SELECT user_id, metric_type, CAST(isodow(date) AS BIGINT) weekday, {rnd('avg(v)', 2)} AS avg, count(*) AS days FROM valued GROUP BY 1, 2, 3""")
add("recovery_score", samples(HRV, RHR, SLEEP), daily(where=Q_ONLY), VALUED, STATS, segs(f"metric_type = '{SLEEP}' AND source_device ILIKE '%Oura%'"), NIGHTS,
    f"""j AS (SELECT h.user_id, h.date, h.avg_value hrv, r.avg_value rhr, n.sleep_hours, a.p25 a25, a.p50 a50, a.p75 a75, b.p25 b25, b.p50 b50, b.p75 b75
 FROM daily h JOIN daily r ON r.user_id = h.user_id AND r.date = h.date AND r.metric_type = '{RHR}' JOIN nights n ON n.user_id = h.user_id AND n.night_date = h.date - 1
 JOIN stats a ON a.user_id = h.user_id AND a.metric_type = '{HRV}' JOIN stats b ON b.user_id = h.user_id AND b.metric_type = '{RHR}' WHERE h.metric_type = '{HRV}')""",
    """p AS (SELECT user_id, date, hrv, rhr, sleep_hours, CAST(CASE WHEN hrv > a75 THEN 40 WHEN hrv >= a50 THEN 30 WHEN hrv >= a25 THEN 20 ELSE 10 END AS BIGINT) hrv_points,
 CAST(CASE WHEN rhr <= b25 THEN 30 WHEN rhr <= b50 THEN 20 WHEN rhr <= b75 THEN 10 ELSE 5 END AS BIGINT) rhr_points,
 CAST(CASE WHEN sleep_hours >= 7.5 THEN 30 WHEN sleep_hours >= 6.5 THEN 20 WHEN sleep_hours >= 6 THEN 10 ELSE 5 END AS BIGINT) sleep_points FROM j)""",
    "SELECT *, hrv_points + rhr_points + sleep_points AS score FROM p")
add("baseline_status", samples(*QUANTITIES), daily(), VALUED, "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY date DESC) rn FROM valued)",
    f"""b AS (SELECT user_id, metric_type, max(date) date, max({rnd('v', 2)}) FILTER (rn = 1) latest, {rnd('avg(v)', 2)} mean, {rnd('stddev_pop(v)', 2)} std_dev FROM r GROUP BY 1, 2)""",
    f"SELECT *, CASE WHEN latest >= mean THEN 'green' WHEN latest >= {rnd('mean - std_dev', 2)} THEN 'yellow' ELSE 'red' END status FROM b")
add("drop_outliers", samples(HRV), daily(), f"x AS (SELECT *, {rnd('avg(avg_value) OVER (PARTITION BY user_id)', 4)} mu FROM daily)",
    f"""SELECT user_id, metric_type, date, {rnd('avg_value', 2)} AS value, {rnd('mu', 2)} mean, {rnd('(avg_value / mu - 1) * 100', 1)} pct_from_mean
FROM x WHERE avg_value < {rnd('mu * 0.8::DOUBLE', 4)}""")
add("rolling_7d", samples(*QUANTITIES), daily(), VALUED, """r AS (SELECT *, avg(v) OVER (PARTITION BY user_id, metric_type ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) ra,
 avg(v) OVER (PARTITION BY user_id, metric_type) ba FROM valued)""", f"""SELECT user_id, metric_type, date, {rnd('v', 2)} AS value, {rnd('ra', 2)} rolling_avg, {rnd('ba', 2)} baseline,
{rnd('ra - ba', 2)} deviation FROM r""")
SN = (samples(SLEEP), segs(), NIGHTS)
add("bedtime_effect", *SN, f"l AS (SELECT *, CAST((hour({wall('bedtime')}) * 60 + minute({wall('bedtime')}) + 360) % 1440 AS DOUBLE) x FROM nights)",
    f"SELECT user_id, count(*) nights, {rnd('avg(x)', 1)} avg_bedtime_min_after_18h, {corr('x', 'deep_minutes')} bedtime_deep_corr FROM l GROUP BY 1")
add("stage_share", *SN, "p AS (SELECT user_id, CAST(date_trunc('week', night_date) AS DATE) AS period, sum(core_minutes) c, sum(deep_minutes) d, sum(rem_minutes) r, sum(total_minutes) t, count(*) nights FROM nights GROUP BY 1, 2)",
    f"q AS (SELECT user_id, period, nights, {rnd('c / nullif(t, 0) * 100', 1)} core_pct, {rnd('d / nullif(t, 0) * 100', 1)} deep_pct, {rnd('r / nullif(t, 0) * 100', 1)} rem_pct FROM p)",
    f"SELECT *, {rnd('rem_pct - lag(rem_pct) OVER (PARTITION BY user_id ORDER BY period)', 1)} rem_pct_change FROM q")
add("best_worst_night", *SN, f"""w AS (SELECT *, CAST(date_trunc('week', night_date) AS DATE) AS week, {rnd('deep_minutes + rem_minutes', 1)} dr FROM nights)""",
    """r AS (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY dr DESC, night_date) b, row_number() OVER (PARTITION BY user_id, week ORDER BY total_minutes, night_date) x FROM w)""",
    """SELECT user_id, week, count(*) nights, max(night_date) FILTER (b = 1) best_night, max(dr) best_deep_rem_minutes, max(night_date) FILTER (x = 1) worst_night,
min(total_minutes) worst_total_minutes FROM r GROUP BY 1, 2""")
add("device_diff", samples(HRV), f"""x AS (SELECT user_id, {day('started_at')} date, {rnd("avg(value) FILTER (source_device ILIKE '%Apple Watch%')", 2)} avg_a,
 {rnd("avg(value) FILTER (source_device ILIKE '%Oura%')", 2)} avg_b FROM samples GROUP BY 1, 2)""",
    f"SELECT *, {rnd('avg_a - avg_b', 2)} difference FROM x WHERE avg_a IS NOT NULL AND avg_b IS NOT NULL")


def edge(c, sign):
    return rnd(f"avg({c}) OVER (PARTITION BY user_id) {sign} stddev_pop({c}) OVER (PARTITION BY user_id)", 4)


add("illness_flag", samples(SPO2, RESP, HRV), daily(), f"""j AS (SELECT s.user_id, s.date, s.avg_value spo2, r.avg_value resp, h.avg_value hrv FROM daily s
 JOIN daily r ON r.user_id = s.user_id AND r.date = s.date AND r.metric_type = '{RESP}' JOIN daily h ON h.user_id = s.user_id AND h.date = s.date AND h.metric_type = '{HRV}'
 WHERE s.metric_type = '{SPO2}')""", f"""f AS (SELECT user_id, date, spo2, resp, hrv, spo2 < {edge('spo2', '-')} spo2_low, resp > {edge('resp', '+')} resp_high, hrv < {edge('hrv', '-')} hrv_low FROM j)""",
    """SELECT *, CASE WHEN spo2_low AND resp_high AND hrv_low THEN 'possible illness or disturbed sleep' WHEN resp_high AND hrv_low THEN 'stress or early illness'
 WHEN spo2_low AND NOT resp_high THEN 'altitude or artifact' WHEN spo2_low OR resp_high OR hrv_low THEN 'single signal' ELSE 'normal' END flag FROM f""")
TL = (samples(WEIGHT, WORKOUT), daily(where=f"metric_type = '{WEIGHT}'"), WORK, WK,
      f"lv AS (SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS period, {rnd('avg(avg_value)', 2)} avg_value FROM daily GROUP BY 1, 2)",
      f"ld AS (SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS period, count(*) sessions, {rnd('sum(duration_minutes) / 60', 2)} AS hours FROM wk GROUP BY 1, 2)",
      "tl AS (SELECT lv.*, coalesce(sessions, 0) sessions, coalesce(hours, 0) AS hours FROM lv LEFT JOIN ld USING (user_id, period))")
add("trend_with_load", *TL, "SELECT * FROM tl")
add("load_correlation", *TL, f"SELECT user_id, count(*) periods, {corr('avg_value', 'CAST(sessions AS DOUBLE)')} session_corr FROM tl GROUP BY 1")
add("heavy_months_hrv", *HW, WK, f"""mn AS (SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) sessions,
 {rnd("count(*) * 7 / CAST(day(last_day(min(date))) AS DOUBLE)", 2)} sessions_per_week FROM wk GROUP BY 1, 2)""",
    f"hm AS (SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, {rnd('avg(hrv)', 1)} avg_hrv FROM hrvd GROUP BY 1, 2)",
    "SELECT mn.*, avg_hrv FROM mn LEFT JOIN hm USING (user_id, month) WHERE sessions_per_week > 1")

# --- files and streams -----------------------------------------------------
add("xml_import", samples(), f"""SELECT 'me' user_id, metric_type, value, unit, source_device, date_trunc('second', started_at) started_at,
date_trunc('second', ended_at) ended_at, CASE WHEN metric_type = '{WORKOUT}' THEN 'skipped' ELSE 'ok' END import_status FROM samples""")
add("stream_ingest", PAYLOAD, ACCEPTED, f"""SELECT CAST(user_id AS VARCHAR) user_id, '{STEPS}' metric_type, started_at, value FROM rows
QUALIFY row_number() OVER (PARTITION BY user_id, started_at ORDER BY batch_no DESC, pos DESC) = 1""")
# Of a sample that is sent again, the last copy counts; the ring's second copy is one higher.
add("stream_dedupe", samples(), """SELECT user_id, metric_type, started_at, unit, source_device,
CASE WHEN source_device = 'Oura Ring' THEN value + 1 ELSE value END AS value FROM samples""")
add("stream_daily", samples(*QUANTITIES), daily(), f"""SELECT {POINT}, CASE WHEN date < DATE '2024-01-21' THEN 'closed' ELSE 'open' END state
FROM daily""")
ORACLE["stream_upsert"] = ORACLE["stream_ingest"]
add("xml_import_report", samples(), f"""SELECT CASE WHEN metric_type = '{WORKOUT}' THEN 'skipped' ELSE 'ok' END import_status, count(*) records
FROM samples GROUP BY 1""")
add("publish_tiers", samples(), daily(where=Q_ONLY), """SELECT user_id, metric_type, date AS day, avg_value, min_value, max_value, sum_value, sample_count,
CASE WHEN date < DATE '2024-01-21' THEN 'summary' ELSE 'raw' END source FROM daily""")
add("daily_snapshot_workouts", samples(WORKOUT), DAY15, f"""SELECT user_id, started_at, wtype workout_type, {rnd('wsec / 60', 1)} duration_minutes, wcal calories FROM w""")
add("long_term_daily", LONG, LDAILY, f"SELECT {POINT}, CASE WHEN {LSRC} THEN 'raw' ELSE 'summary' END source FROM daily WHERE {LWIN}")
add("metric_stats_approx", samples(*QUANTITIES), daily(), VALUED, "o AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_type ORDER BY v) rn, count(*) OVER (PARTITION BY user_id, metric_type) n FROM valued)",
    "SELECT user_id, metric_type, count(*) data_points, " + rnd("avg(v)", 2) + " mean, " + ", ".join(
        f"{rnd(f'max(v) FILTER (rn = greatest(1, CAST(ceil(CAST(n * {p} AS DECIMAL(18,4))) AS BIGINT)))', 2)} p{int(p * 100)}" for p in (0.10, 0.25, 0.50, 0.75, 0.90))
    + " FROM o GROUP BY 1, 2")
add("last_record", samples(), "SELECT user_id, max(started_at) last_record, count(*) AS rows FROM samples GROUP BY 1")
add("weekday_sleep", samples(SLEEP), segs(), NIGHTS, f"""SELECT user_id, '{SLEEP}' metric_type, CAST(isodow(night_date) AS BIGINT) weekday, {rnd('avg(total_minutes)', 2)} AS avg,
count(*) AS days FROM nights GROUP BY 1, 2, 3""")
add("metric_stats_raw_only", samples(*QUANTITIES), daily(), VALUED, STATS, "SELECT *, p75 good_day_above, p25 poor_day_below FROM stats")
add("long_term_uncapped", LONG, LDAILY, VALUED, STATS, "SELECT *, p75 good_day_above, p25 poor_day_below FROM stats")
ORACLE["publish_late_twice"] = ORACLE["publish_tiers"]
MANY = """many AS (SELECT * FROM (SELECT * REPLACE (started_at + to_minutes(CAST(seq % 600 AS BIGINT)) AS started_at) FROM long)
  QUALIFY row_number() OVER (PARTITION BY user_id, metric_type, started_at ORDER BY seq DESC) = 1)"""
# Thirty days before 1999-03-20 begins the raw tier.
add("late_after_drop", LONG, MANY, daily("daily", "many"), """SELECT user_id, metric_type, date AS day, avg_value, min_value, max_value, sum_value,
sample_count, CASE WHEN date < DATE '1999-03-20' - 30 THEN 'summary' ELSE 'raw' END source FROM daily""")
add("upsert_delta_merge", LONG, MANY, """SELECT user_id, metric_type, started_at, seq,
value + CASE WHEN seq % 7 = 0 OR seq % 11 = 0 THEN 2 WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS value FROM many""")
ORACLE["compact_deltas"] = ORACLE["upsert_delta_merge"]
add("xml_to_store", samples(), f"""SELECT 'me' user_id, metric_type, date_trunc('second', started_at) started_at, max(value) AS value
FROM samples WHERE metric_type <> '{WORKOUT}' GROUP BY 1, 2, 3""")
ORACLE["xml_import_split"] = ORACLE["xml_import"]
add("import_rejects", samples(*QUANTITIES), """SELECT 'xml' source, 'me' user_id,
CASE WHEN seq % 17 = 0 THEN 'unreadable start' ELSE 'no valid metric' END reason,
CASE WHEN seq % 13 = 0 THEN 'nothing' ELSE metric_type END metric_type, value,
CASE WHEN seq % 17 = 0 THEN 'soon' ELSE strftime(started_at, '%Y-%m-%d %H:%M:%S') || ' +0000' END started_at
FROM samples WHERE seq % 13 = 0 OR seq % 17 = 0""")
add("replay_rejects", samples(*QUANTITIES), f"""SELECT 'me' user_id, CASE WHEN seq % 13 = 0 THEN '{STEPS}' ELSE metric_type END metric_type,
value, unit, CASE WHEN seq % 17 = 0 THEN TIMESTAMP '2024-01-01' ELSE date_trunc('second', started_at) END started_at
FROM samples WHERE seq % 13 = 0 OR seq % 17 = 0""")
add("ingest_unnumbered", f"""SELECT 'me' user_id, '{STEPS}' metric_type, date_trunc('hour', ts) started_at, value FROM events
QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id DESC) = 1""")
add("backfill_resume", LONG, """SELECT user_id, metric_type, started_at, value, seq FROM long
QUALIFY row_number() OVER (PARTITION BY user_id, metric_type, started_at ORDER BY seq) = 1""")
add("scan_recent_all", samples(HRV), f"SELECT user_id, value, source_device, started_at FROM samples WHERE {win(14)}")
add("scan_summary_all", samples(STEPS), SUMM, "SELECT user_id, date, avg_value, sum_value, sample_count FROM summ WHERE date >= DATE '2024-01-05'")
add("workouts_all", samples(WORKOUT), WORK, f"SELECT * EXCLUDE (seq) FROM work WHERE {win(30)}")
add("ingest_rejects", PAYLOAD, f"SELECT CAST(user_id AS VARCHAR) user_id, batch_no, {VERDICT} reason FROM batches WHERE {VERDICT} <> 'accepted'")
ORACLE["stream_rejects"] = ORACLE["ingest_rejects"]
