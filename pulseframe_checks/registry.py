"""Every operator as a query over the supplied tables."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulseframe import schema as S
from pulseframe.functions.metrics import is_importable, is_valid_metric, stage_identifier
from pulseframe.functions.numbers import half_up
from pulseframe.functions.time import days_before, utc_time
from pulseframe.operators import daily, hygiene, ingest, retention, scans, sleep, stats, trends, workouts
from pulseframe.plans import analyses, recipes, tools
from pulseframe.sources import driver_tables as tables
from pulseframe.sources import backfill, json_batches, rejects, xml_export
from pulseframe.sources.tables import compact, open_tiers, publish, shared_dir, stored_samples, upsert_into_tiers
from pulseframe.streaming import pipelines

AS_OF = dt.date(2024, 1, 31)
RAW_DAYS = 10
CUT = days_before(AS_OF, RAW_DAYS)
LONG_AS_OF = dt.date(2001, 8, 2)
LONG_CUT = days_before(LONG_AS_OF, S.RAW_DAYS)
LOW_HRV = 30.0

QUERIES = {}


def query(fn, name=None):
    """Register a query under its function name; instants are shown as UTC wall-clock time."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*[utc_time(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType)
                           else F.col(f.name) for f in df.schema.fields])

    run.__doc__ = fn.__doc__
    QUERIES[name or fn.__name__] = run
    return fn


# --- inputs ----------------------------------------------------------------
def raw(spark, d, *metrics):
    return tables.samples(spark, d, *metrics)


def summaries(spark, d, *metrics):
    """The stored tier: daily summaries of everything before the cut."""
    return daily.daily_summary(raw(spark, d, *metrics).filter(scans.before_day("started_at", CUT)))


def tiers(spark, d, *metrics):
    return raw(spark, d, *metrics), summaries(spark, d, *(metrics or QUANTITIES))


QUANTITIES = (S.STEPS, S.HRV, S.RESTING_HR)


def long_tiers(spark, d):
    s = tables.long_samples(spark, d)
    return s, daily.daily_summary(s.filter(scans.before_day("started_at", LONG_CUT)))


def long_points(spark, d):
    return daily.daily_from_raw(tables.long_samples(spark, d))


def points(spark, d, *metrics):
    return daily.daily_from_raw(raw(spark, d, *metrics))


def nights(spark, d):
    return sleep.nights(sleep.segments(raw(spark, d, S.SLEEP)))


def hrv_days(spark, d):
    return analyses.day_values(points(spark, d, S.HRV), S.HRV, "hrv")


def workout_rows(spark, d):
    return workouts.workouts(raw(spark, d, S.WORKOUT))


# --- scans -----------------------------------------------------------------
@query
def scan_recent(spark, d):
    return scans.recent(raw(spark, d, S.HRV), S.HRV, AS_OF, 14, 10).select(
        "user_id", "value", "source_device", "started_at")


@query
def scan_recent_all(spark, d):
    return scans.recent(raw(spark, d, S.HRV), S.HRV, AS_OF, 14).select("user_id", "value", "source_device", "started_at")


@query
def scan_range(spark, d):
    return scans.in_range(raw(spark, d, S.RESTING_HR), S.RESTING_HR, "2024-01-05", "2024-01-20").select(
        "user_id", "value", "unit", "source_device", "started_at")


@query
def scan_day(spark, d):
    return scans.on_day(raw(spark, d), "2024-01-15").select(
        "user_id", "metric_type", "value", "unit", "started_at")


@query
def scan_summary(spark, d):
    return scans.summaries_since(summaries(spark, d, S.STEPS), S.STEPS, "2024-01-05", 5).select(
        "user_id", "date", "avg_value", "sum_value", "sample_count")


@query
def scan_summary_all(spark, d):
    return scans.summaries_since(summaries(spark, d, S.STEPS), S.STEPS, "2024-01-05").select(
        "user_id", "date", "avg_value", "sum_value", "sample_count")


@query
def source_filter(spark, d):
    return scans.recent(raw(spark, d, S.HRV), S.HRV, AS_OF, 30, source="apple watch").select(
        "user_id", "value", "source_device", "started_at")


@query
def types_before_cutoff(spark, d):
    return scans.types_before(raw(spark, d), CUT)


@query
def kind_counts(spark, d):
    return scans.kind_counts(raw(spark, d))


@query
def backfill_chunks(spark, d):
    return scans.backfill_plan(tables.long_samples(spark, d).withColumn(
        "started_at", F.col("started_at") + F.expr("INTERVAL 18 YEARS")))


@query
def local_day(spark, d):
    return scans.local_days(raw(spark, d))


@query
def day_bounds(spark, d):
    return scans.day_bounds(tables.long_samples(spark, d))


@query
def type_filter(spark, d):
    """Identifier guards over the event types dressed as identifiers, good and bad."""
    name = F.initcap("event_type")
    ids = tables.events(spark, d).select("event_id", F.explode(F.array(
        F.concat(F.lit(S.QUANTITY_PREFIX), name), F.concat(F.lit(S.QUANTITY_PREFIX), name, F.lit("B12")),
        F.concat(F.lit("HKClinicalTypeIdentifier"), name), F.concat(F.lit("HK-"), name),
        F.lit(S.WORKOUT))).alias("metric_type"))
    return (ids.withColumn("valid", is_valid_metric()).withColumn("importable", is_importable())
            .groupBy("metric_type", "valid", "importable").agg(F.count("*").alias("n")))


# --- ingest ----------------------------------------------------------------
def _instant(c):
    return F.date_format(utc_time(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def payload_rows(spark, d):
    """One batch per event: k div 10 step samples a minute apart, written with an
    offset, the last sent twice; the highest k have a device name past the size limit."""
    e = tables.events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    n = F.floor(F.col("k") / 10).cast("int")
    idx = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.concat(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(n)))

    def sample(i, pos):
        start = F.timestamp_add("MINUTE", i, F.col("ts"))
        return F.struct(
            F.lit(S.STEPS).alias("metric_type"), (F.col("value") + pos).alias("value"),
            F.lit("count").alias("unit"), F.when(F.col("k") > 85, F.repeat(F.lit("abc"), F.col("k"))).otherwise("Watch").alias("source_device"),
            _instant(start).alias("started_at"), F.lit(None).cast("string").alias("ended_at"),
            F.lit(None).cast("string").alias("metadata"))

    return e.select("user_id", F.col("event_id").alias("batch_no"), F.transform(idx, sample).alias("samples"))


@query
def ingest_validate(spark, d):
    return ingest.check_batches(payload_rows(spark, d), max_samples=9).select(
        "user_id", "batch_no", "sample_count", "verdict")


@query
def ingest_batch(spark, d):
    """Batches written as JSON files by Spark, then read, judged, unpacked and deduplicated."""
    path = shared_dir(spark, "json")
    payload_rows(spark, d).write.json(path)
    batches = ingest.check_batches(json_batches.read_batches(spark, path), max_samples=9)
    return ingest.dedupe_batch(ingest.samples_of(batches, "batch_no")).select(
        "user_id", "metric_type", "value", "started_at", "source_device")


@query
def ingest_parse(spark, d):
    """Batches arriving as a column of JSON text."""
    text = payload_rows(spark, d).select("user_id", "batch_no", F.to_json(F.struct("samples")).alias("payload"))
    return json_batches.parse_batches(text).select(
        "user_id", "batch_no", F.size("samples").cast("bigint").alias("sample_count"))


@query
def ingest_dedupe(spark, d):
    return ingest.dedupe_batch(tables.resent_samples(spark, d)).select(
        "user_id", "metric_type", "started_at", "value", "source_device", "seq")


@query
def upsert_latest(spark, d):
    s = tables.long_samples(spark, d)
    half = F.col("started_at") < F.lit("1999-01-01").cast("timestamp")
    return ingest.upsert_latest(s.filter(half), s.withColumn("value", half_up(F.col("value") + 1, 2))).select(
        "user_id", "metric_type", "started_at", "value", "seq")


@query
def insert_ignore(spark, d):
    s = tables.long_samples(spark, d)
    half = F.col("started_at") < F.lit("1999-01-01").cast("timestamp")
    return ingest.insert_ignore(s.filter(half), s).select("user_id", "metric_type", "started_at", "value", "seq")


@query
def import_top_types(spark, d):
    return recipes.import_top_types(raw(spark, d))


@query
def unit_normalise(spark, d):
    e = tables.events(spark, d)
    t, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    metric = (F.when(t == "view", S.QUANTITY_PREFIX + "DistanceWalkingRunning").when(t == "click", S.WEIGHT)
              .when(t == "error", S.QUANTITY_PREFIX + "BodyTemperature").when(t == "signup", S.HEART_RATE)
              .otherwise(S.QUANTITY_PREFIX + "FutureEnergyMetric"))
    unit = (F.when(t == "view", F.when(odd, "mi").otherwise("km")).when(t == "click", F.when(odd, "lb").otherwise("g"))
            .when(t == "error", "degF").when(t == "signup", F.when(odd, "furlong").otherwise("count/min"))
            .otherwise("kJ"))
    out = ingest.normalise_units(e.select("event_id", metric.alias("metric_type"), "value", unit.alias("unit")))
    return out.withColumn("value", half_up("value", 6))


@query
def sample_normalise(spark, d):
    e = tables.events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t, k = F.col("event_type"), F.col("k")
    metric = F.when(t == "signup", S.SLEEP).when(t == "purchase", S.WORKOUT).otherwise(S.HRV)
    none = F.lit(None)
    is_workout = t == "purchase"
    readings = e.select(
        "event_id", "user_id", metric.alias("metric_type"),
        F.when(t == "signup", (k % 7).cast("double")).otherwise(F.col("value")).alias("value"), F.lit("ms").alias("unit"),
        F.when(k % 2 == 0, "Ring").alias("device_name"), F.lit("Phone").alias("source_name"),
        F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.col("props").alias("metadata"),
        F.when(is_workout, F.concat(F.lit("HKWorkoutActivityType"), F.lit("Rowing"))).alias("workout_type"),
        F.when(is_workout, k * 60.0).alias("duration_seconds"), F.when(is_workout & (k % 2 == 0), k * 100.0).alias("distance_m"),
        F.when(is_workout, F.col("value")).alias("energy_kcal"), none.cast("double").alias("strokes"),
        none.cast("double").alias("flights"))
    out = ingest.normalise_samples(readings)

    def field(name):
        return F.get_json_object("metadata", f"$.{name}")

    return out.select("user_id", "metric_type", "started_at", "value", "unit", "source_device",
                      field("k").cast("bigint").alias("k"), field("sleep_stage").alias("sleep_stage"),
                      field("workout_type").alias("workout_type"),
                      field("duration_seconds").cast("double").alias("duration_seconds"),
                      field("total_distance_meters").cast("double").alias("distance"),
                      field("total_energy_burned_cal").cast("double").alias("energy"))


@query
def workout_type_dim(spark, d):
    e = tables.events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    name = (F.when(F.col("event_type") == "view", "Running").when(F.col("event_type") == "click", "WaterPolo")
            .when(F.col("event_type") == "error", "Other").when(F.col("event_type") == "signup", "Juggling")
            .otherwise("TaiChi"))
    rows = e.select("event_id", F.concat(F.lit("HKWorkoutActivityType"), name).alias("raw_name"))
    return workouts.with_display_name(rows).groupBy("raw_name", "display_name").agg(F.count("*").alias("n"))


@query
def pseudonymise(spark, d):
    return raw(spark, d, S.STEPS).groupBy(hygiene.pseudonym("user_id").alias("user_hash")).agg(
        F.count("*").alias("samples"))


@query
def contact_hygiene(spark, d):
    return hygiene.contact_hygiene(tables.contacts(spark, d))


# --- daily tiers -----------------------------------------------------------
POINT = ("user_id", "metric_type", "date", "avg_value", "min_value", "max_value", "sum_value", "sample_count")


@query
def daily_from_raw(spark, d):
    return points(spark, d).select(*POINT, "source")


@query
def daily_summary(spark, d):
    return daily.daily_summary(raw(spark, d)).select(*POINT, "unit")


@query
def tiered_daily(spark, d):
    s, old = tiers(spark, d, *QUANTITIES)
    return daily.tiered_daily(s, old, AS_OF, 25, CUT).select(*POINT, "source")


@query
def series_range(spark, d):
    s, _ = tiers(spark, d, *QUANTITIES)
    overlapping = daily.daily_summary(s.filter(scans.before_day("started_at", "2024-01-23")))
    return daily.series_range(s, overlapping, "2024-01-04", "2024-01-28", CUT).select(*POINT, "source")


@query
def view_daily_quantity(spark, d):
    s, old = tiers(spark, d)
    kept = retention.retain(s, None, AS_OF, RAW_DAYS).samples
    return daily.daily_quantity_view(kept, old).drop("unit", "source")


@query
def view_daily_quantity_utc(spark, d):
    s = raw(spark, d)
    old = daily.daily_summary(s.filter(scans.before_day("started_at", CUT, "UTC")), "UTC")
    kept = retention.retain(s, None, AS_OF, RAW_DAYS, "UTC").samples
    return daily.daily_quantity_view(kept, old, "UTC")


@query
def retention_apply(spark, d):
    s = raw(spark, d)
    earlier = daily.daily_summary(s.filter(scans.before_day("started_at", days_before(AS_OF, 20))))
    current = s.filter(~scans.before_day("started_at", days_before(AS_OF, 20)))
    return retention.retain(current, earlier, AS_OF, RAW_DAYS).summaries


@query
def retention_keep(spark, d):
    return retention.retain(raw(spark, d), None, AS_OF, RAW_DAYS).samples.select(
        "user_id", "metric_type", "value", "started_at", "seq")


@query
def retention_report(spark, d):
    return retention.retain(raw(spark, d), None, AS_OF, RAW_DAYS).report


@query
def retention_dry_run(spark, d):
    return retention.dry_run(raw(spark, d), AS_OF, RAW_DAYS)


# --- statistics ------------------------------------------------------------
@query
def weighted_mean(spark, d):
    return points(spark, d, S.HRV, S.RESTING_HR).groupBy("user_id", "metric_type").agg(
        stats.weighted_mean().alias("weighted_mean"))


@query
def avg_daily_total(spark, d):
    return points(spark, d, S.STEPS).groupBy("user_id", "metric_type").agg(
        stats.mean_daily_total().alias("avg_daily_total"))


@query
def kind_dispatch(spark, d):
    return stats.kind_averages(points(spark, d, *QUANTITIES))


@query
def metric_stats(spark, d):
    return tools.get_metric_stats(*tiers(spark, d, *QUANTITIES), AS_OF, 90, raw_from=CUT)


@query
def metric_stats_raw_only(spark, d):
    """Without a retention run all raw samples count."""
    return tools.get_metric_stats(raw(spark, d, *QUANTITIES), None, AS_OF, 90)


@query
def long_term_uncapped(spark, d):
    """A window of eleven years."""
    return tools.get_metric_stats(tables.long_samples(spark, d), None, LONG_AS_OF, 4000)


@query
def search_records(spark, d):
    return tools.search_records(*tiers(spark, d, *QUANTITIES), AS_OF, 90, 20.0, 120.0, limit=10, raw_from=CUT)["records"]


@query
def search_counts(spark, d):
    return tools.search_records(*tiers(spark, d, *QUANTITIES), AS_OF, 90, 20.0, 120.0, raw_from=CUT)["counts"]


@query
def search_sleep_minutes(spark, d):
    return tools.search_records(raw(spark, d, S.SLEEP), None, AS_OF, 90, max_value=100.0, limit=None,
                                metrics=(S.SLEEP,))["records"]


@query
def compare_periods(spark, d):
    return tools.compare_periods(*tiers(spark, d, *QUANTITIES), AS_OF, ("2024-01-03", "2024-01-16"),
                                 ("2024-01-14", "2024-01-29"), "early", "late", raw_from=CUT)


@query
def long_term_monthly(spark, d):
    return tools.get_long_term_trend(*long_tiers(spark, d), LONG_AS_OF, 80, raw_from=LONG_CUT)["monthly"]


@query
def long_term_overall(spark, d):
    return tools.get_long_term_trend(*long_tiers(spark, d), LONG_AS_OF, 80, raw_from=LONG_CUT)["overall"]


@query
def long_term_daily(spark, d):
    return tools.get_long_term_trend(*long_tiers(spark, d), LONG_AS_OF, 80, raw_from=LONG_CUT)["daily"].select(*POINT, "source")


@query
def metric_stats_approx(spark, d):
    return stats.approx_metric_stats(points(spark, d, *QUANTITIES))


# --- reports ---------------------------------------------------------------
@query
def health_summary(spark, d):
    return tools.get_health_summary(raw(spark, d), AS_OF, 7)


def _sleep(spark, d):
    return tools.get_sleep(raw(spark, d, S.SLEEP), AS_OF, 21)


@query
def sleep_segments(spark, d):
    return _sleep(spark, d)["segments"]


@query
def sleep_nights(spark, d):
    return _sleep(spark, d)["nights"]


@query
def sleep_summary(spark, d):
    return _sleep(spark, d)["summary"]


@query
def sleep_nightly(spark, d):
    return nights(spark, d).select("user_id", "night_date", "sleep_hours", "deep_minutes", "rem_minutes", "segment_count")


@query
def sleep_nights_priority(spark, d):
    return sleep.nights_by_priority(raw(spark, d, S.SLEEP), ["Oura", "Apple Watch"])


@query
def sleep_stage_rows(spark, d):
    return sleep.stage_rows(raw(spark, d, S.SLEEP))


@query
def sleep_sessions(spark, d):
    return sleep.sessions(raw(spark, d, S.SLEEP), 240)


def _hrv(spark, d):
    return tools.get_hrv_trend(*tiers(spark, d, S.HRV), AS_OF, 30, raw_from=CUT)


@query
def hrv_daily(spark, d):
    return _hrv(spark, d)["daily"]


@query
def hrv_trend(spark, d):
    return _hrv(spark, d)["trend"]


@query
def query_metric_raw(spark, d):
    return tools.query_metric(raw(spark, d, S.RESTING_HR), None, S.RESTING_HR, AS_OF, 10)["samples"].drop("metadata", "ended_at")


@query
def query_metric_stats(spark, d):
    return tools.query_metric(raw(spark, d, S.RESTING_HR), None, S.RESTING_HR, AS_OF, 10, limit=3)["stats"]


@query
def query_metric_daily(spark, d):
    return tools.query_metric(*tiers(spark, d, S.HRV), S.HRV, AS_OF, 28, raw_from=CUT, granularity="day")["daily"].select(*POINT, "source")


@query
def query_metric_overall(spark, d):
    return tools.query_metric(*tiers(spark, d, S.STEPS), S.STEPS, AS_OF, 28, raw_from=CUT, granularity="day")["stats"]


def _workouts(spark, d, limit=20):
    return tools.get_workouts(raw(spark, d, S.WORKOUT), AS_OF, 30, limit)


@partial(query, name="workouts")
def workouts_list(spark, d):
    return _workouts(spark, d, 5)["workouts"]


@query
def workouts_all(spark, d):
    return _workouts(spark, d, None)["workouts"]


@query
def workouts_summary(spark, d):
    return _workouts(spark, d, 5)["summary"]  # a limit shortens the listing only


@query
def workouts_by_type(spark, d):
    return _workouts(spark, d, 5)["by_type"]


def _snapshot(spark, d):
    return tools.get_daily_snapshot(raw(spark, d, *tables.BASE_METRICS, S.WEIGHT, S.ACTIVE_ENERGY), "2024-01-15")


@query
def daily_snapshot(spark, d):
    return _snapshot(spark, d)["highlights"]


@query
def daily_snapshot_rows(spark, d):
    return _snapshot(spark, d)["rows"]


@query
def daily_snapshot_workouts(spark, d):
    return _snapshot(spark, d)["workouts"]


COACHING = (S.STEPS, S.HRV, S.RESTING_HR, S.SLEEP, S.WORKOUT, S.VO2MAX, S.WEIGHT, S.ACTIVE_ENERGY)


@query
def coaching_recovery(spark, d):
    return tools.coaching_recovery(raw(spark, d, S.HRV, S.RESTING_HR), AS_OF)


@query
def coaching_sleep(spark, d):
    return tools.coaching_sleep(raw(spark, d, S.SLEEP), AS_OF)


@query
def coaching_load(spark, d):
    return tools.coaching_load(raw(spark, d, S.WORKOUT), AS_OF)


@query
def coaching_activity(spark, d):
    return tools.coaching_activity(raw(spark, d, S.STEPS, S.ACTIVE_ENERGY), AS_OF)


@query
def coaching_markers(spark, d):
    return tools.coaching_markers(raw(spark, d, S.VO2MAX, S.WEIGHT), AS_OF)


@query
def coaching_brief(spark, d):
    return tools.get_coaching_brief(raw(spark, d, *COACHING), AS_OF)


# --- recipes ---------------------------------------------------------------
@query
def inventory(spark, d):
    return recipes.inventory(raw(spark, d))


@query
def freshness(spark, d):
    return recipes.freshness(raw(spark, d), AS_OF)


@query
def last_record(spark, d):
    return recipes.last_record(raw(spark, d))


@query
def recent_rows(spark, d):
    return recipes.recent_rows(raw(spark, d, S.HRV), S.HRV, AS_OF)


@query
def monthly_raw(spark, d):
    return recipes.monthly_raw(tables.long_samples(spark, d), S.RESTING_HR)


@query
def yearly_summary(spark, d):
    return recipes.summary_means(long_tiers(spark, d)[1], S.RESTING_HR, "year", 2)


@query
def monthly_summary(spark, d):
    return recipes.summary_means(long_tiers(spark, d)[1], S.RESTING_HR, "month", 1)


@query
def weekly_digest(spark, d):
    return recipes.weekly_digest(raw(spark, d, S.WORKOUT), summaries(spark, d, S.STEPS, S.HRV), CUT)


@query
def threshold_alert(spark, d):
    return recipes.threshold_alert(summaries(spark, d, S.HRV), S.HRV, CUT, 40.0)


@query
def monthly_two_metric(spark, d):
    return recipes.monthly_two_metric(summaries(spark, d, S.HRV, S.RESTING_HR), AS_OF)


@query
def source_audit(spark, d):
    return recipes.source_audit(raw(spark, d))


# --- analyses --------------------------------------------------------------
@query
def low_hrv_prior_sleep(spark, d):
    return analyses.low_hrv_prior_sleep(hrv_days(spark, d), nights(spark, d), LOW_HRV)


@query
def deep_band_next_hrv(spark, d):
    return analyses.deep_band_next_hrv(nights(spark, d), hrv_days(spark, d))


@query
def corr_sleep_hrv(spark, d):
    return analyses.sleep_hrv_correlation(nights(spark, d), hrv_days(spark, d))


@query
def load_before_low_hrv(spark, d):
    return analyses.load_before_low_hrv(hrv_days(spark, d), workout_rows(spark, d), LOW_HRV)


@query
def heavy_week_next_hrv(spark, d):
    return analyses.heavy_week_next_hrv(workout_rows(spark, d), hrv_days(spark, d), 3)


@query
def weekly_volume(spark, d):
    return workouts.weekly_volume(workout_rows(spark, d))


@query
def monthly_volume_change(spark, d):
    return workouts.monthly_change(workout_rows(spark, d))


@query
def type_share(spark, d):
    return workouts.type_share(workout_rows(spark, d))


@query
def top_workouts(spark, d):
    return workouts.top_workouts(workout_rows(spark, d), "duration_minutes", 5)


@query
def top_workouts_calories(spark, d):
    return workouts.top_workouts(workout_rows(spark, d), "calories_burned", 10)


@query
def streaks(spark, d):
    return workouts.streaks(workout_rows(spark, d), 2)


@query
def suppression_runs(spark, d):
    return analyses.suppression_runs(points(spark, d, S.HRV, S.RESTING_HR), 1)


@query
def declining_runs(spark, d):
    return trends.declining_runs(points(spark, d, S.HRV), 3)


@query
def season_compare(spark, d):
    return trends.season_compare(long_points(spark, d))


@query
def yoy(spark, d):
    return trends.year_over_year(long_points(spark, d))


@query
def weekday_pattern(spark, d):
    return trends.weekday_pattern(points(spark, d, *QUANTITIES))


@query
def weekday_sleep(spark, d):
    return trends.weekday_pattern(sleep.as_points(nights(spark, d)))


@query
def recovery_score(spark, d):
    return analyses.recovery_score(points(spark, d, S.HRV, S.RESTING_HR), nights(spark, d), AS_OF)


@query
def baseline_status(spark, d):
    return trends.baseline_status(points(spark, d, *QUANTITIES))


@query
def drop_outliers(spark, d):
    return trends.drops(points(spark, d, S.HRV))


@query
def rolling_7d(spark, d):
    return trends.rolling_mean(points(spark, d, *QUANTITIES))


@query
def bedtime_effect(spark, d):
    return sleep.bedtime_effect(nights(spark, d))


@query
def stage_share(spark, d):
    return sleep.stage_share(nights(spark, d), "week")


@query
def best_worst_night(spark, d):
    return sleep.best_worst_night(nights(spark, d))


@query
def device_diff(spark, d):
    return analyses.device_difference(raw(spark, d, S.HRV), S.HRV)


@query
def illness_flag(spark, d):
    return analyses.illness_flag(points(spark, d, S.SPO2, S.RESPIRATORY_RATE, S.HRV))


@query
def trend_with_load(spark, d):
    return analyses.trend_with_load(points(spark, d, S.WEIGHT), workout_rows(spark, d), S.WEIGHT, "week")


@query
def load_correlation(spark, d):
    return analyses.load_correlation(
        analyses.trend_with_load(points(spark, d, S.WEIGHT), workout_rows(spark, d), S.WEIGHT, "week"))


@query
def heavy_months_hrv(spark, d):
    return analyses.heavy_months_hrv(workout_rows(spark, d), hrv_days(spark, d), 1.0)


# --- files and streams -----------------------------------------------------
def _publish(spark, d, late):
    """The tiers after a retention run; `late` rows arrive afterwards, as often as given."""
    root = shared_dir(spark, "publish")
    s = raw(spark, d)
    first = s.filter(F.col("seq") % 7 != 0) if late else s
    publish(spark, root, first, daily.daily_summary(s.filter(F.lit(False))))
    retention.run_retention(spark, root, AS_OF, RAW_DAYS)
    for _ in range(late):
        upsert_into_tiers(spark, root, s.filter(F.col("seq") % 7 == 0))
    kept, stored = open_tiers(spark, root)
    return daily.daily_quantity_view(kept, stored).drop("unit")


@query
def publish_tiers(spark, d):
    """Both tiers published, put through a retention run, and read back as one daily series."""
    return _publish(spark, d, 0)


@query
def publish_late_twice(spark, d):
    """A seventh of all samples arrives after the retention run, twice: as if it had come in time, once."""
    return _publish(spark, d, 2)


def _many_a_day(spark, d):
    """Multi-year samples with distinct keys, several on most days."""
    s = tables.long_samples(spark, d)
    return ingest.latest_per_key(s.withColumn("started_at", F.timestamp_add("MINUTE", F.col("seq") % 600, "started_at")))


@query
def late_after_drop(spark, d):
    """Raws of the expired months are dropped, then a seventh of all samples arrives, twice: as if nothing had been dropped."""
    root = shared_dir(spark, "late-after-drop")
    s = _many_a_day(spark, d)
    publish(spark, root, s.filter(F.col("seq") % 7 != 0), daily.daily_summary(s.filter(F.lit(False))), buckets=1)
    retention.run_retention(spark, root, "1999-03-20", S.RAW_DAYS, drop=True)
    for _ in range(2):
        upsert_into_tiers(spark, root, s.filter(F.col("seq") % 7 == 0))
    return daily.daily_quantity_view(*open_tiers(spark, root)).drop("unit")


def _with_deltas(spark, d):
    """A store that two overlapping deliveries have come to."""
    root = shared_dir(spark, "deltas")
    s = _many_a_day(spark, d)
    publish(spark, root, s.filter(F.col("seq") % 11 != 0), daily.daily_summary(s.filter(F.lit(False))), buckets=2)
    upsert_into_tiers(spark, root, s.filter(F.col("seq") % 5 == 0).withColumn("value", F.col("value") + 1))
    upsert_into_tiers(spark, root, s.filter((F.col("seq") % 7 == 0) | (F.col("seq") % 11 == 0)).withColumn(
        "value", F.col("value") + 2))
    return root


@query
def upsert_delta_merge(spark, d):
    """Stored rows and two deltas, merged when they are read."""
    return stored_samples(spark, _with_deltas(spark, d)).select("user_id", "metric_type", "started_at", "value", "seq")


@query
def compact_deltas(spark, d):
    """The same after the deltas have been folded into their buckets."""
    root = _with_deltas(spark, d)
    compact(spark, root)
    return stored_samples(spark, root).select("user_id", "metric_type", "started_at", "value", "seq")


def _xml(spark, samples, spoilt=False):
    """Samples written as XML exports of a bounded number of records by Spark; sleep values as stage names.

    Of `spoilt` ones, some have no valid metric and some no date.
    """
    path = shared_dir(spark, "xml")
    metric, start = F.col("metric_type"), "started_at"
    if spoilt:
        metric = F.when(F.col("seq") % 13 == 0, "nothing").otherwise(metric)

    def text(c):
        return F.concat(F.date_format(utc_time(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))

    value = F.when(F.col("metric_type") == S.SLEEP, stage_identifier("value")).otherwise(F.col("value").cast("string"))
    begin = F.when(F.col("seq") % 17 == 0, "soon").otherwise(text(start)) if spoilt else text(start)
    records = samples.select(
        metric.alias("_type"), F.col("source_device").alias("_sourceName"), F.col("unit").alias("_unit"),
        begin.alias("_startDate"), text("ended_at").alias("_endDate"), value.alias("_value"))
    records.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").option(
        "maxRecordsPerFile", 50_000).save(path)
    return path


@query
def xml_import(spark, d):
    """An XML export imported."""
    return xml_export.normalise_records(xml_export.read_records(spark, _xml(spark, raw(spark, d))), "me").drop("metadata")


@query
def xml_import_split(spark, d):
    """The same export, read from splits of its files."""
    records = xml_export.read_records_split(spark, _xml(spark, raw(spark, d)))
    return xml_export.normalise_records(records, "me").drop("metadata")


def _import_rejects(spark, d):
    return xml_export.quarantined(xml_export.read_records_split(spark, _xml(spark, raw(spark, d, *QUANTITIES), spoilt=True)), "me")


@query
def import_rejects(spark, d):
    """What an import quarantines: records without a valid metric or start."""
    content = F.from_json("content", rejects.FIELDS)
    return _import_rejects(spark, d).select(
        "source", "user_id", "reason", content["metric_type"].alias("metric_type"),
        content["value"].cast("double").alias("value"), content["started_at"].alias("started_at"))


@query
def replay_rejects(spark, d):
    """The same rejects mended, kept, and replayed to samples."""
    path = shared_dir(spark, "rejects")
    rejects.keep(_import_rejects(spark, d), path, 1)

    def mend(found):
        named = F.replace("content", F.lit('"nothing"'), F.lit(f'"{S.STEPS}"'))
        return found.withColumn("content", F.replace(named, F.lit('"soon"'), F.lit('"2024-01-01T00:00:00Z"')))

    return rejects.replay(rejects.read(spark, path), mend)[0].select("user_id", "metric_type", "value", "unit", "started_at")


@query
def ingest_unnumbered(spark, d):
    """Batches without user and number, all in one file: of equal instants the last line counts."""
    path = shared_dir(spark, "unnumbered")
    e = tables.events(spark, d)
    sample = F.struct(F.lit(S.STEPS).alias("metric_type"), F.col("value"), F.lit("count").alias("unit"),
                      F.lit("Watch").alias("source_device"), _instant(F.date_trunc("hour", "ts")).alias("started_at"),
                      F.lit(None).cast("string").alias("ended_at"), F.lit(None).cast("string").alias("metadata"))
    e.coalesce(1).sortWithinPartitions("event_id").select(F.array(sample).alias("samples")).write.json(path)
    judged = ingest.check_batches(json_batches.read_batches(spark, path, user_id="me"))
    return ingest.latest_per_key(ingest.samples_of(judged, "batch_no")).select("user_id", "metric_type", "started_at", "value")


@query
def backfill_resume(spark, d):
    """History loaded by two runs, the first of which ends half way."""
    root = shared_dir(spark, "backfill")
    s = tables.long_samples(spark, d)
    publish(spark, root, s.limit(0), daily.daily_summary(s.limit(0)), buckets=1)
    backfill.run_backfill(spark, root, s, at_once=10, most=2)
    backfill.run_backfill(spark, root, s, at_once=10)
    return stored_samples(spark, root).select("user_id", "metric_type", "started_at", "value", "seq")


@query
def xml_to_store(spark, d):
    """All importable metrics from XML into the store, twice; of equal instants one value stays."""
    root = shared_dir(spark, "import")
    s = raw(spark, d)
    publish(spark, root, s.limit(0).withColumn("user_id", F.lit("me")), daily.daily_summary(s.limit(0)))
    whole = s.groupBy("metric_type", F.date_trunc("second", "started_at").alias("started_at")).agg(
        F.max("value").alias("value"), F.max("unit").alias("unit"), F.max("source_device").alias("source_device"),
        F.max("ended_at").alias("ended_at"))
    path = _xml(spark, whole)
    for _ in range(2):
        xml_export.import_into_store(spark, path, "me", root)
    return stored_samples(spark, root).select("user_id", "metric_type", "started_at", "value")


@query
def xml_import_report(spark, d):
    return xml_export.import_report(xml_import(spark, d))


@query
def stream_ingest(spark, d):
    root = shared_dir(spark, "stream-ingest")
    payload_rows(spark, d).write.json(f"{root}/landing")
    pipelines.ingest_batches(spark, f"{root}/landing", f"{root}/sink", f"{root}/checkpoint", max_samples=9)
    return pipelines.current(spark, f"{root}/sink").select("user_id", "metric_type", "started_at", "value")


@query
def stream_upsert(spark, d):
    root = shared_dir(spark, "stream-upsert")
    payload_rows(spark, d).write.json(f"{root}/landing")
    pipelines.upsert_batches(spark, f"{root}/landing", f"{root}/store", f"{root}/checkpoint", max_samples=9)
    return stored_samples(spark, f"{root}/store").select("user_id", "metric_type", "started_at", "value")


@query
def stream_rejects(spark, d):
    """What a stream did not store, with the reason."""
    root = shared_dir(spark, "stream-rejects")
    payload_rows(spark, d).write.json(f"{root}/landing")
    pipelines.ingest_batches(spark, f"{root}/landing", f"{root}/sink", f"{root}/checkpoint", max_samples=9,
                             rejects=f"{root}/rejects")
    return rejects.read(spark, f"{root}/rejects").select("user_id", F.col("place").cast("bigint").alias("batch_no"), "reason")


@query
def ingest_rejects(spark, d):
    """The batches that are not stored, with the reason."""
    path = shared_dir(spark, "json")
    payload_rows(spark, d).write.json(path)
    judged = ingest.check_batches(json_batches.read_batches(spark, path), max_samples=9)
    return ingest.rejects(judged, "batch_no").select("user_id", "batch_no", "reason")


@query
def stream_dedupe(spark, d):
    """Samples sent twice, the second copy corrected, over several micro-batches."""
    root = shared_dir(spark, "stream-dedupe")
    rows = tables.resent_samples(spark, d)
    rows.repartition(4, "seq").write.parquet(f"{root}/landing")
    pipelines.dedupe(spark, f"{root}/landing", rows.schema, f"{root}/store", f"{root}/checkpoint", files_at_once=2)
    return stored_samples(spark, f"{root}/store").select("user_id", "metric_type", "started_at", "unit", "source_device", "value")


@query
def stream_daily(spark, d):
    """Daily points kept by a stream whose files come in any order, so that most rows are late."""
    root = shared_dir(spark, "stream-daily")
    s = raw(spark, d, *QUANTITIES)
    s.repartition(3, "seq").write.parquet(f"{root}/landing")
    pipelines.daily_points(spark, f"{root}/landing", s.schema, f"{root}/store", f"{root}/checkpoint", CUT, files_at_once=1)
    return pipelines.closed_and_open(spark, f"{root}/store").select(*POINT, "state")
