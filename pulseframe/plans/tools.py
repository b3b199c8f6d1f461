"""The eleven reports.

Each takes the two tiers and an explicit `as_of` day and answers for every
user at once; `user_id=` narrows it to one.  Results are flat DataFrames; a
report with several parts returns them by name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.metrics import is_summarisable, metadata_number, workout_type
from ..functions.numbers import half_up
from ..functions.time import as_date, check_range, days_before, in_days, local_day, minutes_between, night_date, positive
from ..operators import daily, scans, sleep, stats, trends, workouts

# --- fixed values: the note that goes with each HRV trend ------------------
RECOVERY_NOTES = {
    "improving": "Good recovery — normal or increased training load appropriate",
    "declining": "Recovery declining — prioritize sleep, reduce intensity if trend continues",
}
DEFAULT_NOTE = "Recovery stable"


def _of(samples: DataFrame, *metrics: str, user_id=None) -> DataFrame:
    return scans.for_metrics(scans.for_user(samples, user_id), *metrics)


def _tier_rows(samples, summaries, metrics, user_id):
    """Both tiers cut down to a user and to `metrics`, or to all quantities when empty."""
    samples = scans.for_metrics(scans.for_user(samples, user_id), *metrics).filter(is_summarisable())
    if summaries is not None:
        summaries = scans.for_metrics(scans.for_user(summaries, user_id), *metrics)
    return samples, summaries


def _range(samples, summaries, start, end, raw_from, tz, metrics, user_id) -> DataFrame:
    """Daily points of a closed range.  Sleep, when asked for, comes as minutes per night;
    the other category metrics have no daily value."""
    points = daily.series_range(*_tier_rows(samples, summaries, metrics, user_id), start, end, raw_from, tz)
    if S.SLEEP not in metrics:
        return points
    asleep = sleep.as_points(sleep.nights(_nights_of(samples, start, end, sleep.DEFAULT_SOURCE, user_id, tz)))
    return asleep if tuple(metrics) == (S.SLEEP,) else points.unionByName(asleep)


def _nights_of(samples, start, end, source, user_id, tz) -> DataFrame:
    """Sleep segments of the nights from `start` to `end`.  A night runs past midnight, so its
    segments may start on the following day."""
    window = in_days("started_at", start, as_date(end) + dt.timedelta(days=1), tz)
    segs = sleep.segments(scans.for_user(samples, user_id).filter(window), source, tz)
    return segs.filter(F.col("night_date").between(F.lit(as_date(start)), F.lit(as_date(end))))


def _series(samples, summaries, as_of, days, raw_from, tz, metrics, user_id) -> DataFrame:
    """Daily points of the window ending at `as_of`."""
    start = days_before(as_of, positive(days, "days"))
    return _range(samples, summaries, start, as_of, raw_from, tz, metrics, user_id)


def _tiered(samples, summaries, as_of, days, raw_from, tz, metrics, user_id) -> DataFrame:
    return daily.tiered_daily(*_tier_rows(samples, summaries, metrics, user_id), as_of, positive(days, "days"), raw_from, tz)


def _moment():
    """The order of samples of one instant is that of their arrival."""
    return F.struct("started_at", "seq")


# --- overview --------------------------------------------------------------
def get_health_summary(samples: DataFrame, as_of, days: int = 7, user_id=None,
                       tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Steps, HRV, resting heart rate, sleep records and workouts of the last `days` days."""
    as_of = as_date(as_of)
    df = _of(samples, S.STEPS, S.HRV, S.RESTING_HR, S.SLEEP, S.WORKOUT, user_id=user_id)
    m, v = F.col("metric_type"), F.col("value")
    per_day = (df.filter(in_days("started_at", days_before(as_of, days), as_of, tz))
               .groupBy("user_id", "metric_type", local_day("started_at", tz).alias("date"),
                        F.when(m == S.WORKOUT, workout_type()).alias("workout_type"))
               .agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("total"),
                    F.max_by(v, F.when(v.isNotNull(), _moment())).alias("latest"),
                    F.max(F.when(v.isNotNull(), _moment())).alias("latest_at"),
                    F.count(F.when(F.col("metadata").ilike("%sleep%"), 1)).alias("staged")))

    def only(metric, c):
        return F.when(m == metric, F.col(c))

    def mean(metric):
        return half_up(F.try_divide(F.sum(only(metric, "total")), F.sum(only(metric, "valued"))), 1)

    def latest(metric):
        return F.max_by(only(metric, "latest"), only(metric, "latest_at"))

    def rows(metric):
        return F.coalesce(F.sum(only(metric, "n")), F.lit(0))

    steps_day = F.when((m == S.STEPS) & (F.col("valued") > 0), F.col("total"))
    return per_day.groupBy("user_id").agg(
        half_up(F.sum(steps_day), 0).alias("steps_total"), half_up(F.avg(steps_day), 1).alias("steps_daily_avg"),
        F.count(F.when(m == S.STEPS, 1)).alias("steps_days_with_data"),
        mean(S.HRV).alias("hrv_avg"), latest(S.HRV).alias("hrv_latest"), rows(S.HRV).alias("hrv_readings"),
        mean(S.RESTING_HR).alias("resting_hr_avg"), latest(S.RESTING_HR).alias("resting_hr_latest"),
        rows(S.SLEEP).alias("sleep_records"),
        F.coalesce(F.sum(only(S.SLEEP, "staged")), F.lit(0)).alias("sleep_stage_records"),
        rows(S.WORKOUT).alias("workout_count"),
        F.array_join(F.array_sort(F.collect_set("workout_type")), ",").alias("workout_types"))


def get_sleep(samples: DataFrame, as_of, days: int = 7, source: str | None = sleep.DEFAULT_SOURCE,
              user_id=None, tz: str = S.DEFAULT_TZ) -> dict[str, DataFrame]:
    """Segments, nights and a per-user summary of the last `days` nights, each night whole."""
    as_of = as_date(as_of)
    segs = _nights_of(samples, days_before(as_of, days), as_of, source, user_id, tz)
    nightly = sleep.nights(segs)
    shown = segs.select("user_id", "night_date", "stage", "started_at", "ended_at",
                        half_up("minutes", 1).alias("duration_minutes"))
    return {"segments": shown, "nights": nightly, "summary": sleep.summary(nightly)}


def get_hrv_trend(samples: DataFrame, summaries: DataFrame | None, as_of, days: int = 30, user_id=None,
                  raw_from=None, tz: str = S.DEFAULT_TZ) -> dict[str, DataFrame]:
    """Daily HRV and the last seven days with data against the seven before."""
    points = _tiered(samples, summaries, as_of, days, raw_from, tz, (S.HRV,), user_id)
    per_day = points.filter(F.col("avg_value").isNotNull()).select(
        "user_id", "date", half_up("avg_value", 1).alias("avg_hrv_ms"), "source")
    trend = trends.week_over_week(points).select(
        "user_id", "days_with_data", F.col("avg").alias("avg_hrv_ms"), F.col("latest").alias("latest_hrv_ms"),
        F.col("delta").alias("delta_ms"), "direction")
    return {"daily": per_day, "trend": trend}


def query_metric(samples: DataFrame, summaries: DataFrame | None, metric: str, as_of, days: int = 7,
                 limit: int | None = None, user_id=None, raw_from=None, tz: str = S.DEFAULT_TZ,
                 granularity: str = "samples") -> dict[str, DataFrame]:
    """The samples of a window, or with ``granularity="day"`` its daily points from both tiers, and
    statistics.  Statistics cover the whole window; `limit` only shortens the listing of samples."""
    if granularity == "day":
        points = _tiered(samples, summaries, as_of, days, raw_from, tz, (metric,), user_id)
        return {"daily": points, "stats": stats.overall(points)}
    if granularity != "samples":
        raise ValueError(f"granularity is 'samples' or 'day', got {granularity!r}")
    rows = scans.recent(scans.for_user(samples, user_id), metric, as_of, positive(days, "days"), tz=tz)
    listed = scans.newest(rows, limit)
    return {"samples": listed.select("user_id", "value", "unit", "started_at", "ended_at",
                                     F.col("source_device").alias("source"), "metadata"),
            "stats": rows.groupBy("user_id").agg(
                F.count("*").alias("count"), half_up(F.avg("value"), 2).alias("avg"),
                F.min("value").alias("min"), F.max("value").alias("max"))}


def get_workouts(samples: DataFrame, as_of, days: int = 30, limit: int | None = None, user_id=None,
                 tz: str = S.DEFAULT_TZ) -> dict[str, DataFrame]:
    """Workouts per user, the newest `limit` if given, and the totals and count by type of all of them."""
    as_of = as_date(as_of)
    df = scans.for_user(samples, user_id).filter(in_days("started_at", days_before(as_of, days), as_of, tz))
    rows = workouts.recent_workouts(df, None, tz)
    return {"workouts": scans.newest(rows, limit).drop("seq"), "summary": workouts.totals(rows),
            "by_type": workouts.by_type(rows)}


def get_daily_snapshot(samples: DataFrame, day, limit: int | None = None, user_id=None,
                       tz: str = S.DEFAULT_TZ) -> dict[str, DataFrame]:
    """Everything of one local day: highlights per user, the workouts, and the rows themselves.

    Highlights cover the whole day; only the row listing is limited.
    """
    day = as_date(day)
    df = scans.for_user(samples, user_id).filter(in_days("started_at", day, day, tz))
    m, v = F.col("metric_type"), F.col("value")

    def total(metric):
        return half_up(F.sum(F.when(m == metric, v)), 0)

    def first(metric):
        return F.min_by(v, F.when((m == metric) & v.isNotNull(), _moment()))

    def rows(metric):
        return F.count(F.when(m == metric, 1))

    highlights = df.groupBy("user_id").agg(
        F.count("*").alias("total_records"), F.count_distinct("metric_type").alias("metrics_present"),
        total(S.STEPS).alias("steps"), total(S.ACTIVE_ENERGY).alias("active_energy_cal"),
        first(S.RESTING_HR).alias("resting_hr_bpm"), first(S.HRV).alias("hrv_sdnn_ms"),
        first(S.WEIGHT).alias("weight_kg"), rows(S.SLEEP).alias("sleep_records"),
        rows(S.WORKOUT).alias("workouts"),
        half_up(F.sum(F.when(m == S.WORKOUT, metadata_number("duration_seconds"))) / 60, 1).alias("workout_minutes"),
        F.sum(F.when(m == S.WORKOUT, metadata_number("total_energy_burned_cal"))).alias("_cal"))
    highlights = (highlights.withColumn("workout_calories", half_up("_cal", 1)).drop("_cal")
                  .withColumn("truncated", F.lit(False) if limit is None else F.col("total_records") > limit))
    return {"highlights": highlights, "rows": scans.on_day(
        scans.for_user(samples, user_id), day, limit, tz).select(
        "user_id", "metric_type", "value", "unit", "source_device", "started_at"),
        "workouts": workouts.workouts(df, tz).select("user_id", "started_at", "workout_type", "duration_minutes",
                                                     F.col("calories_burned").alias("calories"))}


def get_long_term_trend(samples: DataFrame, summaries: DataFrame | None, as_of, months: int = 24,
                        metrics: tuple[str, ...] = (), user_id=None, raw_from=None,
                        tz: str = S.DEFAULT_TZ) -> dict[str, DataFrame]:
    """Monthly, overall and daily history over both tiers."""
    days = positive(months, "months") * 30
    points = _tiered(samples, summaries, as_of, days, raw_from, tz, metrics, user_id)
    return {"monthly": stats.monthly_trend(points), "overall": stats.overall(points), "daily": points}


def search_records(samples: DataFrame, summaries: DataFrame | None, as_of, days: int = 90, min_value=None,
                   max_value=None, limit: int | None = None, metrics: tuple[str, ...] = (), user_id=None,
                   raw_from=None, tz: str = S.DEFAULT_TZ, ascending: bool = False) -> dict[str, DataFrame]:
    """Days on which a metric crossed a threshold, and how many were searched and matched."""
    points = _series(samples, summaries, as_of, days, raw_from, tz, metrics, user_id)
    return {"records": stats.search_records(points, min_value, max_value, limit, ascending),
            "counts": stats.search_counts(points, min_value, max_value)}


def get_metric_stats(samples: DataFrame, summaries: DataFrame | None, as_of, days: int = 90,
                     metrics: tuple[str, ...] = (), user_id=None, raw_from=None,
                     tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Personal baseline statistics and percentiles."""
    return stats.metric_stats(_series(samples, summaries, as_of, days, raw_from, tz, metrics, user_id))


def compare_periods(samples: DataFrame, summaries: DataFrame | None, as_of, a: tuple, b: tuple,
                    label_a: str = "Period A", label_b: str = "Period B", metrics: tuple[str, ...] = (),
                    user_id=None, raw_from=None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Two date ranges of a metric, their difference and a verdict."""
    a, b = check_range(*a), check_range(*b)
    points = _range(samples, summaries, min(a[0], b[0]), max(a[1], b[1]), raw_from, tz, metrics, user_id)
    return stats.compare_periods(points, a, b, label_a, label_b)


# --- coaching brief --------------------------------------------------------
def _coaching_rows(samples: DataFrame, as_of, parts, source, user_id, tz: str) -> DataFrame:
    """The samples that the given parts of the brief are made of, in one pass over their metrics."""
    m, valued = F.col("metric_type"), F.col("value").isNotNull()

    def last(days):
        return in_days("started_at", days_before(as_of, days), as_of, tz)

    asleep = (m == S.SLEEP) & F.col("value").isin(*S.ASLEEP_STAGES) & F.col("ended_at").isNotNull()
    if source:
        asleep = asleep & scans.source_matches(source)
    of = {"recovery": ((S.HRV, S.RESTING_HR), 14, F.lit(True)), "sleep": ((S.SLEEP,), 14, asleep),
          "load": ((S.WORKOUT,), 30, F.lit(True)), "activity": ((S.STEPS, S.ACTIVE_ENERGY), 7, valued),
          "markers": ((S.VO2MAX, S.WEIGHT), 365, valued)}
    wanted = F.lit(False)
    for metrics, days, rule in (of[p] for p in parts):
        wanted = wanted | (m.isin(*metrics) & last(days) & rule)
    df = _of(samples, *[name for p in parts for name in of[p][0]], user_id=user_id)
    return df.filter(last(max(of[p][1] for p in parts)) & wanted)


def _coaching(samples: DataFrame, as_of, parts, source, user_id, tz: str) -> DataFrame:
    """The given parts of the brief, one row per user.

    The samples are reduced once, by hash, to a row per user, metric and local day (night for
    sleep, type for workouts); a second aggregation makes the columns from those rows.  The latest
    values come from the few samples of the metrics that have one.
    """
    as_of = as_date(as_of)
    m, v = F.col("metric_type"), F.col("value")
    rows = _coaching_rows(samples, as_of, parts, source, user_id, tz)
    date = F.when(m == S.SLEEP, night_date("started_at", tz)).when(m != S.WORKOUT, local_day("started_at", tz))
    seconds = F.when(m == S.WORKOUT, F.coalesce(metadata_number("duration_seconds"), F.lit(0.0)))
    sums = {"n": F.count("*"), "valued": F.count("value"), "total": F.sum("value"), "seconds": F.sum(seconds),
            "minutes": F.sum(F.when(m == S.SLEEP, minutes_between("started_at", "ended_at")))}
    needed = {"recovery": ("valued", "total"), "sleep": ("minutes",), "load": ("n", "seconds"), "activity": ("total",),
              "markers": ("n",)}
    kept = {name for p in parts for name in needed[p]}
    per_day = rows.groupBy("user_id", "metric_type", date.alias("date"),
                           F.when(m == S.WORKOUT, workout_type()).alias("type")).agg(
        *[c.alias(name) for name, c in sums.items() if name in kept])
    columns = {"recovery": _recovery_columns, "sleep": lambda _: _sleep_columns(), "load": lambda _: _load_columns(),
               "activity": lambda _: _activity_columns(), "markers": _marker_columns}
    latest = {"recovery": ((S.HRV, S.RESTING_HR), _latest_vitals), "markers": ((S.VO2MAX, S.WEIGHT), _latest_markers)}
    latest = [latest[p] for p in parts if p in latest]
    out = per_day.groupBy("user_id").agg(*[c for p in parts for c in columns[p](as_of)])
    if latest:
        few = scans.for_metrics(rows, *[name for metrics, _ in latest for name in metrics])
        out = out.join(few.groupBy("user_id").agg(*[c for _, made in latest for c in made(as_of, tz)]), "user_id", "left")
    if "recovery" in parts:
        out = _with_trend(out, rows.filter(m == S.HRV))
    if "sleep" in parts:
        out = _with_quality(out)
    if "markers" in parts:
        out = out.withColumn("weight_kg_30d_ago", F.when(F.col("_weights") > 1, F.col("_oldest"))).drop("_weights", "_oldest")
    return out


def _only(metric: str, column: str, where=None):
    rule = F.col("metric_type") == metric
    return F.when(rule if where is None else rule & where, F.col(column))


def _recovery_columns(as_of) -> list:
    week = F.col("date") >= F.lit(days_before(as_of, 6))

    def mean(metric, where=None):
        return half_up(F.try_divide(F.sum(_only(metric, "total", where)), F.sum(_only(metric, "valued", where))), 1)

    return [mean(S.HRV, week).alias("hrv_7d_avg_ms"), mean(S.RESTING_HR, week).alias("resting_hr_7d_avg_bpm"),
            mean(S.RESTING_HR).alias("resting_hr_14d_avg_bpm"),
            F.sum(_only(S.HRV, "total")).alias("_sum"), F.sum(_only(S.HRV, "valued")).alias("_n")]


def _with_trend(out: DataFrame, hrv: DataFrame) -> DataFrame:
    """The newest seven HRV samples against all earlier ones.  The earlier ones are the whole
    minus the newest seven, so no window ever holds a user's full sample list."""
    last7 = scans.newest(hrv, 7).groupBy("user_id").agg(F.sum("value").alias("_sum7"), F.count("value").alias("_n7"))
    delta = half_up(F.try_divide(F.col("_sum7"), F.col("_n7"))
                    - F.try_divide(F.col("_sum") - F.col("_sum7"), F.col("_n") - F.col("_n7")), 1)
    note = F.lit(DEFAULT_NOTE)
    for trend, text in RECOVERY_NOTES.items():
        note = F.when(F.col("hrv_trend") == trend, text).otherwise(note)
    return (out.join(last7, "user_id", "left").withColumn("hrv_delta_samples", delta)
            .withColumn("hrv_trend", F.coalesce(trends.direction(F.col("hrv_delta_samples"), 2.0), F.lit("unknown")))
            .withColumn("coaching_note", note).drop("_sum", "_n", "_sum7", "_n7"))


def _sleep_columns() -> list:
    """A user has at most one row for each of the 15 nights, or 16 that the window touches."""
    nightly = F.collect_list(F.when(F.col("metric_type") == S.SLEEP, F.struct("date", "minutes")))
    return [F.slice(F.sort_array(nightly, asc=False), 1, 7).alias("_nights")]


def _with_quality(out: DataFrame) -> DataFrame:
    n = F.size("_nights")
    minutes = F.aggregate("_nights", F.lit(0.0), lambda total, night: total + night["minutes"])
    h = F.col("avg_hours_last_7_nights")
    return (out.withColumn("avg_hours_last_7_nights", half_up(F.try_divide(minutes, n) / 60, 1))
            .withColumn("nights_tracked", F.when(n > 0, n.cast("bigint")))
            .withColumn("quality_flag", F.when(n == 0, "no data").when(h >= 7.5, "good").when(h >= 6.5, "borderline")
                        .otherwise("poor")).drop("_nights"))


def _load_columns() -> list:
    """Workouts have one row per type here."""
    n = F.sum(_only(S.WORKOUT, "n"))
    label = F.when(F.col("metric_type") == S.WORKOUT, F.concat_ws(":", "type", F.col("n").cast("string")))
    return [n.alias("total_workouts"), half_up(F.sum(_only(S.WORKOUT, "seconds")) / 3600, 1).alias("total_hours"),
            half_up(n / F.lit(4.3), 1).alias("weekly_avg_workouts"),
            F.when(n > 0, F.array_join(F.array_sort(F.collect_list(label)), ",")).alias("by_type")]


def _activity_columns() -> list:
    return [half_up(F.avg(half_up(_only(S.STEPS, "total"), 4)), 1).alias("avg_daily_steps"),
            half_up(F.avg(half_up(_only(S.ACTIVE_ENERGY, "total"), 4)), 1).alias("avg_active_energy_cal")]


def _marker_columns(as_of) -> list:
    month = F.col("date") >= F.lit(days_before(as_of, 30))
    return [F.sum(_only(S.WEIGHT, "n", month)).alias("_weights")]


def _timed(metric: str, where=None):
    """The moment of a sample of `metric` that has a value."""
    rule = (F.col("metric_type") == metric) & F.col("value").isNotNull()
    return F.when(rule if where is None else rule & where, _moment())


def _latest_vitals(as_of, tz: str) -> list:
    return [F.max_by("value", _timed(S.HRV)).alias("hrv_latest_ms"),
            F.max_by("value", _timed(S.RESTING_HR)).alias("resting_hr_latest_bpm")]


def _latest_markers(as_of, tz: str) -> list:
    in_month = _timed(S.WEIGHT, in_days("started_at", days_before(as_of, 30), as_of, tz))
    return [F.max_by("value", _timed(S.VO2MAX)).alias("vo2max_latest"),
            F.max_by("value", in_month).alias("weight_kg_latest"), F.min_by("value", in_month).alias("_oldest")]


def coaching_recovery(samples: DataFrame, as_of, user_id=None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """HRV and resting heart rate of the last 14 days; ``hrv_delta_samples`` sets the newest
    seven HRV samples against all earlier ones."""
    return _coaching(samples, as_of, ("recovery",), None, user_id, tz)


def coaching_sleep(samples: DataFrame, as_of, source: str | None = sleep.DEFAULT_SOURCE, user_id=None,
                   tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Mean hours of the newest seven nights in the last 14 days, and a quality flag."""
    return _coaching(samples, as_of, ("sleep",), source, user_id, tz)


def coaching_load(samples: DataFrame, as_of, user_id=None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Workouts of the last 30 days: count, hours, weekly rate and count by type."""
    return _coaching(samples, as_of, ("load",), None, user_id, tz)


def coaching_activity(samples: DataFrame, as_of, user_id=None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Mean daily steps and active energy of the last seven days."""
    return _coaching(samples, as_of, ("activity",), None, user_id, tz)


def coaching_markers(samples: DataFrame, as_of, user_id=None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Latest VO2 max of a year; latest and oldest weight of 30 days."""
    return _coaching(samples, as_of, ("markers",), None, user_id, tz)


def get_coaching_brief(samples: DataFrame, as_of, source: str | None = sleep.DEFAULT_SOURCE, user_id=None,
                       tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Recovery, sleep, training load, activity and fitness markers, one row per user, from one pass."""
    return _coaching(samples, as_of, ("recovery", "sleep", "load", "activity", "markers"), source, user_id, tz)
