"""Inventory, freshness and digest queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.metrics import short_metric_name
from ..functions.numbers import half_up
from ..functions.time import as_date, day_start, days_before, in_days, local_day
from ..operators.scans import for_metrics


def inventory(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows, first and last instant of every metric."""
    out = samples.groupBy("metric_type").agg(
        F.count("*").alias("sample_count"), F.min("started_at").alias("earliest"), F.max("started_at").alias("latest"))
    return out if limit is None else out.orderBy(F.desc("sample_count"), "metric_type").limit(limit)


def import_top_types(samples: DataFrame, limit: int = 15) -> DataFrame:
    """The metrics with most rows, under their short names."""
    return (samples.groupBy("metric_type").agg(F.count("*").alias("records"))
            .orderBy(F.desc("records"), "metric_type").limit(limit)
            .select(short_metric_name().alias("metric"), "records"))


def freshness(samples: DataFrame, as_of, limit: int | None = None, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Every metric, or the `limit` most recently written, and their age in hours at the start of `as_of`."""
    now = F.lit(day_start(as_of, tz))
    out = samples.groupBy("metric_type").agg(F.count("*").alias("rows"), F.max("started_at").alias("latest_record"))
    age = (F.unix_micros(now) - F.unix_micros("latest_record")) / F.lit(3_600_000_000.0)
    if limit is not None:
        out = out.orderBy(F.desc("latest_record"), "metric_type").limit(limit)
    return out.withColumn("hours_behind", half_up(age, 2))


def last_record(samples: DataFrame) -> DataFrame:
    """Per user: when anything was last recorded."""
    return samples.groupBy("user_id").agg(F.max("started_at").alias("last_record"), F.count("*").alias("rows"))


def recent_rows(samples: DataFrame, metric: str, as_of, days: int = 7, tz: str = S.DEFAULT_TZ) -> DataFrame:
    as_of = as_date(as_of)
    return (for_metrics(samples, metric).filter(in_days("started_at", days_before(as_of, days), as_of, tz))
            .select("user_id", "value", "started_at", "source_device"))


def monthly_raw(samples: DataFrame, metric: str, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Monthly mean of the samples themselves."""
    return for_metrics(samples, metric).groupBy(
        "user_id", F.trunc(local_day("started_at", tz), "month").alias("month")).agg(
        half_up(F.avg("value"), 2).alias("avg_value"))


def summary_means(summaries: DataFrame, metric: str, period: str, digits: int = 1,
                  column: str = "avg_value") -> DataFrame:
    """Mean of the stored daily values per month or year, with the days behind it."""
    return for_metrics(summaries, metric).groupBy("user_id", F.trunc("date", period).alias(period)).agg(
        half_up(F.avg(column), digits).alias("avg_value"), F.count("*").alias("days_with_data"))


def weekly_digest(samples: DataFrame, summaries: DataFrame, as_of, days: int = 7, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """HRV, steps and workouts of the last `days` days, one row per user."""
    as_of = as_date(as_of)
    start, m = days_before(as_of, days), F.col("metric_type")
    hrv, steps = F.when(m == S.HRV, F.col("avg_value")), F.when(m == S.STEPS, F.col("sum_value"))
    quantities = for_metrics(summaries, S.HRV, S.STEPS).filter(F.col("date").between(F.lit(start), F.lit(as_of)))
    digest = quantities.groupBy("user_id").agg(
        half_up(F.avg(hrv), 1).alias("avg_hrv"), half_up(F.min(hrv), 1).alias("min_hrv"),
        half_up(F.max(hrv), 1).alias("max_hrv"), F.count(hrv).alias("hrv_days"),
        half_up(F.avg(steps), 0).alias("avg_daily_steps"), half_up(F.sum(steps), 2).alias("total_steps"))
    sessions = (for_metrics(samples, S.WORKOUT).filter(in_days("started_at", start, as_of, tz))
                .groupBy("user_id").agg(F.count("*").alias("workout_count")))
    return digest.join(sessions, "user_id", "full_outer").withColumn(
        "workout_count", F.coalesce("workout_count", F.lit(0)))


def threshold_alert(summaries: DataFrame, metric: str, as_of, below: float) -> DataFrame:
    """Users whose value the day before `as_of` was below the threshold."""
    return for_metrics(summaries, metric).filter(
        (F.col("date") == F.lit(days_before(as_of, 1))) & (F.col("avg_value") < below)
    ).select("user_id", "date", "avg_value")


def monthly_two_metric(summaries: DataFrame, as_of, months: int = 6) -> DataFrame:
    """HRV and resting heart rate side by side per month, each averaged on its own."""
    as_of, m = as_date(as_of), F.col("metric_type")
    start = F.add_months(F.lit(as_of), -months)
    return (for_metrics(summaries, S.HRV, S.RESTING_HR).filter(F.col("date") >= start)
            .groupBy("user_id", F.trunc("date", "month").alias("month")).agg(
                half_up(F.avg(F.when(m == S.HRV, F.col("avg_value"))), 1).alias("avg_hrv"),
                half_up(F.avg(F.when(m == S.RESTING_HR, F.col("avg_value"))), 1).alias("avg_resting_hr")))


def source_audit(samples: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Which devices wrote which metric on which day."""
    return samples.groupBy("user_id", local_day("started_at", tz).alias("date"), "metric_type", "source_device").agg(
        F.count("*").alias("samples"))
