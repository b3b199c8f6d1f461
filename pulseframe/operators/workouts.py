"""Workout rows and load."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.metrics import WORKOUT_NAME_PREFIX, WORKOUT_NAMES, metadata_number, workout_type
from ..functions.numbers import half_up, ratio
from ..functions.time import local_day
from ..schema import DEFAULT_TZ, WORKOUT
from .scans import first_per, for_metrics
from .trends import runs


def workouts(samples: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """One row per workout, its metadata unpacked.  A distance of zero counts as missing."""
    metres = metadata_number("total_distance_meters")
    seconds = F.coalesce(metadata_number("duration_seconds"), F.lit(0.0))
    return for_metrics(samples, WORKOUT).select(
        "user_id", local_day("started_at", tz).alias("date"), "started_at", workout_type().alias("workout_type"),
        half_up(seconds / 60, 1).alias("duration_minutes"),
        F.when(metres != 0, half_up(metres / 1000, 2)).alias("distance_km"),
        metadata_number("total_energy_burned_cal").alias("calories_burned"),
        F.col("source_device").alias("source"), "seq")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_workouts"),
        half_up(F.sum("duration_minutes") / 60, 1).alias("total_duration_hours"))


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "workout_type").agg(
        F.count("*").alias("workouts"), half_up(F.sum("duration_minutes"), 1).alias("minutes"))


def type_share(rows: DataFrame) -> DataFrame:
    """Each type's share of a user's sessions and time, in percent."""
    w = Window.partitionBy("user_id")
    typed = by_type(rows)
    return typed.select(
        "user_id", "workout_type", "workouts", "minutes",
        half_up(ratio(F.col("workouts"), F.sum("workouts").over(w)) * 100, 1).alias("session_pct"),
        half_up(ratio(F.col("minutes"), F.sum("minutes").over(w)) * 100, 1).alias("time_pct"))


def top_workouts(rows: DataFrame, by: str = "duration_minutes", k: int = 5) -> DataFrame:
    """The k longest (or most intense, by `calories_burned`) workouts of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last(by), F.desc("started_at"), F.desc("seq"))
    return (rows.filter(F.col(by).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("user_id", F.col("rank").cast("bigint").alias("rank"), "started_at", "workout_type",
                    "duration_minutes", "calories_burned"))


def per_period(rows: DataFrame, period: str) -> DataFrame:
    return rows.groupBy("user_id", F.to_date(F.date_trunc(period, "date")).alias(period)).agg(
        F.count("*").alias("sessions"), half_up(F.sum("duration_minutes") / 60, 2).alias("hours"))


def weekly_volume(rows: DataFrame) -> DataFrame:
    """Sessions and hours per ISO week, with each user's highest and lowest week marked."""
    weekly = per_period(rows, "week")
    high = Window.partitionBy("user_id").orderBy(F.desc("hours"), F.asc("week"))
    low = Window.partitionBy("user_id").orderBy(F.asc("hours"), F.asc("week"))
    return (weekly.withColumn("is_highest", F.row_number().over(high) == 1)
            .withColumn("is_lowest", F.row_number().over(low) == 1))


def monthly_change(rows: DataFrame) -> DataFrame:
    """Monthly volume beside the previous calendar month's."""
    w = Window.partitionBy("user_id").orderBy("month")
    adjacent = F.lag("month").over(w) == F.add_months("month", -1)
    return (per_period(rows, "month")
            .withColumn("prev_sessions", F.when(adjacent, F.lag("sessions").over(w)))
            .withColumn("prev_hours", F.when(adjacent, F.lag("hours").over(w)))
            .withColumn("sessions_pct", half_up((ratio(F.col("sessions"), F.col("prev_sessions")) - 1) * 100, 1))
            .withColumn("hours_pct", half_up((ratio(F.col("hours"), F.col("prev_hours")) - 1) * 100, 1)))


def streaks(rows: DataFrame, min_days: int = 5) -> DataFrame:
    """Runs of consecutive days with at least one workout."""
    return runs(rows.select("user_id", "date").distinct(), ["user_id"], min_days)


def workout_names(spark: SparkSession) -> DataFrame:
    """raw_name -> display_name for every known activity."""
    rows = [{"raw_name": WORKOUT_NAME_PREFIX + n, "display_name": n} for n in WORKOUT_NAMES]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def with_display_name(rows: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Adds ``display_name``; a name outside the fixed list shows as 'Unknown'."""
    names = workout_names(rows.sparkSession).withColumnRenamed("raw_name", raw)
    return rows.join(F.broadcast(names), raw, "left").withColumn(
        "display_name", F.coalesce("display_name", F.lit("Unknown")))


def recent_workouts(samples: DataFrame, limit: int | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    return first_per(workouts(samples, tz), ["user_id"], [F.desc("started_at"), F.desc("seq")], limit)
