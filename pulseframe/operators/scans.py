"""Reading samples and summaries by user, metric, time and source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metrics import SOURCE_FILTER_PATTERN, is_summarisable, metric_kind
from ..functions.time import (as_date, backfill_chunk, before_day, days_before, in_days, local_day,
                              local_midnight, next_local_midnight)
from ..schema import DEFAULT_TZ


def for_user(df: DataFrame, user_id=None) -> DataFrame:
    """One user's rows, or everyone's."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def for_metrics(df: DataFrame, *metrics: str) -> DataFrame:
    return df.filter(F.col("metric_type").isin(*metrics)) if metrics else df


def source_matches(text: str) -> Column:
    """Case-insensitive substring match on the source device; the text is checked first."""
    if not re.match(SOURCE_FILTER_PATTERN, text):
        raise ValueError("source filter contains invalid characters")
    return F.col("source_device").ilike(f"%{text}%")


def first_per(df: DataFrame, keys, order, limit: int | None) -> DataFrame:
    """The first `limit` rows of each group.

    Spark cuts each task's input to the group limit before the shuffle, so a
    group with most of the table sends `limit` rows per task, not all of them.
    """
    if limit is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def newest(rows: DataFrame, limit: int | None) -> DataFrame:
    """The newest `limit` rows of each user."""
    return first_per(rows, ["user_id"], [F.desc("started_at"), F.desc("seq")], limit)


def recent(samples: DataFrame, metric: str, as_of, days: int, limit: int | None = None,
           source: str | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """Samples of one metric in the last `days` local days, newest `limit` per user."""
    as_of = as_date(as_of)
    df = for_metrics(samples, metric).filter(in_days("started_at", days_before(as_of, days), as_of, tz))
    if source:
        df = df.filter(source_matches(source))
    return newest(df, limit)


def in_range(samples: DataFrame, metric: str, start, end, tz: str = DEFAULT_TZ) -> DataFrame:
    """Samples of one metric from the start of one local day to the start of another."""
    return for_metrics(samples, metric).filter(
        ~before_day("started_at", start, tz) & before_day("started_at", end, tz))


def on_day(samples: DataFrame, day, limit: int | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """Everything recorded on one local day, optionally the first `limit` rows per user."""
    df = samples.filter(in_days("started_at", day, day, tz))
    return first_per(df, ["user_id"], ["metric_type", "started_at", "seq"], limit)


def summaries_since(summaries: DataFrame, metric: str, since, limit: int | None = None) -> DataFrame:
    df = for_metrics(summaries, metric).filter(F.col("date") >= F.lit(as_date(since)))
    return first_per(df, ["user_id"], [F.desc("date")], limit)


def summaries_between(summaries: DataFrame, start, end) -> DataFrame:
    return summaries.filter(F.col("date").between(F.lit(as_date(start)), F.lit(as_date(end))))


def types_before(samples: DataFrame, cutoff, tz: str = DEFAULT_TZ) -> DataFrame:
    """Metrics that still have samples before a local day, and whether they may be summarised."""
    return (samples.filter(before_day("started_at", cutoff, tz)).select("metric_type").distinct()
            .withColumn("summarisable", is_summarisable()))


def kind_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("metric_type").agg(F.count("*").alias("n")).groupBy(
        metric_kind().alias("kind")).agg(
        F.sum("n").alias("samples"), F.count("*").alias("metric_types"))


def backfill_plan(samples: DataFrame) -> DataFrame:
    """Rows per metric and 90-day history chunk: the units a backfill loads one by one."""
    return samples.groupBy("metric_type", backfill_chunk("started_at").alias("chunk")).agg(
        F.count("*").alias("samples"), F.min("started_at").alias("first_at"),
        F.max("started_at").alias("last_at"))


def local_days(samples: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Samples per user and local day."""
    return samples.groupBy("user_id", local_day("started_at", tz).alias("date")).agg(
        F.count("*").alias("samples"))


def day_bounds(samples: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """First and last instant, and length in hours, of every local day with data."""
    days = samples.select(local_day("started_at", tz).alias("date")).distinct()
    lo, hi = local_midnight("date", tz), next_local_midnight("date", tz)
    return days.select("date", lo.alias("starts_at"), hi.alias("ends_at"),
                       ((F.unix_seconds(hi) - F.unix_seconds(lo)) / F.lit(3600.0)).alias("hours"))


