"""Daily points: from raw samples, from summaries, and from both tiers at once.

A daily point is one row per user, metric and local day with
``avg_value, min_value, max_value, sum_value, sample_count, unit, source``.
Raw samples are reduced to points in one aggregation whose map side already
combines, so everything after it handles days, not samples, however heavy a
single user or metric is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.metrics import is_summarisable
from ..functions.numbers import half_up, ratio
from ..functions.time import as_date, days_before, in_days, local_day
from ..schema import DAY_KEY, DEFAULT_TZ
from .scans import summaries_between

POINT_VALUES = ("avg_value", "min_value", "max_value", "sum_value", "sample_count", "unit")


def daily_from_raw(samples: DataFrame, tz: str = DEFAULT_TZ, exact: bool = False) -> DataFrame:
    """Daily points of raw samples; NULL values are left out.

    `exact` adds ``_total``, the sum before rounding, and keeps days that have NULL values only, with no samples.

    The unit is a grouping key first, so that all buffers are numbers and the raw
    rows are aggregated by hash; a day's few units are folded afterwards.
    """
    by_unit = ((samples if exact else samples.filter(F.col("value").isNotNull()))
               .groupBy("user_id", "metric_type", local_day("started_at", tz).alias("date"), "unit")
               .agg(F.sum("value").alias("_sum"), F.min("value").alias("_min"), F.max("value").alias("_max"),
                    F.count("value").alias("_n")))
    return by_unit.groupBy(*DAY_KEY).agg(
        half_up(F.sum("_sum") / F.sum("_n"), 4).alias("avg_value"), F.min("_min").alias("min_value"),
        F.max("_max").alias("max_value"), half_up(F.sum("_sum"), 4).alias("sum_value"),
        F.sum("_n").alias("sample_count"), F.max("unit").alias("unit"),
        *([F.sum("_sum").alias("_total")] if exact else [])).withColumn("source", F.lit("raw"))


def daily_summary(samples: DataFrame, tz: str = DEFAULT_TZ, exact: bool = False) -> DataFrame:
    """What the summary tier stores: daily points of the quantities."""
    return daily_from_raw(samples.filter(is_summarisable()), tz, exact).drop("source")


def combine_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per key; rows of the same day are combined, never replaced."""
    n, total = F.sum("sample_count"), F.sum("sum_value")
    return summaries.groupBy(*DAY_KEY).agg(
        # a day with a single row keeps its stored average
        F.when(F.count("*") == 1, F.max("avg_value")).otherwise(half_up(ratio(total, n), 4)).alias("avg_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        half_up(total, 4).alias("sum_value"), n.alias("sample_count"), F.max("unit").alias("unit"))


def merge_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    return combine_summaries(old.unionByName(new))


def _from_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.select(*DAY_KEY, *POINT_VALUES).withColumn("source", F.lit("summary"))


def _raw_first(points: DataFrame) -> DataFrame:
    """One point per day where both tiers may have one: the raw one."""
    raw = F.col("source") == "raw"

    def pick(name):
        return F.when(F.max(raw), F.max(F.when(raw, F.col(name)))).otherwise(F.max(F.when(~raw, F.col(name)))).alias(name)

    return points.groupBy(*DAY_KEY).agg(
        *[pick(c) for c in POINT_VALUES], F.when(F.max(raw), "raw").otherwise("summary").alias("source"))


def tiered_daily(samples: DataFrame, summaries: DataFrame | None, as_of, days: int, raw_from=None,
                 tz: str = DEFAULT_TZ) -> DataFrame:
    """Daily points of the last `days` days.

    `raw_from` is the first local day that counts as raw, the cut of the store's last
    retention run; summaries count before it.  Without a cut all raw samples count, and
    summaries only on days without any.
    """
    as_of = as_date(as_of)
    start = days_before(as_of, days)
    if raw_from is None:
        return series_range(samples, summaries, start, as_of, None, tz)
    cut = as_date(raw_from)
    points = daily_from_raw(samples.filter(in_days("started_at", max(start, cut), as_of, tz)), tz)
    if summaries is None or start >= cut:
        return points
    old = summaries_between(summaries, start, min(as_of, cut - dt.timedelta(days=1)))
    return points.unionByName(_from_summaries(old))


def series_range(samples: DataFrame, summaries: DataFrame | None, start, end, raw_from=None,
                 tz: str = DEFAULT_TZ) -> DataFrame:
    """Daily points of the closed range [start, end], one pass over each tier.

    Where both tiers have a day, which with a cut can only be the cut itself, the raw
    samples win.  Raw samples from before the cut do not count.
    """
    start, end = as_date(start), as_date(end)
    first = start if raw_from is None else max(start, as_date(raw_from))
    inside = in_days("started_at", first, end, tz) if first <= end else F.lit(False)
    points = daily_from_raw(samples.filter(inside), tz)
    last = end if raw_from is None else min(end, as_date(raw_from))
    if summaries is None or last < start:
        return points
    old = _from_summaries(summaries_between(summaries, start, last))
    return old if first > end else _raw_first(points.unionByName(old))


def daily_quantity_view(samples: DataFrame, summaries: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Quantities of both tiers side by side, one row per stored day and tier."""
    return (_from_summaries(summaries)
            .unionByName(daily_from_raw(samples.filter(is_summarisable()), tz))
            .withColumnRenamed("date", "day"))
