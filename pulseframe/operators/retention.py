"""Moving old raw quantities into the summary tier."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import is_summarisable, metric_kind
from ..functions.time import before_day, days_before, local_day
from ..schema import DEFAULT_TZ, RAW_DAYS
from ..sources import tables
from .daily import daily_summary, merge_summaries


class Retention(NamedTuple):
    samples: DataFrame    # what stays raw
    summaries: DataFrame  # old summaries with the newly summarised days
    report: DataFrame     # raw_count and summary_days per user and metric


def retain(samples: DataFrame, summaries: DataFrame | None, as_of, raw_days: int = RAW_DAYS,
           tz: str = DEFAULT_TZ) -> Retention:
    """Plan one retention run for every user and quantity at once.

    The cut is the start of a local day, so no day is split between the tiers.
    """
    cut = days_before(as_of, raw_days)
    old = before_day("started_at", cut, tz) & is_summarisable()
    new = daily_summary(samples.filter(old), tz)
    merged = new if summaries is None else merge_summaries(summaries, new)
    report = (samples.filter(old)
              .groupBy("user_id", "metric_type", local_day("started_at", tz).alias("date"))
              .agg(F.count("*").alias("rows"), F.count("value").alias("valued"))
              .groupBy("user_id", "metric_type")
              .agg(F.sum("rows").alias("raw_count"),
                   F.count(F.when(F.col("valued") > 0, 1)).alias("summary_days")))
    return Retention(samples.filter(~old), merged, report)


def dry_run(samples: DataFrame, as_of, raw_days: int = RAW_DAYS, tz: str = DEFAULT_TZ) -> DataFrame:
    """Every metric with samples before the cut: how many rows, and whether they would move."""
    cut = days_before(as_of, raw_days)
    return (samples.filter(before_day("started_at", cut, tz))
            .groupBy("metric_type").agg(F.count("*").alias("raw_rows"))
            .withColumn("kind", metric_kind())
            .withColumn("action", F.when(is_summarisable(), "summarise").otherwise("keep raw")))


def run_retention(spark: SparkSession, root: str, as_of, raw_days: int = RAW_DAYS, tz: str = DEFAULT_TZ,
                  drop: bool = False) -> DataFrame:
    """Apply retention to the published tables: one new version with the summaries of the
    days between the last cut and the new one, and the new cut.  `drop` also takes the
    expired raw months out of the store; `tables.vacuum` then deletes them.

    Returns the report of the run, stored under ``reports``.
    """
    samples, _ = tables.open_tiers(spark, root)
    plan = retain(samples, None, as_of, raw_days, tz)
    path = f"{root}/reports/as_of={as_of}"
    plan.report.write.mode("overwrite").parquet(path)
    report = spark.read.schema(plan.report.schema).parquet(path)
    cut = days_before(as_of, raw_days)
    expired = daily_summary(samples.filter(before_day("started_at", cut, tz)), tz, exact=True)
    tables.publish_cut(spark, root, expired, cut, tz)
    if drop:
        tables.drop_expired(spark, root)
    return report
