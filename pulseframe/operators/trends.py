"""Windows over daily points.  A series has one row per day, so each window
partition is bounded by the report window, not by how many samples a user has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import half_up, ratio
from .stats import SERIES, weighted_mean, with_kind_value


def _newest_first() -> Column:
    return F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date")))


def direction(delta: Column, tolerance: float = 0.0) -> Column:
    return (F.when(delta > tolerance, "improving").when(delta < -tolerance, "declining")
            .when(delta.isNotNull(), "stable"))


def week_over_week(points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Last 7 days with data against the 7 before; NULL trend below 14 days."""
    day = half_up("avg_value", 1)
    ranked = points.filter(F.col("avg_value").isNotNull()).withColumn("d", day).withColumn(
        "rn", _newest_first())
    last, prior = F.when(F.col("rn") <= 7, F.col("d")), F.when(F.col("rn").between(8, 14), F.col("d"))
    out = ranked.groupBy(*SERIES).agg(
        F.count("*").alias("days_with_data"), weighted_mean().alias("avg"),
        F.max(F.when(F.col("rn") == 1, F.col("d"))).alias("latest"),
        half_up(F.avg(last) - F.avg(prior), 1).alias("_delta"))
    return (out.withColumn("delta", F.when(F.col("days_with_data") >= 14, F.col("_delta")))
            .withColumn("direction", direction(F.col("delta"), tolerance)).drop("_delta"))


def rolling_mean(points: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last `days` calendar days beside the mean of the whole window."""
    by_day = with_kind_value(points).withColumn("_n", F.unix_date("date"))
    w = Window.partitionBy(*SERIES).orderBy("_n").rangeBetween(-(days - 1), 0)
    everything = Window.partitionBy(*SERIES)
    roll, base = F.avg("value").over(w), F.avg("value").over(everything)
    return by_day.select(*SERIES, "date", half_up("value", 2).alias("value"),
                         half_up(roll, 2).alias("rolling_avg"), half_up(base, 2).alias("baseline"),
                         half_up(roll - base, 2).alias("deviation"))


def baseline_status(points: DataFrame) -> DataFrame:
    """Latest day against the series' own mean and deviation: green, yellow or red."""
    ranked = with_kind_value(points).withColumn("rn", _newest_first())
    out = ranked.groupBy(*SERIES).agg(
        F.max("date").alias("date"), F.max(F.when(F.col("rn") == 1, half_up("value", 2))).alias("latest"),
        half_up(F.avg("value"), 2).alias("mean"), half_up(F.stddev_pop("value"), 2).alias("std_dev"))
    floor = half_up(F.col("mean") - F.col("std_dev"), 2)
    return out.withColumn("status", F.when(F.col("latest") >= F.col("mean"), "green")
                          .when(F.col("latest") >= floor, "yellow").otherwise("red"))


def drops(points: DataFrame, share: float = 0.2) -> DataFrame:
    """Days more than `share` below the series' own mean."""
    valued = with_kind_value(points)
    mean = half_up(F.avg("value").over(Window.partitionBy(*SERIES)), 4)
    limit = half_up(F.col("mean") * (1 - share), 4)
    return (valued.withColumn("mean", mean).filter(F.col("value") < limit)
            .select(*SERIES, "date", half_up("value", 2).alias("value"), half_up("mean", 2).alias("mean"),
                    half_up((ratio(F.col("value"), F.col("mean")) - 1) * 100, 1).alias("pct_from_mean")))


def islands(days: DataFrame, keys, day: str = "date") -> DataFrame:
    """Adds ``_island``: equal for days of one unbroken run of calendar days."""
    w = Window.partitionBy(*keys).orderBy(day)
    return days.withColumn("_island", F.date_sub(F.col(day), F.row_number().over(w)))


def runs(days: DataFrame, keys, min_days: int, day: str = "date") -> DataFrame:
    """Unbroken runs of at least `min_days` days; `days` has one row per key and day."""
    return (islands(days, keys, day).groupBy(*keys, "_island")
            .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))
            .filter(F.col("days") >= min_days).drop("_island"))


def declining_runs(points: DataFrame, min_days: int = 3) -> DataFrame:
    """Runs of days, each lower than the day with data before it."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    steps = points.withColumn("_falls", F.coalesce(F.col("avg_value") < F.lag("avg_value").over(w), F.lit(False)))
    marked = steps.withColumn("_run", F.sum((~F.col("_falls")).cast("int")).over(w))
    return (marked.filter("_falls").groupBy(*SERIES, "_run")
            .agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                 F.count("*").alias("days"), F.min("avg_value").alias("lowest"))
            .filter(F.col("days") >= min_days).drop("_run"))


def season_compare(points: DataFrame) -> DataFrame:
    """Summer (June to August) against winter (December to February)."""
    month = F.month("date")
    v = F.col("value")
    summer, winter = F.when(month.isin(6, 7, 8), v), F.when(month.isin(12, 1, 2), v)
    out = with_kind_value(points).filter(month.isin(12, 1, 2, 6, 7, 8)).groupBy(*SERIES).agg(
        F.count(summer).alias("summer_days"), half_up(F.avg(summer), 2).alias("summer_avg"),
        F.count(winter).alias("winter_days"), half_up(F.avg(winter), 2).alias("winter_avg"))
    return out.withColumn("delta", half_up(F.col("summer_avg") - F.col("winter_avg"), 2))


def year_over_year(points: DataFrame) -> DataFrame:
    """Yearly mean beside the previous calendar year's."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    yearly = with_kind_value(points).groupBy(*SERIES, F.year("date").alias("year")).agg(
        half_up(F.avg("value"), 2).alias("avg"), F.count("*").alias("days_with_data"))
    prev = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("avg").over(w))
    return (yearly.withColumn("prev_avg", prev)
            .withColumn("delta", half_up(F.col("avg") - F.col("prev_avg"), 2))
            .withColumn("pct_change", half_up(ratio(F.col("delta"), F.col("prev_avg")) * 100, 1)))


def weekday_pattern(points: DataFrame) -> DataFrame:
    """Mean by day of the week (1 = Monday)."""
    return with_kind_value(points).groupBy(*SERIES, (F.weekday("date") + 1).cast("bigint").alias("weekday")).agg(
        half_up(F.avg("value"), 2).alias("avg"), F.count("*").alias("days"))
