"""Statistics over daily points, for all users and metrics in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import is_cumulative, value_type
from ..functions.numbers import half_up, ratio
from ..functions.time import check_range
from .scans import first_per

SERIES = ("user_id", "metric_type")


def weighted_mean(digits: int = 2, where: Column | None = None) -> Column:
    """Aggregate: mean over all samples behind the points."""
    total, n = F.col("sum_value"), F.col("sample_count")
    if where is not None:
        total, n = F.when(where, total), F.when(where, n)
    return half_up(ratio(F.sum(total), F.sum(n)), digits)


def mean_daily_total(digits: int = 1, where: Column | None = None) -> Column:
    """Aggregate: mean of the daily totals."""
    total = F.col("sum_value") if where is None else F.when(where, F.col("sum_value"))
    return half_up(F.avg(total), digits)


def kind_mean(where: Column | None = None) -> Column:
    """Aggregate: mean daily total of a cumulative metric, weighted mean of any other.
    Needs ``metric_type`` among the grouping keys."""
    return F.when(is_cumulative(), mean_daily_total(1, where)).otherwise(weighted_mean(2, where))


def with_kind_value(points: DataFrame) -> DataFrame:
    """Adds ``value`` (daily total or daily average, by kind) and ``value_type``."""
    return points.withColumn(
        "value", F.when(is_cumulative(), F.col("sum_value")).otherwise(F.col("avg_value"))
    ).withColumn("value_type", value_type())


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of two non-NULL columns, NULL when either does not vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    varies = (half_up(sx, 4) > 0) & (half_up(sy, 4) > 0)
    return F.when(varies, half_up(ratio(F.covar_pop(x, y), sx * sy), 4))


def kind_averages(points: DataFrame) -> DataFrame:
    return points.groupBy(*SERIES).agg(
        kind_mean().alias("avg"), F.count("*").alias("days")).withColumn("value_type", value_type())


def overall(points: DataFrame) -> DataFrame:
    """Number of days, kind-dispatched mean and extremes of each series."""
    return points.groupBy(*SERIES).agg(
        F.count("*").alias("days_with_data"), kind_mean().alias("avg"),
        F.min("min_value").alias("min"), F.max("max_value").alias("max"))


def metric_stats(points: DataFrame) -> DataFrame:
    """Personal baseline: extremes, mean, population deviation, exact percentiles.

    A series holds one value per day, at most a few thousand, so exact
    percentiles stay cheap for every series.
    """
    v = F.col("value")
    cuts = F.percentile(v, F.array(*[F.lit(p) for p in (0.10, 0.25, 0.50, 0.75, 0.90)]))
    out = with_kind_value(points).filter(v.isNotNull()).groupBy(*SERIES).agg(
        F.count("*").alias("data_points"), half_up(F.min(v), 2).alias("min"),
        half_up(F.max(v), 2).alias("max"), half_up(F.avg(v), 2).alias("mean"),
        half_up(F.stddev_pop(v), 2).alias("std_dev"), cuts.alias("_p"))
    named = [half_up(F.col("_p")[i], 2).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    return (out.select(*SERIES, value_type().alias("value_type"), "data_points", "min", "max", "mean",
                       "std_dev", *named)
            .withColumn("good_day_above", F.col("p75")).withColumn("poor_day_below", F.col("p25")))


def approx_metric_stats(points: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """As `metric_stats` for series too long for exact percentiles (sketch-based)."""
    v = F.col("value")
    cuts = F.percentile_approx(v, F.array(*[F.lit(p) for p in (0.10, 0.25, 0.50, 0.75, 0.90)]), accuracy)
    out = with_kind_value(points).filter(v.isNotNull()).groupBy(*SERIES).agg(
        F.count("*").alias("data_points"), half_up(F.avg(v), 2).alias("mean"), cuts.alias("_p"))
    named = [half_up(F.col("_p")[i], 2).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    return out.select(*SERIES, "data_points", "mean", *named)


def _matches(min_value, max_value) -> Column:
    hit = F.col("value").isNotNull()
    if min_value is not None:
        hit = hit & (F.col("value") >= min_value)
    if max_value is not None:
        hit = hit & (F.col("value") <= max_value)
    return hit


def search_records(points: DataFrame, min_value=None, max_value=None, limit: int | None = None,
                   ascending: bool = False) -> DataFrame:
    """Days whose kind value lies within the inclusive bounds, highest first per series."""
    hits = with_kind_value(points).filter(_matches(min_value, max_value)).select(
        *SERIES, "date", half_up("value", 2).alias("value"), "value_type", "source")
    order = F.asc("value") if ascending else F.desc("value")
    return first_per(hits, SERIES, [order, F.asc("date")], limit)


def search_counts(points: DataFrame, min_value=None, max_value=None) -> DataFrame:
    """Days searched and matched per series, before any limit."""
    return with_kind_value(points).groupBy(*SERIES).agg(
        F.count("*").alias("days_searched"),
        F.count(F.when(_matches(min_value, max_value), 1)).alias("days_matched"))


def compare_periods(points: DataFrame, a: tuple, b: tuple, label_a: str = "Period A",
                    label_b: str = "Period B") -> DataFrame:
    """Two date ranges side by side, in one pass over the points.  The ranges may overlap."""
    a, b = check_range(*a), check_range(*b)
    label_a, label_b = str(label_a)[:32], str(label_b)[:32]

    def stats(tag: str, bounds):
        inside = F.col("date").between(F.lit(bounds[0]), F.lit(bounds[1]))
        v = F.when(inside, F.col("value"))
        return [F.count(v).alias(f"{tag}_points"), kind_mean(inside).alias(f"{tag}_avg"),
                half_up(F.min(v), 2).alias(f"{tag}_min"), half_up(F.max(v), 2).alias(f"{tag}_max")]

    wanted = (F.col("date").between(F.lit(a[0]), F.lit(a[1]))
              | F.col("date").between(F.lit(b[0]), F.lit(b[1])))
    out = with_kind_value(points).filter(wanted).groupBy(*SERIES).agg(*stats("a", a), *stats("b", b))
    delta = half_up(F.col("b_avg") - F.col("a_avg"), 2)
    direction = F.when(F.col("delta") > 0, "higher").when(F.col("delta") < 0, "lower").otherwise("the same")
    return (out.withColumn("value_type", value_type()).withColumn("delta", delta)
            .withColumn("pct_change", half_up(ratio(F.col("delta"), F.col("a_avg")) * 100, 1))
            .withColumn("verdict", F.when(F.col("delta").isNull(), "insufficient data").otherwise(
                F.concat(F.lit(f"{label_b} is "), direction, F.lit(f" than {label_a}")))))


def monthly_trend(points: DataFrame) -> DataFrame:
    """Kind-dispatched monthly mean, days with data, and which tiers they came from."""
    return points.groupBy(*SERIES, F.trunc("date", "month").alias("month")).agg(
        kind_mean().alias("avg"), F.count("*").alias("days_with_data"),
        (F.max((F.col("source") == "raw").cast("int")) == 1).alias("has_raw"),
        (F.max((F.col("source") == "summary").cast("int")) == 1).alias("has_summary"))
