"""Cross-metric analyses: sleep, training and heart metrics on a common calendar.

Inputs are daily points and nights, which have one row per user and day, so
the joins on (user, day) neither multiply rows nor meet a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.numbers import half_up
from ..functions.time import as_date, days_before, local_day, local_midnight
from ..operators.scans import for_metrics
from ..operators.trends import islands
from ..operators.stats import correlation

LOAD_SLOT_MINUTES = 15  # every time zone's midnight falls on a quarter hour


def day_values(points: DataFrame, metric: str, name: str) -> DataFrame:
    return for_metrics(points, metric).select("user_id", "date", F.col("avg_value").alias(name))


def side_by_side(points: DataFrame, **metrics: str) -> DataFrame:
    """One row per user and day with a column per named metric, NULL where it has no
    data: ``side_by_side(points, hrv=HRV, rhr=RESTING_HR)``.  One aggregation, no joins."""
    wanted = for_metrics(points, *metrics.values())
    return wanted.groupBy("user_id", "date").agg(*[
        F.max(F.when(F.col("metric_type") == m, F.col("avg_value"))).alias(name) for name, m in metrics.items()])


def morning_after(nights: DataFrame, hrv: DataFrame) -> DataFrame:
    """Nights joined to the HRV of the following day."""
    following = nights.withColumn("date", F.date_add("night_date", 1))
    return following.join(hrv, ["user_id", "date"])


def low_hrv_prior_sleep(hrv: DataFrame, nights: DataFrame, below: float) -> DataFrame:
    """Low-HRV days with the sleep of the night before, if it was recorded."""
    low = hrv.filter(F.col("hrv") < below)
    prior = nights.select("user_id", F.date_add("night_date", 1).alias("date"), "sleep_hours", "deep_minutes")
    return low.join(prior, ["user_id", "date"], "left")


def deep_band_next_hrv(nights: DataFrame, hrv: DataFrame) -> DataFrame:
    """Mean next-morning HRV by band of deep sleep."""
    deep = F.col("deep_minutes")
    band = F.when(deep < 45, "under 45").when(deep < 60, "45 to 60").otherwise("60 and over")
    return morning_after(nights, hrv).groupBy("user_id", band.alias("deep_band")).agg(
        F.count("*").alias("nights"), half_up(F.avg("hrv"), 1).alias("avg_next_hrv"))


def sleep_hrv_correlation(nights: DataFrame, hrv: DataFrame) -> DataFrame:
    """Correlation of deep and of total sleep with next-morning HRV."""
    return morning_after(nights, hrv).groupBy("user_id").agg(
        F.count("*").alias("pairs"), correlation(F.col("deep_minutes"), F.col("hrv")).alias("deep_corr"),
        correlation(F.col("total_minutes"), F.col("hrv")).alias("total_corr"))


def load_before_low_hrv(hrv: DataFrame, workouts: DataFrame, below: float, hours: int = 48,
                        tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Training in the `hours` before the start of each low-HRV day.

    An interval join on day keys: workouts are first summed per quarter hour,
    each low day names the few local days its interval touches, and the exact
    interval is checked after the equi-join.
    """
    slot_s = LOAD_SLOT_MINUTES * 60
    slots = workouts.groupBy("user_id", (F.floor(F.unix_seconds("started_at") / slot_s) * slot_s).alias("slot")).agg(
        F.count("*").alias("n"), F.sum("duration_minutes").alias("m"))
    slots = slots.withColumn("near", local_day(F.timestamp_seconds("slot"), tz))
    low = hrv.filter(F.col("hrv") < below).withColumn("until", F.unix_seconds(local_midnight("date", tz)))
    reach = -(-hours // 24) + 1
    near = low.withColumn("near", F.explode(F.sequence(F.date_sub("date", reach), F.col("date"))))
    s = F.col("slot")
    hits = near.join(slots, ["user_id", "near"]).filter((s < F.col("until")) & (s >= F.col("until") - hours * 3600))
    load = hits.groupBy("user_id", "date").agg(
        F.sum("n").alias("sessions"), half_up(F.sum("m"), 1).alias("minutes"))
    return low.select("user_id", "date", "hrv").join(load, ["user_id", "date"], "left").select(
        "user_id", "date", "hrv", F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def _weekly_mean(hrv: DataFrame) -> DataFrame:
    return hrv.groupBy("user_id", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        half_up(F.avg("hrv"), 1).alias("hrv"))


def heavy_week_next_hrv(workouts: DataFrame, hrv: DataFrame, min_sessions: int = 6) -> DataFrame:
    """Weeks with many sessions beside that week's and the next week's mean HRV."""
    week = F.to_date(F.date_trunc("week", "date")).alias("week")
    heavy = workouts.groupBy("user_id", week).agg(F.count("*").alias("sessions")).filter(
        F.col("sessions") >= min_sessions)
    weekly = _weekly_mean(hrv)
    same = weekly.withColumnRenamed("hrv", "week_hrv")
    following = weekly.select("user_id", F.date_sub("week", 7).alias("week"), F.col("hrv").alias("next_week_hrv"))
    return (heavy.join(same, ["user_id", "week"], "left").join(following, ["user_id", "week"], "left")
            .withColumn("change", half_up(F.col("next_week_hrv") - F.col("week_hrv"), 1)))


def suppression_runs(points: DataFrame, min_days: int = 2) -> DataFrame:
    """Runs of consecutive days with HRV under and resting heart rate over the user's mean."""
    user = Window.partitionBy("user_id")
    both = side_by_side(points, hrv=S.HRV, rhr=S.RESTING_HR).dropna()
    marked = both.withColumn("hrv_mean", half_up(F.avg("hrv").over(user), 4)).withColumn(
        "rhr_mean", half_up(F.avg("rhr").over(user), 4))
    bad = marked.filter((F.col("hrv") < F.col("hrv_mean")) & (F.col("rhr") > F.col("rhr_mean")))
    return (islands(bad, ["user_id"]).groupBy("user_id", "_island").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("days"),
        half_up(F.avg("hrv"), 1).alias("avg_hrv"), half_up(F.avg("rhr"), 1).alias("avg_rhr"))
        .filter(F.col("days") >= min_days).drop("_island"))


def recovery_score(points: DataFrame, nights: DataFrame, as_of, baseline_days: int = 90) -> DataFrame:
    """0-100 score per user and day from HRV, resting heart rate and last night's sleep,
    against the user's own percentiles.  The ladder values are fixed."""
    as_of = as_date(as_of)
    window = points.filter(F.col("date").between(F.lit(days_before(as_of, baseline_days)), F.lit(as_of)))
    days = side_by_side(window, hrv=S.HRV, rhr=S.RESTING_HR)
    quartiles = F.array(F.lit(0.25), F.lit(0.50), F.lit(0.75))
    base = days.groupBy("user_id").agg(F.percentile("hrv", quartiles).alias("h"), F.percentile("rhr", quartiles).alias("r"))
    base = base.select("user_id", *[half_up(F.col(c)[i], 2).alias(f"{c}{q}") for c in "hr" for i, q in enumerate((25, 50, 75))])
    slept = nights.select("user_id", F.date_add("night_date", 1).alias("date"), "sleep_hours")
    scored = days.dropna().join(slept, ["user_id", "date"]).join(base, "user_id")
    hrv, rhr, h = F.col("hrv"), F.col("rhr"), F.col("sleep_hours")
    hrv_points = (F.when(hrv > F.col("h75"), 40).when(hrv >= F.col("h50"), 30).when(hrv >= F.col("h25"), 20)
                  .otherwise(10))
    rhr_points = (F.when(rhr <= F.col("r25"), 30).when(rhr <= F.col("r50"), 20).when(rhr <= F.col("r75"), 10)
                  .otherwise(5))
    sleep_points = F.when(h >= 7.5, 30).when(h >= 6.5, 20).when(h >= 6, 10).otherwise(5)
    return scored.select("user_id", "date", "hrv", "rhr", "sleep_hours",
                         hrv_points.cast("bigint").alias("hrv_points"), rhr_points.cast("bigint").alias("rhr_points"),
                         sleep_points.cast("bigint").alias("sleep_points"),
                         (hrv_points + rhr_points + sleep_points).cast("bigint").alias("score"))


def device_difference(samples: DataFrame, metric: str, a: str = "Apple Watch", b: str = "Oura",
                      tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Days on which two device families recorded a metric, and how far apart they were."""
    def mean(name):
        return F.avg(F.when(F.col("source_device").ilike(f"%{name}%"), F.col("value")))

    out = for_metrics(samples, metric).groupBy("user_id", local_day("started_at", tz).alias("date")).agg(
        half_up(mean(a), 2).alias("avg_a"), half_up(mean(b), 2).alias("avg_b"))
    return out.filter(F.col("avg_a").isNotNull() & F.col("avg_b").isNotNull()).withColumn(
        "difference", half_up(F.col("avg_a") - F.col("avg_b"), 2))


def illness_flag(points: DataFrame) -> DataFrame:
    """Days with oxygen saturation, respiratory rate and HRV, each judged against the
    user's mean and deviation, and what their combination suggests."""
    user = Window.partitionBy("user_id")
    days = side_by_side(points, spo2=S.SPO2, resp=S.RESPIRATORY_RATE, hrv=S.HRV).dropna()

    def edge(c, sign):
        return half_up(F.avg(c).over(user) + sign * F.stddev_pop(c).over(user), 4)

    judged = (days.withColumn("_s", edge("spo2", -1)).withColumn("_r", edge("resp", 1)).withColumn("_h", edge("hrv", -1))
              .withColumn("spo2_low", F.col("spo2") < F.col("_s")).withColumn("resp_high", F.col("resp") > F.col("_r"))
              .withColumn("hrv_low", F.col("hrv") < F.col("_h")))
    s, r, h = F.col("spo2_low"), F.col("resp_high"), F.col("hrv_low")
    flag = (F.when(s & r & h, "possible illness or disturbed sleep").when(r & h, "stress or early illness")
            .when(s & ~r, "altitude or artifact").when(s | r | h, "single signal").otherwise("normal"))
    return judged.select("user_id", "date", "spo2", "resp", "hrv", "spo2_low", "resp_high", "hrv_low", flag.alias("flag"))


def trend_with_load(points: DataFrame, workouts: DataFrame, metric: str, period: str = "month") -> DataFrame:
    """A metric's mean beside the number and hours of workouts, per period."""
    p = F.to_date(F.date_trunc(period, "date")).alias("period")
    level = for_metrics(points, metric).groupBy("user_id", p).agg(half_up(F.avg("avg_value"), 2).alias("avg_value"))
    load = workouts.groupBy("user_id", p).agg(
        F.count("*").alias("sessions"), half_up(F.sum("duration_minutes") / 60, 2).alias("hours"))
    return level.join(load, ["user_id", "period"], "left").select(
        "user_id", "period", "avg_value", F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("hours", F.lit(0.0)).alias("hours"))


def load_correlation(trend: DataFrame) -> DataFrame:
    """Per user: correlation of the metric with the number of sessions over periods."""
    return trend.groupBy("user_id").agg(
        F.count("*").alias("periods"),
        correlation(F.col("avg_value"), F.col("sessions").cast("double")).alias("session_corr"))


def heavy_months_hrv(workouts: DataFrame, hrv: DataFrame, per_week: float = 5.0) -> DataFrame:
    """Months with more than `per_week` sessions a week, and their mean HRV."""
    month = F.trunc("date", "month").alias("month")
    rate = half_up(F.col("sessions") * 7 / F.day(F.last_day("month")), 2)
    heavy = workouts.groupBy("user_id", month).agg(F.count("*").alias("sessions")).withColumn(
        "sessions_per_week", rate).filter(F.col("sessions_per_week") > per_week)
    level = hrv.groupBy("user_id", month).agg(half_up(F.avg("hrv"), 1).alias("avg_hrv"))
    return heavy.join(level, ["user_id", "month"], "left")
