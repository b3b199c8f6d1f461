"""Sleep segments, nights, sessions and stage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.metrics import stage_name
from ..functions.numbers import half_up, ratio
from ..functions.time import local_minute, minutes_between, night_date
from ..schema import ASLEEP_CORE, ASLEEP_DEEP, ASLEEP_REM, ASLEEP_STAGES, DEFAULT_TZ, SLEEP
from .scans import for_metrics, source_matches
from .stats import correlation

DEFAULT_SOURCE = "Oura"
SESSION_GAP_MINUTES = 30


def segments(samples: DataFrame, source: str | None = DEFAULT_SOURCE, tz: str = DEFAULT_TZ) -> DataFrame:
    """Finished asleep segments (core, deep, REM) of one source, with their night."""
    df = for_metrics(samples, SLEEP).filter(F.col("value").isin(*ASLEEP_STAGES) & F.col("ended_at").isNotNull())
    if source:
        df = df.filter(source_matches(source))
    return df.select("user_id", night_date("started_at", tz).alias("night_date"),
                     F.lower(stage_name("value")).alias("stage"), "value", "source_device",
                     "started_at", "ended_at", minutes_between("started_at", "ended_at").alias("minutes"))


def _totals():
    m = F.col("minutes")
    stage = F.col("value")
    return [F.sum(F.when(stage == ASLEEP_CORE, m).otherwise(0.0)).alias("core"),
            F.sum(F.when(stage == ASLEEP_DEEP, m).otherwise(0.0)).alias("deep"),
            F.sum(F.when(stage == ASLEEP_REM, m).otherwise(0.0)).alias("rem"),
            F.sum(m).alias("total"), F.count("*").alias("segment_count"),
            F.min("started_at").alias("bedtime")]


def _present(nights: DataFrame) -> DataFrame:
    return nights.select(
        "user_id", "night_date", half_up("core", 1).alias("core_minutes"),
        half_up("deep", 1).alias("deep_minutes"), half_up("rem", 1).alias("rem_minutes"),
        half_up("total", 1).alias("total_minutes"), half_up(F.col("total") / 60, 2).alias("sleep_hours"),
        "segment_count", "bedtime")


def nights(segs: DataFrame) -> DataFrame:
    """Stage minutes per user and night; exact minutes are summed, then rounded."""
    return _present(segs.groupBy("user_id", "night_date").agg(*_totals()))


def nights_by_priority(samples: DataFrame, sources: list[str], tz: str = DEFAULT_TZ) -> DataFrame:
    """Nights from the first source in `sources` that recorded that night."""
    rank = None
    for i, s in enumerate(sources):
        rank = F.when(source_matches(s), i) if rank is None else rank.when(source_matches(s), i)
    segs = segments(samples, None, tz).withColumn("rank", rank).filter(F.col("rank").isNotNull())
    per_source = segs.groupBy("user_id", "night_date", "rank").agg(*_totals())
    cols = ("core", "deep", "rem", "total", "segment_count", "bedtime")
    return _present(per_source.groupBy("user_id", "night_date").agg(
        F.min_by(F.struct(*cols), F.col("rank")).alias("n")).select("user_id", "night_date", "n.*"))


def as_points(nightly: DataFrame) -> DataFrame:
    """Nights as daily points of the sleep metric, in minutes asleep.

    The mean of sleep codes has no meaning; minutes asleep is what thresholds,
    baselines and comparisons of sleep are about.
    """
    m = F.col("total_minutes")
    return nightly.select(
        "user_id", F.lit(SLEEP).alias("metric_type"), F.col("night_date").alias("date"), m.alias("avg_value"),
        m.alias("min_value"), m.alias("max_value"), m.alias("sum_value"), F.lit(1).cast("bigint").alias("sample_count"),
        F.lit("min").alias("unit"), F.lit("raw").alias("source"))


def summary(nightly: DataFrame) -> DataFrame:
    """Nights with sleep and their mean hours, per user."""
    return nightly.groupBy("user_id").agg(
        F.count("*").alias("nights"),
        half_up(F.avg(F.when(F.col("total_minutes") > 0, F.col("total_minutes") / 60)), 1).alias("avg_sleep_hours"))


def stage_rows(samples: DataFrame) -> DataFrame:
    """Sleep rows that name a stage, with duration and short stage name."""
    df = for_metrics(samples, SLEEP).filter(F.col("value").isin(2.0, 3.0, 4.0, 5.0))
    return df.select("user_id", "started_at", "ended_at", "value",
                     half_up(minutes_between("started_at", "ended_at"), 1).alias("duration_min"),
                     stage_name("value").alias("stage"))


def stage_share(nightly: DataFrame, period: str = "month") -> DataFrame:
    """Share of core, deep and REM per user and period, and REM's change from the period before."""
    per = nightly.groupBy("user_id", F.to_date(F.date_trunc(period, "night_date")).alias("period")).agg(
        *[F.sum(f"{s}_minutes").alias(s) for s in ("core", "deep", "rem", "total")], F.count("*").alias("nights"))
    out = per.select("user_id", "period", "nights", *[
        half_up(ratio(F.col(s), F.col("total")) * 100, 1).alias(f"{s}_pct") for s in ("core", "deep", "rem")])
    w = Window.partitionBy("user_id").orderBy("period")
    return out.withColumn("rem_pct_change", half_up(F.col("rem_pct") - F.lag("rem_pct").over(w), 1))


def best_worst_night(nightly: DataFrame) -> DataFrame:
    """Per user and week: the night with most deep + REM and the one with least sleep."""
    good = F.col("deep_minutes") + F.col("rem_minutes")
    day = F.unix_date("night_date")
    per = nightly.withColumn("restorative", half_up(good, 1)).groupBy(
        "user_id", F.to_date(F.date_trunc("week", "night_date")).alias("week"))
    return per.agg(
        F.count("*").alias("nights"),
        F.max_by("night_date", F.struct(F.col("restorative"), -day)).alias("best_night"),
        F.max("restorative").alias("best_deep_rem_minutes"),
        F.min_by("night_date", F.struct(F.col("total_minutes"), day)).alias("worst_night"),
        F.min("total_minutes").alias("worst_total_minutes"))


def bedtime_effect(nightly: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Per user: mean bedtime (minutes after 18:00 local) and its correlation with deep sleep."""
    late = (local_minute("bedtime", tz) + 360) % 1440  # 18:00 -> 0, midnight -> 360, noon -> 1080
    x, y = late.cast("double"), F.col("deep_minutes")
    return nightly.groupBy("user_id").agg(
        F.count("*").alias("nights"), half_up(F.avg(x), 1).alias("avg_bedtime_min_after_18h"),
        correlation(x, y).alias("bedtime_deep_corr"))


def sessions(samples: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sleep sessions: finished segments closer than the gap are one session.

    Segments that start within one slot no wider than the gap always share a
    session, so they are first combined per slot.  A day has a fixed number of
    slots, which bounds the per-user window that follows.
    """
    gap_us = gap_minutes * 60 * 1_000_000
    df = for_metrics(samples, SLEEP).filter(F.col("ended_at").isNotNull())
    a, b = F.unix_micros("started_at"), F.unix_micros("ended_at")
    slots = df.groupBy("user_id", F.floor(a / gap_us).alias("slot")).agg(
        F.min(a).alias("a"), F.max(b).alias("b"), F.count("*").alias("segments"))
    w = Window.partitionBy("user_id").orderBy("a")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("a") - reach >= gap_us, F.lit(True))
    numbered = slots.withColumn("opens", opens.cast("int")).withColumn("n", F.sum("opens").over(w))
    return numbered.groupBy("user_id", "n").agg(
        F.timestamp_micros(F.min("a")).alias("session_start"), F.timestamp_micros(F.max("b")).alias("session_end"),
        F.sum("segments").alias("segments"), half_up((F.max("b") - F.min("a")) / F.lit(60_000_000.0), 1).alias("minutes")
    ).drop("n")
