"""Metric kinds, identifier guards, sleep stages and workout names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import (CATEGORY_PREFIX, CUMULATIVE_METRICS, QUANTITY_PREFIX, WORKOUT)
from .time import as_col

# --- fixed values ----------------------------------------------------------
METRIC_TYPE_PATTERN = r"^HK[A-Za-z0-9]+TypeIdentifier[A-Za-z0-9]+$"
SOURCE_FILTER_PATTERN = r"^[\w\s\-\.]{1,64}$"
IMPORT_SKIP_PREFIXES = (
    "HKWorkoutTypeIdentifier",
    "HKDataTypeSleepDurationGoal",
    "HKClinical",
)
SLEEP_VALUE_PREFIX = "HKCategoryValueSleepAnalysis"
SLEEP_VALUE_NAMES = ("InBed", "AsleepUnspecified", "Awake", "AsleepCore", "AsleepDeep", "AsleepREM")
WORKOUT_NAME_PREFIX = "HKWorkoutActivityType"
# The workout activity names a device can report.
WORKOUT_NAMES = (
    "AmericanFootball", "Archery", "AustralianFootball", "Badminton", "Baseball", "Basketball",
    "Bowling", "Boxing", "Climbing", "Cricket", "CrossTraining", "Curling", "Cycling", "Dance",
    "Elliptical", "EquestrianSports", "Fencing", "Fishing", "FunctionalStrengthTraining", "Golf",
    "Gymnastics", "Handball", "Hiking", "Hockey", "Hunting", "Lacrosse", "MartialArts",
    "MindAndBody", "MixedCardio", "PaddleSports", "Play", "PreparationAndRecovery", "Racquetball",
    "Rowing", "Rugby", "Running", "Sailing", "SkatingSports", "SnowSports", "Soccer", "Softball",
    "Squash", "StairClimbing", "SurfingSports", "Swimming", "TableTennis", "Tennis",
    "TrackAndField", "TraditionalStrengthTraining", "Volleyball", "Walking", "WaterFitness",
    "WaterPolo", "WaterSports", "Wrestling", "Yoga", "Barre", "CoreTraining",
    "CrossCountrySkiing", "DownhillSkiing", "Flexibility", "HighIntensityIntervalTraining",
    "JumpRope", "Kickboxing", "Pilates", "Snowboarding", "Stairs", "StepTraining",
    "WheelchairWalkPace", "WheelchairRunPace", "TaiChi", "MixedMetabolicCardioTraining",
    "DiscSports", "FitnessGaming", "CardioDance", "SocialDance", "Pickleball", "Cooldown",
    "SwimBikeRun", "Transition", "UnderwaterDiving", "Other",
)


def metric_kind(metric: Column | str = "metric_type") -> Column:
    m = as_col(metric)
    return (F.when(m.startswith(CATEGORY_PREFIX), "category")
            .when(m.startswith(WORKOUT), "workout")
            .otherwise("quantity"))


def is_summarisable(metric: Column | str = "metric_type") -> Column:
    """Only quantities may be averaged; category codes and workouts stay raw."""
    m = as_col(metric)
    return ~m.startswith(CATEGORY_PREFIX) & ~m.startswith(WORKOUT)


def is_cumulative(metric: Column | str = "metric_type") -> Column:
    return as_col(metric).isin(*CUMULATIVE_METRICS)


def value_type(metric: Column | str = "metric_type") -> Column:
    return F.when(is_cumulative(metric), "daily_total").otherwise("daily_avg")


def is_valid_metric(metric: Column | str = "metric_type") -> Column:
    return as_col(metric).rlike(METRIC_TYPE_PATTERN)


def is_importable(metric: Column | str = "metric_type") -> Column:
    m = as_col(metric)
    skipped = F.lit(False)
    for prefix in IMPORT_SKIP_PREFIXES:
        skipped = skipped | m.startswith(prefix)
    return ~skipped


def short_metric_name(metric: Column | str = "metric_type") -> Column:
    """Display name: the identifier without its prefix, categories marked."""
    bare = F.replace(as_col(metric), F.lit(QUANTITY_PREFIX), F.lit(""))
    return F.replace(bare, F.lit(CATEGORY_PREFIX), F.lit("Cat:"))


def stage_name(code: Column | str) -> Column:
    """Short stage name of a sleep code, NULL for codes that are not a stage."""
    c = as_col(code)
    return (F.when(c == 2, "Awake").when(c == 3, "Core").when(c == 4, "Deep").when(c == 5, "REM"))


def stage_identifier(code: Column | str) -> Column:
    """Full stage identifier of a sleep code, as devices write it into metadata."""
    c, out = as_col(code), None
    for i, name in enumerate(SLEEP_VALUE_NAMES):
        hit = c == i
        out = F.when(hit, SLEEP_VALUE_PREFIX + name) if out is None else out.when(hit, SLEEP_VALUE_PREFIX + name)
    return out.otherwise(SLEEP_VALUE_PREFIX + "Unknown")


def stage_code(identifier: Column | str) -> Column:
    """Inverse of `stage_identifier`, NULL for any other text."""
    c, out = as_col(identifier), None
    for i, name in enumerate(SLEEP_VALUE_NAMES):
        hit = c == SLEEP_VALUE_PREFIX + name
        out = F.when(hit, float(i)) if out is None else out.when(hit, float(i))
    return out


def workout_type(metadata: Column | str = "metadata") -> Column:
    """Workout type from the metadata text, without the vendor prefix."""
    raw = F.get_json_object(as_col(metadata), "$.workout_type")
    return F.coalesce(F.replace(raw, F.lit(WORKOUT_NAME_PREFIX), F.lit("")), F.lit("unknown"))


def metadata_number(field: str, metadata: Column | str = "metadata") -> Column:
    return F.get_json_object(as_col(metadata), f"$.{field}").try_cast("double")
