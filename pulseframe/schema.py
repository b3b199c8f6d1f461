"""Table layouts, metric identifiers and bounds shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: identifier prefixes and the metrics the reports name -----
QUANTITY_PREFIX = "HKQuantityTypeIdentifier"
CATEGORY_PREFIX = "HKCategoryTypeIdentifier"
WORKOUT = "HKWorkoutTypeIdentifier"
STEPS = "HKQuantityTypeIdentifierStepCount"
HEART_RATE = "HKQuantityTypeIdentifierHeartRate"
HRV = "HKQuantityTypeIdentifierHeartRateVariabilitySDNN"
RESTING_HR = "HKQuantityTypeIdentifierRestingHeartRate"
VO2MAX = "HKQuantityTypeIdentifierVO2Max"
ACTIVE_ENERGY = "HKQuantityTypeIdentifierActiveEnergyBurned"
WEIGHT = "HKQuantityTypeIdentifierBodyMass"
SPO2 = "HKQuantityTypeIdentifierOxygenSaturation"
RESPIRATORY_RATE = "HKQuantityTypeIdentifierRespiratoryRate"
SLEEP = "HKCategoryTypeIdentifierSleepAnalysis"

# Metrics whose meaningful daily number is the total, not the mean.
CUMULATIVE_METRICS = (
    "HKQuantityTypeIdentifierStepCount",
    "HKQuantityTypeIdentifierActiveEnergyBurned",
    "HKQuantityTypeIdentifierDistanceWalkingRunning",
    "HKQuantityTypeIdentifierDistanceCycling",
    "HKQuantityTypeIdentifierBasalEnergyBurned",
    "HKQuantityTypeIdentifierAppleExerciseTime",
    "HKQuantityTypeIdentifierFlightsClimbed",
)

# Sleep category codes.
ASLEEP_CORE, ASLEEP_DEEP, ASLEEP_REM = 3.0, 4.0, 5.0
ASLEEP_STAGES = (ASLEEP_CORE, ASLEEP_DEEP, ASLEEP_REM)

# Defaults of ingest and retention.
DEFAULT_TZ = "America/New_York"
RAW_DAYS = 30
MAX_STRING = 256
MAX_BATCH = 1000
BACKFILL_EPOCH = "2013-01-01"
BACKFILL_CHUNK_DAYS = 90

# --- keys ------------------------------------------------------------------
SAMPLE_KEY = ("user_id", "metric_type", "started_at")
DAY_KEY = ("user_id", "metric_type", "date")

# --- layouts ---------------------------------------------------------------
# One row per recorded sample.  `seq` is the arrival order used by the
# first-wins / last-wins rules.
SAMPLES = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("metric_type", T.StringType(), False),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("source_device", T.StringType()),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("seq", T.LongType()),
])
SAMPLE_COLUMNS = tuple(SAMPLES.fieldNames())

# One row per user, metric and local day.
SUMMARIES = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("metric_type", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("avg_value", T.DoubleType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("sum_value", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("unit", T.StringType()),
])
SUMMARY_COLUMNS = tuple(SUMMARIES.fieldNames())

# The JSON batch a client posts.  Timestamps stay text until validated, and
# metadata is kept as the JSON text it arrived in.
PAYLOAD = T.StructType([
    T.StructField("samples", T.ArrayType(T.StructType([
        T.StructField("metric_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source_device", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]))),
])
