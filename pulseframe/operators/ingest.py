"""Batches to samples: guards, in-batch dedupe, and the three conflict rules.

Duplicates are resolved by aggregation (`max_by` / `min_by` on the arrival
order), which combines on the map side: a key with a third of all rows costs
one row per task in the shuffle.  That aggregation sorts, so a task holds the rows of its
split; where the caller knows how many rows there are, they are spread over as many tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import metric_kind, stage_identifier
from ..functions.time import as_col
from ..functions.units import preferred_units, unit_conversions
from ..schema import MAX_BATCH, MAX_STRING, SAMPLE_COLUMNS, SAMPLE_KEY, SLEEP

CORRUPT = "_corrupt_record"  # where Spark's JSON reader puts a line that it cannot read
ARRIVAL = "arrival"          # a sample's place in the order of arrival, finer than `seq`, the number of its batch
#: Rows that a task sorts, where their number is known.
SORTED = 100_000
#: Tasks that rows are spread over at most: up to so many, Spark's shuffle writes rows straight to files (its
#: `spark.shuffle.sort.bypassMergeThreshold`); beyond, a task that reads a large split would hold all of it.
SPREAD = 200


def check_batches(batches: DataFrame, max_samples: int | None = MAX_BATCH, max_string: int | None = MAX_STRING) -> DataFrame:
    """Adds ``verdict``: 'accepted', 'unreadable', 'empty', 'too many samples' or 'string too long'.

    A batch is one row with a `samples` array, so each is judged where it lies,
    without a shuffle.  A bound of None lifts that guard.  What is not accepted belongs
    in the reject table, see `rejects`.
    """
    n = F.coalesce(F.size("samples"), F.lit(0))
    n = F.when(F.col("samples").isNull(), 0).otherwise(n)

    def long(s, name):
        return F.coalesce(F.length(s[name]), F.lit(0)) > (max_string or 0)

    too_long = F.exists("samples", lambda s: long(s, "metric_type") | long(s, "unit") | long(s, "source_device"))
    verdict = F.when(n == 0, "empty")
    if CORRUPT in batches.columns:
        verdict = F.when(F.col(CORRUPT).isNotNull(), "unreadable").when(n == 0, "empty")
    if max_samples is not None:
        verdict = verdict.when(n > max_samples, "too many samples")
    if max_string is not None:
        verdict = verdict.when(too_long, "string too long")
    return batches.withColumn("sample_count", n.cast("bigint")).withColumn("verdict", verdict.otherwise("accepted"))


def _unpacked(batches: DataFrame, batch_order: Column | str) -> DataFrame:
    # Within a file the lines of a block follow each other in one task; `complete` tells file and block.
    line = F.monotonically_increasing_id() if "source_file" in batches.columns else F.lit(0).cast("bigint")
    file = F.col("source_file") if "source_file" in batches.columns else F.lit(None).cast("string")
    block = F.col("source_block") if "source_block" in batches.columns else F.lit(None).cast("bigint")
    s = F.col("s")
    rows = (batches.withColumn("_line", line).filter(F.col("verdict") == "accepted")
            .select("user_id", as_col(batch_order).cast("bigint").alias("batch_no"), file.alias("_file"),
                    block.alias("_block"), "_line", F.posexplode("samples").alias("_pos", "s")))
    number = F.coalesce("batch_no", F.lit(0))
    rows = rows.select(
        "user_id", s["metric_type"].alias("metric_type"), s["value"].alias("value"),
        s["unit"].alias("unit"), s["source_device"].alias("source_device"),
        s["started_at"].try_cast("timestamp").alias("started_at"),
        s["ended_at"].try_cast("timestamp").alias("ended_at"), s["metadata"].alias("metadata"), number.alias("seq"),
        F.struct(number.alias("number"), F.coalesce("_file", F.lit("")).alias("file"),
                 F.coalesce("_block", F.lit(0)).alias("block"), F.col("_line").alias("line"),
                 F.col("_pos").alias("place")).alias(ARRIVAL),
        "batch_no", s["started_at"].alias("_start"), s["ended_at"].alias("_end"))
    reason = (F.when(F.col("user_id").isNull(), "no user").when(F.col("started_at").isNull(), "unreadable start")
              .when(F.coalesce(F.trim("metric_type"), F.lit("")) == "", "no metric"))
    return rows.withColumn("reason", reason)


def samples_of(batches: DataFrame, batch_order: Column | str) -> DataFrame:
    """Samples of the accepted batches, with their order of ``arrival``.

    The order is by batch number, or the time the file was written, then by file, place of the
    batch in the file, and place in the batch; a batch without a number comes first.  ``seq`` is
    the number alone.  A sample without user, metric or readable start is left to
    `rejected_samples`.
    """
    return _unpacked(batches, batch_order).filter(F.col("reason").isNull()).drop("reason", "batch_no", "_start", "_end")


def rejected_samples(batches: DataFrame, batch_order: Column | str) -> DataFrame:
    """Samples of accepted batches that cannot be stored, each with its ``reason``."""
    return _unpacked(batches, batch_order).filter(F.col("reason").isNotNull())


def rejects(batches: DataFrame, batch_order: Column | str) -> DataFrame:
    """Everything that is not stored, as rows of (user_id, batch_no, reason, content as JSON).

    A sample's content has its fields as they came, so that it can be mended and replayed.
    """
    number = as_col(batch_order).cast("bigint").alias("batch_no")
    whole = F.coalesce(F.col(CORRUPT), F.to_json("samples")) if CORRUPT in batches.columns else F.to_json("samples")
    bad = batches.filter(F.col("verdict") != "accepted").select(
        "user_id", number, F.col("verdict").alias("reason"), whole.alias("content"))
    content = F.to_json(F.struct(
        "user_id", "metric_type", "value", "unit", "source_device", F.col("_start").alias("started_at"),
        F.col("_end").alias("ended_at"), "metadata"))
    samples = rejected_samples(batches, batch_order)
    return bad.unionByName(samples.select("user_id", "batch_no", "reason", content.alias("content")))


def _order(df: DataFrame) -> Column:
    return F.col(ARRIVAL) if ARRIVAL in df.columns else F.coalesce("seq", F.lit(-1 << 63))


def _pick(df: DataFrame, key, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(chooser(F.struct(*rest), _order(df)).alias("_r"))
            .select(*key, "_r.*").select(*df.columns))


def _spread(df: DataFrame, key, n: int) -> DataFrame:
    """Rows dealt to `n` tasks by key and ``_share``; the rows of one key fall into many shares."""
    return df.withColumn("_share", F.pmod(F.xxhash64(_order(df)), F.lit(n))).repartition(n, *key, "_share")


def latest_per_key(df: DataFrame, key=SAMPLE_KEY, rows: int = 0) -> DataFrame:
    """One row per key, the last to arrive: by ``arrival`` where there is one, else by ``seq``.

    With the number of `rows`, where it is known, no task sorts a whole split of the input: the last row of
    each key and share is found first, in tasks of about `SORTED` rows, then the last of each key.
    """
    if rows <= SORTED:
        return _pick(df, key, F.max_by)
    n = min(SPREAD, max(-(-rows // SORTED), df.sparkSession.sparkContext.defaultParallelism))
    shares = _pick(_spread(df, key, n), (*key, "_share"), F.max_by).drop("_share")
    return _pick(shares.repartition(n, *key), key, F.max_by)


def first_per_key(df: DataFrame, key=SAMPLE_KEY) -> DataFrame:
    """One row per key, the first to arrive."""
    return _pick(df, key, F.min_by)


def dedupe_batch(df: DataFrame) -> DataFrame:
    """Last write wins on (user, metric, start to the millisecond), so the same
    instant written with two different offsets is one sample."""
    keyed = df.withColumn("_ms", F.unix_millis("started_at"))
    return _pick(keyed, ("user_id", "metric_type", "_ms"), F.max_by).drop("_ms")


def upsert_latest(old: DataFrame, new: DataFrame, key=SAMPLE_KEY) -> DataFrame:
    """New rows replace old ones with the same key; the last copy of a new row counts.

    Only the new rows are aggregated.  `old` has unique keys and is not, and where the
    new keys are few Spark broadcasts them, so that `old` is not shuffled either.
    """
    delta = latest_per_key(new.select(*SAMPLE_COLUMNS), key)
    return old.select(*SAMPLE_COLUMNS).join(delta.select(*key), list(key), "left_anti").select(*SAMPLE_COLUMNS).unionByName(delta)


def insert_ignore(old: DataFrame, new: DataFrame, key=SAMPLE_KEY) -> DataFrame:
    """The new rows to append: first copy of each key the table does not have yet.

    The caller prunes `old` to the partitions that the new rows touch; an anti-join needs
    no distinct keys.
    """
    fresh = first_per_key(new.select(*SAMPLE_COLUMNS), key)
    return fresh.join(old.select(*key), list(key), "left_anti").select(*SAMPLE_COLUMNS)


def normalise_samples(readings: DataFrame) -> DataFrame:
    """Device readings to the sample layout.

    Input columns: user_id, metric_type, value, unit, device_name, source_name,
    started_at, ended_at, metadata, and for workouts duration_seconds,
    distance_m, energy_kcal, strokes, flights.  The device name wins over the
    source name; sleep gets its stage name and workouts their totals as metadata.
    """
    kind = metric_kind()
    sleep = F.to_json(F.struct(stage_identifier("value").alias("sleep_stage")))
    workout = F.to_json(F.struct(
        F.col("workout_type"), F.col("duration_seconds"),
        F.col("distance_m").alias("total_distance_meters"),
        F.col("energy_kcal").alias("total_energy_burned_cal"),
        F.col("strokes").alias("total_swimming_stroke_count"),
        F.col("flights").alias("total_flights_climbed")))

    def entries(text: Column) -> Column:
        """A JSON object as a map that keeps each value's type; anything else as an empty map."""
        kind = "map<string,variant>"
        return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", kind), F.create_map().cast(kind))

    def merged(extra: Column) -> Column:
        kept = F.map_filter(entries(F.col("metadata")), lambda key, _: ~F.map_contains_key(entries(extra), key))
        return F.to_json(F.map_concat(kept, entries(extra)))

    return readings.select(
        "user_id", "metric_type",
        F.when(kind == "workout", F.col("duration_seconds")).otherwise(F.col("value")).alias("value"),
        F.when(kind == "category", "category").when(kind == "workout", "seconds").otherwise(F.col("unit")).alias("unit"),
        F.coalesce("device_name", "source_name").alias("source_device"),
        "started_at", "ended_at",
        F.when(F.col("metric_type") == SLEEP, merged(sleep)).when(kind == "workout", merged(workout))
         .otherwise(F.col("metadata")).alias("metadata"))


def normalise_units(samples: DataFrame) -> DataFrame:
    """Quantities in their preferred unit, else in the first fallback unit of the same
    dimension.  Adds ``unit_status``: 'preferred', 'fallback' or 'unsupported' (value NULL).

    The two lookup tables are fixed and have a few hundred rows, so they are broadcast.
    """
    spark = samples.sparkSession
    conv = unit_conversions(spark)
    to_pref = conv.select(F.col("from_unit").alias("unit"), F.col("to_unit").alias("preferred_unit"),
                          F.col("factor").alias("pf"), F.col("shift").alias("po"))
    to_fall = conv.filter("is_fallback").select(
        F.col("from_unit").alias("unit"), F.col("to_unit").alias("fallback_unit"),
        F.col("factor").alias("ff"), F.col("shift").alias("fo"))
    df = (samples.join(F.broadcast(preferred_units(spark)), "metric_type", "left")
          .join(F.broadcast(to_pref), ["unit", "preferred_unit"], "left")
          .join(F.broadcast(to_fall), "unit", "left"))
    status = (F.when(F.col("pf").isNotNull(), "preferred").when(F.col("ff").isNotNull(), "fallback")
              .otherwise("unsupported"))
    value = F.col("value") * F.coalesce("pf", "ff") + F.coalesce("po", "fo")
    unit = (F.when(status == "preferred", F.col("preferred_unit"))
            .when(status == "fallback", F.col("fallback_unit")).otherwise("unsupported"))
    drop = ("value", "unit", "preferred_unit", "fallback_unit", "pf", "po", "ff", "fo")
    return df.select(*[c for c in samples.columns if c not in drop], value.alias("value"),
                     unit.alias("unit"), status.alias("unit_status"))
