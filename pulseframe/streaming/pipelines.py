"""Incremental ingest with Structured Streaming.

Each pipeline reads new files from a landing directory and hands every micro-batch
to an idempotent step: the checkpoint remembers which files were taken, and a
micro-batch that is replayed after a failure writes the same rows again, which changes
nothing.  Rows may be of any age; there is no watermark that could drop them.  What
cannot be stored goes to a reject table with its reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators import daily, ingest
from ..sources import rejects as rejected, tables
from ..sources.json_batches import BATCH_FILES, complete


def drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, micro-batch by micro-batch, then stop."""
    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _batches(spark: SparkSession, landing: str, user_id) -> DataFrame:
    return complete(spark.readStream.schema(BATCH_FILES).json(landing), user_id)


def ingest_batches(spark: SparkSession, landing: str, sink: str, checkpoint: str, max_samples: int | None = S.MAX_BATCH,
                   rejects: str | None = None, user_id=None) -> None:
    """JSON batch files to typed samples, appended; `current` resolves corrections on read.  What is
    refused goes to `rejects`, by default a folder beside the sink."""
    rejects = rejects or f"{sink.rstrip('/')}-rejects"

    def step(batches: DataFrame, number: int) -> None:
        judged = ingest.check_batches(batches, max_samples)
        ingest.samples_of(judged, "batch_no").write.mode("overwrite").parquet(f"{sink}/micro_batch={number}")
        rejected.keep(rejected.of_batches(judged), rejects, number)

    drain(_batches(spark, landing, user_id), step, checkpoint)


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The appended samples, last write per key; their number, which is in the files' footers, is how widely they are spread."""
    appended = spark.read.parquet(sink)
    return ingest.latest_per_key(appended, rows=appended.count()).select(*S.SAMPLE_COLUMNS)


def upsert_batches(spark: SparkSession, landing: str, root: str, checkpoint: str, max_samples: int | None = S.MAX_BATCH,
                   rejects: str | None = None, user_id=None) -> None:
    """JSON batch files straight into the store, last write wins, with the summaries of the
    days they touch.  What is refused goes to `rejects`, by default a folder beside the store."""
    rejects = rejects or f"{root.rstrip('/')}-rejects"

    def step(batches: DataFrame, number: int) -> None:
        judged = ingest.check_batches(batches, max_samples)
        tables.upsert_samples(spark, root, ingest.samples_of(judged, "batch_no"))
        rejected.keep(rejected.of_batches(judged), rejects, number)

    drain(_batches(spark, landing, user_id), step, checkpoint)


def dedupe(spark: SparkSession, landing: str, schema, root: str, checkpoint: str, files_at_once: int | None = None) -> None:
    """Sample files into the store; of a sample that is sent again, the copy sent
    last (the highest `seq`) counts, in whatever order the files arrive."""
    stream = spark.readStream.schema(schema)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    drain(stream.parquet(landing), lambda rows, _: tables.upsert_samples(spark, root, rows, by_seq=True), checkpoint)


def daily_points(spark: SparkSession, landing: str, schema, root: str, checkpoint: str, closed_before,
                 tz: str = S.DEFAULT_TZ, files_at_once: int | None = None) -> None:
    """Sample files into a store that keeps the daily points of all days before `closed_before`
    as summaries.  A late row of a closed day recomputes that day from its raw samples."""
    def step(rows: DataFrame, _: int) -> None:
        if tables.current_version(spark, root) == 0:
            empty = rows.limit(0)
            tables.publish(spark, root, empty.select(*S.SAMPLE_COLUMNS), daily.daily_summary(empty, tz))
            tables.publish_cut(spark, root, daily.daily_summary(empty, tz), closed_before, tz)
        tables.upsert_into_tiers(spark, root, rows, by_seq=True)

    stream = spark.readStream.schema(schema)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    drain(stream.parquet(landing), step, checkpoint)


def closed_and_open(spark: SparkSession, root: str, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """The stored points of closed days, and those of open days computed from their samples,
    the only ones that are read."""
    samples, closed = tables.open_tiers(spark, root)
    points = daily.daily_from_raw(samples, tz).select(*closed.columns)
    return closed.withColumn("state", F.lit("closed")).unionByName(points.withColumn("state", F.lit("open")))
