"""Client batches: one JSON document ``{"samples": [...]}`` per row or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ingest import CORRUPT
from ..schema import PAYLOAD


BATCH_FILES = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("batch_no", T.LongType()),
                            *PAYLOAD.fields, T.StructField(CORRUPT, T.StringType())])


def complete(batches: DataFrame, user_id=None) -> DataFrame:
    """A client's own payload names neither user nor order: the caller gives the user, and a
    batch without a number is ordered by when its file was written, the file's name, and the
    place in the file."""
    meta = F.col("_metadata")
    return batches.select(
        "*", meta["file_path"].alias("source_file"), meta["file_block_start"].alias("source_block"),
        F.unix_micros(meta["file_modification_time"]).alias("_arrived")).withColumn(
        "batch_no", F.coalesce("batch_no", "_arrived")).withColumn(
        "user_id", F.coalesce(F.col("user_id"), F.lit(user_id).cast("string"))).drop("_arrived")


def read_batches(spark: SparkSession, path: str, schema=BATCH_FILES, user_id=None) -> DataFrame:
    """Batches from JSON-lines files, one document per line.  The schema is given,
    so nothing is read twice to infer it; a line that is no JSON keeps its text."""
    return complete(spark.read.schema(schema).json(path), user_id)


def parse_batches(df: DataFrame, text: str = "payload") -> DataFrame:
    """Parse a column of JSON documents into a `samples` array column."""
    parsed = F.from_json(F.col(text), PAYLOAD)
    return df.withColumn("samples", parsed["samples"]).drop(text)
