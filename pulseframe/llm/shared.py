"""Helpers of this subpackage: the shared scratch folder and stored intermediate tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The application's folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a single-process session (``local``, ``local[n]``) gets a temporary folder; on a cluster a
    local folder would be a different one on each machine, so there it is an error.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="pulseframe-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/pulseframe-llm/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the stored intermediate tables of this application, once its results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: its lineage ends there, and it survives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that a task has freed back to the system: a Python worker waits for its next task beside the JVM's tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with ``release`` once it has ended and its own variables are gone."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; NULL text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def hex_digest(value: Column) -> Column:
    """SHA-256 in lowercase hex of a string (as UTF-8) or of bytes."""
    return F.sha2(value.cast("binary"), 256)
