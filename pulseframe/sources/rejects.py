"""One table for everything that is not stored, whatever it came from, and its way back.

A row has the ``source`` ('json', 'xml' or 'store'), the ``place`` there, the user where one is
known, the reason, and the ``content``: a sample as JSON with its fields as they came, an array
of them for a batch that was refused as a whole, or the text that could not be read.  `replay`
takes rows that a caller has mended back to samples; what is still wrong stays a reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.metrics import is_valid_metric, stage_code
from ..functions.numbers import number_or_null
from ..operators import ingest
from ..schema import SAMPLE_COLUMNS

LAYOUT = "source string, place string, user_id string, reason string, content string"
COLUMNS = ("source", "place", "user_id", "reason", "content")
#: A sample's fields as they came.
FIELDS = ("user_id string, metric_type string, value string, unit string, source_device string, started_at string, "
          "ended_at string, metadata string")
XML_DATE = "yyyy-MM-dd HH:mm:ss Z"  # fixed value: the export's date format


def rows(df: DataFrame, source: str, place: Column, reason: Column, content: Column) -> DataFrame:
    """Rejects in the common layout; `df` has the user."""
    return df.select(F.lit(source).alias("source"), place.cast("string").alias("place"), F.col("user_id").cast("string").alias("user_id"),
                     reason.alias("reason"), content.alias("content"))


def of_batches(judged: DataFrame, batch_order: Column | str = "batch_no") -> DataFrame:
    """What `ingest.check_batches` refused, and the samples of accepted batches that cannot be stored."""
    found = ingest.rejects(judged, batch_order)
    return rows(found, "json", F.col("batch_no"), F.col("reason"), F.col("content"))


def keep(found: DataFrame, path: str, run: int | str) -> None:
    """Add the rejects of a run; a run that is repeated replaces its own."""
    found.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/run={run}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rejects under a path, with the ``run`` that they come from."""
    return spark.read.schema(f"{LAYOUT}, run string").option("basePath", path).parquet(path)


def _instant(text: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit(XML_DATE)))


def replay(found: DataFrame, mend: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, what is still rejected) of rejects, after `mend` has changed their users and contents.

    A batch that was refused as a whole comes back sample by sample.
    """
    mended = (mend(found) if mend else found).select(*COLUMNS)
    many = F.from_json("content", f"array<struct<{FIELDS.replace(' string', ': string')}>>")
    one = F.from_json("content", FIELDS)
    parsed = mended.withColumn("s", F.explode_outer(F.when(F.col("content").rlike(r"^\s*\["), many).otherwise(F.array(one))))
    s = F.col("s")
    unread = s.isNull() | (F.to_json("s") == "{}")
    typed = parsed.select(
        "source", "place", F.coalesce(s["user_id"], "user_id").alias("user_id"), s["metric_type"].alias("metric_type"),
        F.coalesce(number_or_null(s["value"]), stage_code(s["value"])).alias("value"), s["unit"].alias("unit"),
        s["source_device"].alias("source_device"), _instant(s["started_at"]).alias("started_at"),
        _instant(s["ended_at"]).alias("ended_at"), s["metadata"].alias("metadata"), F.lit(0).cast("bigint").alias("seq"),
        F.when(unread, F.col("content")).otherwise(F.to_json("s")).alias("content"), F.when(unread, "unreadable").alias("_read"))
    reason = F.coalesce("_read", F.when(F.col("user_id").isNull(), "no user")
                        .when(F.col("started_at").isNull(), "unreadable start")
                        .when(~F.coalesce(is_valid_metric("metric_type"), F.lit(False)), "no valid metric"))
    judged = typed.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).select(*SAMPLE_COLUMNS)
    return good, judged.filter(F.col("reason").isNotNull()).select(*COLUMNS)
