"""The phone's XML export: a stream of ``<Record>`` elements.

`read_records` uses Spark's XML source, which reads one file per task.  `read_records_split` cuts
the text at the record tags, so that a file of any size is as many tasks as it has splits; it reads
the same records, as long as no comment or CDATA section holds a record tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.metrics import is_importable, is_valid_metric, stage_code
from ..functions.numbers import number_or_null
from ..schema import MAX_STRING
from . import rejects, tables
from .rejects import XML_DATE

RECORD = ("_type string, _sourceName string, _unit string, _startDate string, "
          "_endDate string, _value string")
#: The attributes of an opening tag; a value may hold any sign but its quote.
_OPEN_TAG = r"""^(\s(?:[^<>"']|"[^"]*"|'[^']*')*)>"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw attributes plus the file each record came from."""
    return (spark.read.format("xml").option("rowTag", "Record").schema(RECORD).load(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def read_records_split(spark: SparkSession, path: str) -> DataFrame:
    """The same from splits of files: the text between two record tags is a row, whose attributes are parsed as XML."""
    text = spark.read.option("lineSep", "<Record").text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"))
    tag = F.regexp_extract("value", _OPEN_TAG, 1)
    element = F.concat(F.lit("<Record"), F.regexp_replace(tag, r"/\s*$", ""), F.lit("/>"))
    parsed = text.filter(tag != "").select(F.from_xml(element, RECORD).alias("r"), "source_file")
    return parsed.select("r.*", "source_file")


def normalise_records(records: DataFrame, user_id, *keep: str) -> DataFrame:
    """Typed samples with an ``import_status`` of 'ok', 'skipped' or 'quarantined'.

    A sleep value given as a stage name becomes its code; other text becomes NULL.
    Long strings are cut to the stored width.  A record without a valid metric
    or start date is quarantined rather than stored with a made-up one.  `keep` names
    further columns of the records to pass on.
    """
    started = F.try_to_timestamp("_startDate", F.lit(XML_DATE))
    return records.select(
        (user_id if isinstance(user_id, Column) else F.lit(user_id)).alias("user_id"),
        F.col("_type").alias("metric_type"),
        F.coalesce(number_or_null("_value"), stage_code("_value")).alias("value"),
        F.substring(F.coalesce("_unit", F.lit("")), 1, MAX_STRING).alias("unit"),
        F.substring(F.coalesce("_sourceName", F.lit("")), 1, MAX_STRING).alias("source_device"),
        started.alias("started_at"),
        F.try_to_timestamp("_endDate", F.lit(XML_DATE)).alias("ended_at"),
        F.lit(None).cast("string").alias("metadata"), *keep,
        F.when(~is_importable("_type"), "skipped")
         .when(~F.coalesce(is_valid_metric("_type"), F.lit(False)) | started.isNull(), "quarantined")
         .otherwise("ok").alias("import_status"))


def quarantined(records: DataFrame, user_id) -> DataFrame:
    """The quarantined records as rejects, their attributes as they came."""
    content = F.to_json(F.struct(
        F.col("_type").alias("metric_type"), F.col("_value").alias("value"), F.col("_unit").alias("unit"),
        F.col("_sourceName").alias("source_device"), F.col("_startDate").alias("started_at"), F.col("_endDate").alias("ended_at")))
    judged = normalise_records(records.withColumn("content", content), user_id, "content", "source_file")
    reason = F.when(F.col("started_at").isNull(), "unreadable start").otherwise("no valid metric")
    return rejects.rows(judged.filter("import_status = 'quarantined'"), "xml", F.col("source_file"), reason, F.col("content"))


def import_into_store(spark: SparkSession, path: str, user_id, root: str, run: str = "import") -> DataFrame:
    """The export's valid records into the stored tiers; a key that is stored already, or that
    comes up again later in the export, is ignored.  What is quarantined goes to the rejects under
    the store's root.  Returns the import report.

    The export is parsed once, into the shared folder.  ``seq`` is the place of a record.
    """
    stage = tables.shared_dir(spark, "export")
    read_records_split(spark, path).withColumn("seq", F.monotonically_increasing_id()).write.parquet(stage)
    records = spark.read.schema(f"{RECORD}, source_file string, seq bigint").parquet(stage)
    rows = normalise_records(records, user_id, "seq")
    tables.insert_into_tiers(spark, root, rows.filter(F.col("import_status") == "ok"))
    rejects.keep(quarantined(records, user_id), f"{root}/rejects", run)
    return import_report(rows)


def import_report(imported: DataFrame) -> DataFrame:
    """Record counts by outcome."""
    return imported.groupBy("import_status").agg(F.count("*").alias("records"))
