"""A corpus pipeline: toxic documents go, lines and near copies are reduced to one, personal data is masked, and what is
left is packed into training sequences. Each stage's rows are written and read again before the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import lines, near, packing, pii, simhash, toxicity
from pulseframe.llm.queries import pii_key, table, with_test_key
from pulseframe.llm.shared import scratch, store


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars says how long the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and with them documents of which nothing is left."""
    out = lines.dedup_documents(docs).where(r"n_lines_removed = 0 OR text RLIKE '\\S'")
    return _measured(out.select(*docs.columns))


def fingerprint_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and the component of the document's SimHash fingerprint."""
    prints = store(simhash.fingerprints(docs.withColumn("th", F.xxhash64("text")), keys=("doc_id", "th")))
    return prints.join(simhash.clusters(prints), "fp").select("doc_id", "th", F.col("component").alias("cluster"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, the one of the smallest doc_id.  Near copies are documents that op2's
    operator links, by fingerprints that differ in two bits at most, and those whose five-word shingles have a similarity of 0.8
    or more, which fingerprints alone would mostly miss; a group is all that links of either kind reach.  A document is a pair of
    doc_id and text: another text under the same id is another document, and of rows that repeat both, one stays.  Documents
    without a doc_id all stay."""
    own = "_text_hash"
    alike = fingerprint_clusters(docs.where("doc_id IS NOT NULL"))
    groups = near.near_copies(docs, alike=alike).groupBy("doc_id", F.col("th").alias(own)).agg(
        F.max("leads").alias("leads"), F.count("*").alias("rows"))
    rows = docs.withColumn(own, F.xxhash64("text"))
    others = groups.where("NOT leads").select("doc_id", own)
    repeated = groups.where("leads AND rows > 1").select("doc_id", own)
    once = rows.join(repeated, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    single = rows.join(others.unionByName(repeated), ["doc_id", own], "left_anti")
    return single.unionByName(once.select(*single.columns)).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms, under the session's key, or one for the supplied synthetic tables."""
    return _measured(pii.pseudonymise(docs, pii_key(with_test_key(spark))).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows


#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
