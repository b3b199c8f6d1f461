"""Every registered query against its SQL at the smallest scale."""

import pytest

from pulseframe_checks.compare import compare, duck
from pulseframe_checks.oracle import ORACLE
from pulseframe_checks.registry import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    found = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    if found == "no rows":  # too few rows to show anything
        found = compare(spark, duck(LARGER), name, QUERIES[name], ORACLE[name], LARGER)
    assert found is None


def test_scan_day_keeps_all_rows_of_a_busy_user(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pulseframe_checks import registry

    day = spark.range(1200).select(
        F.lit("u").alias("user_id"), F.lit("m").alias("metric_type"), F.lit(1.0).alias("value"), F.lit("x").alias("unit"),
        F.lit("2024-01-15 17:00:00").cast("timestamp").alias("started_at"), F.col("id").alias("seq"))
    monkeypatch.setattr(registry, "raw", lambda spark, d: day)
    assert QUERIES["scan_day"](spark, "").count() == 1200


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
