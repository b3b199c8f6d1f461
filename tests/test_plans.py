"""What the physical plans must and must not contain."""

import re

import pytest

from pulseframe_checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
# Queries that run a stream or write files while they are built.
EAGER = {"backfill_resume", "import_rejects", "replay_rejects", "ingest_unnumbered", "xml_import_split", "compact_deltas", "late_after_drop", "upsert_delta_merge", "ingest_batch", "ingest_rejects", "publish_late_twice", "publish_tiers", "stream_rejects", "xml_to_store", "stream_daily", "stream_dedupe", "stream_ingest", "stream_upsert", "xml_import", "xml_import_report"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_python_or_single_task_window(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas|Scan ExistingRDD", text), text
    assert "Exchange SinglePartition" not in text or "Window" not in text
    assert not re.search(r"Window \[[^\]]*\], \[\]", text)


@pytest.mark.parametrize("name", ["scan_recent", "coaching_recovery", "top_workouts", "search_records"])
def test_per_user_limits_cut_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit.*Partial", plan(spark, name))


def test_time_and_metric_filters_reach_the_scan(spark):
    text = plan(spark, "scan_range")
    assert re.search(r"PushedFilters: \[.*In\(event_type|PushedFilters: \[.*EqualTo\(event_type", text)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema


def test_a_single_metric_of_many_reads_one_scan(spark):
    from pulseframe import schema as S
    from pulseframe.operators.scans import for_metrics
    from pulseframe.sources.driver_tables import samples

    df = for_metrics(samples(spark, SF), S.HRV)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize("name", ["daily_summary", "retention_apply", "view_daily_quantity_utc", "daily_from_raw"])
def test_raw_rows_are_aggregated_by_hash(spark, name):
    """A sort aggregate may fold the few unit rows of a day, but never reads a scan."""
    text = plan(spark, name)
    for block in text.split("FileScan")[:-1]:
        nearest = re.findall(r"(\w*)Aggregate\(", block)
        assert not nearest or nearest[-1] == "Hash"


def test_an_upsert_aggregates_only_the_new_rows(spark):
    text = plan(spark, "upsert_latest")
    assert "LeftAnti" in text and text.count("max_by") == 2 * text.count("partial_max_by")


def test_the_brief_joins_no_parts(spark):
    assert "FullOuter" not in plan(spark, "coaching_brief")


@pytest.mark.parametrize("name,most", [("series_range", 4), ("search_counts", 4), ("compare_periods", 4)])
def test_each_tier_is_scanned_once(spark, name, most):
    assert plan(spark, name).count("FileScan") <= most


@pytest.mark.parametrize("name", ["ingest_dedupe", "upsert_latest", "daily_from_raw", "inventory", "sleep_sessions"])
def test_hot_groups_combine_on_the_map_side(spark, name):
    assert "partial_" in plan(spark, name)
