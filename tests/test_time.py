import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import time as t
from tests.conftest import at, rows


def days(spark, fn, *texts):
    df = spark.createDataFrame([(i, at(x)) for i, x in enumerate(texts)], "i int, ts timestamp")
    return [str(r[0]) for r in df.orderBy("i").select(fn("ts")).collect()]


def test_local_day_edges(spark):
    assert days(spark, t.local_day, "2024-01-15 04:59", "2024-01-15 05:00", "2024-07-15 03:59", "2024-07-15 04:00") == [
        "2024-01-14", "2024-01-15", "2024-07-14", "2024-07-15"]


def test_before_1970_and_dst_days(spark):
    assert days(spark, t.local_day, "1969-12-31 04:59", "1969-12-31 05:00", "2024-03-10 04:59", "2024-03-11 03:59",
                "2024-11-03 03:59", "2024-11-04 04:59") == [
        "1969-12-30", "1969-12-31", "2024-03-09", "2024-03-10", "2024-11-02", "2024-11-03"]


def test_night_starts_at_six(spark):
    # 10:59Z is 05:59 in New York in winter
    assert days(spark, t.night_date, "2024-01-15 10:59", "2024-01-15 11:00") == ["2024-01-14", "2024-01-15"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kathmandu", "America/Los_Angeles"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(at("2024-01-15 04:59"),), (at("2024-07-01 23:30"),)], "ts timestamp")
        got = [tuple(map(str, r)) for r in df.orderBy("ts").select(
            t.local_day("ts"), t.night_date("ts"), t.local_minute("ts"), t.utc_time("ts"),
            F.unix_seconds(t.local_midnight(t.local_day("ts")))).collect()]
        assert got == [("2024-01-14", "2024-01-14", "1439", "2024-01-15 04:59:00", str(int(at("2024-01-14 05:00").timestamp()))),
                       ("2024-07-01", "2024-07-01", "1170", "2024-07-01 23:30:00", str(int(at("2024-07-01 04:00").timestamp())))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_bounds_of_dst_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 10),), (dt.date(2024, 11, 3),), (dt.date(2024, 6, 1),)], "d date")
    hours = (F.unix_seconds(t.next_local_midnight("d")) - F.unix_seconds(t.local_midnight("d"))) / 3600
    assert [r[0] for r in rows(df.select("d", hours.alias("h")).orderBy("d").select("h"))] == [23.0, 24.0, 25.0]
    assert t.day_start("2024-03-11") == at("2024-03-11 04:00")


def test_window_bounds_reach_both_edges(spark):
    df = spark.createDataFrame([(at(x),) for x in ("2024-01-10 04:59", "2024-01-10 05:00", "2024-01-12 04:59", "2024-01-12 05:00")], "ts timestamp")
    assert df.filter(t.in_days("ts", "2024-01-10", "2024-01-11")).count() == 2


@pytest.mark.parametrize("bad", ["2024-13-01", "yesterday", None, "01/02/2024"])
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        t.as_date(bad)


def test_ranges_and_clamps():
    with pytest.raises(ValueError):
        t.check_range("2024-02-01", "2024-01-01")
    assert t.check_range("2005-01-01", "2024-01-01")
    assert t.check_range("2024-01-01", "2024-01-01")
    assert [t.positive(x, "days") for x in ("7", 1, 99999)] == [7, 1, 99999]
    for bad in (0, -5, "x", None):
        with pytest.raises(ValueError):
            t.positive(bad, "days")


def test_backfill_chunks(spark):
    df = spark.createDataFrame([(at("2013-01-01 00:00"),), (at("2013-03-31 23:59"),), (at("2013-04-01 00:00"),)], "ts timestamp")
    assert [r[0] for r in df.orderBy("ts").select(t.backfill_chunk("ts")).collect()] == [0, 0, 1]
