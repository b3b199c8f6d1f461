import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.operators import daily, ingest, retention
from pulseframe.sources import json_batches, manifest, tables, xml_export
from pulseframe.streaming import pipelines
from tests.conftest import at, rows


def files(path):
    """Data files, index files included, and when they were written."""
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_stored_samples_are_pruned_by_metric(spark, make, tmp_path):
    path = str(tmp_path / "t")
    tables.write_samples(make([("u", S.HRV, 1, "2024-01-01 12:00"), ("u", S.STEPS, 2, "2024-02-01 12:00")]), path)
    one = tables.read_samples(spark, path).filter(F.col("metric_type") == S.HRV)
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(metric_type" in one._jdf.queryExecution().executedPlan().toString()


def store(spark, root, s):
    tables.publish(spark, root, s, daily.daily_summary(s.filter(F.lit(False))))


def test_upsert_writes_only_to_touched_months(spark, make, tmp_path):
    root = str(tmp_path / "t")
    tables.upsert_samples(spark, root, make([("u", S.HRV, 1, "2024-01-01 12:00"), ("u", S.HRV, 2, "2024-02-01 12:00"),
                                             ("u", S.STEPS, 3, "2024-02-01 12:00")]))
    before = files(root)
    new = make([("u", S.HRV, 20, "2024-02-01 12:00"), ("u", S.HRV, 21, "2024-02-02 12:00")])
    want = [(1.0,), (3.0,), (20.0,), (21.0,)]
    for _ in range(2):  # the second time changes nothing
        tables.upsert_samples(spark, root, new)
        assert rows(tables.stored_samples(spark, root).select("value"), "value") == want
    assert {f: t for f, t in files(root).items() if f in before} == before  # nothing in force is overwritten
    touched = {f.split("metric_type=")[1].split("/bucket=")[0] for f in set(files(f"{root}/samples")) - set(before)}
    assert touched == {f"{S.HRV}/month=2024-02"}


def test_publish_and_retention_run_twice(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u", S.HRV, i, f"2024-01-{1 + i % 28:02d} 1{i % 10}:00") for i in range(60)] + [("u", S.SLEEP, 3, "2024-01-02 05:00", "2024-01-02 06:00")])
    assert tables.current_version(spark, root) == 0
    store(spark, root, s)
    assert tables.raw_from(spark, root) is None
    results = []
    for expected in (2, 3):
        report = retention.run_retention(spark, root, "2024-02-20", 30)
        assert tables.current_version(spark, root) == expected
        kept, stored = tables.open_tiers(spark, root)
        results.append((kept.count(), rows(stored.select("date", "sum_value", "sample_count"), "date")))
        if expected == 2:
            assert rows(report.select("metric_type", "raw_count")) == [(S.HRV, 44)]
    assert results[0] == results[1]
    assert kept.filter(F.col("metric_type") == S.SLEEP).count() == 1


def test_late_rows_replace_the_summary_of_their_day_however_often_they_come(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u", S.HRV, 10, "2024-01-05 12:00"), ("u", S.HRV, 20, "2024-01-05 13:00"), ("u", S.HRV, 5, "2024-02-15 12:00"),
              ("u", S.SLEEP, 3, "2024-01-05 05:00", "2024-01-05 06:00"), ("u", S.HRV, 8, "2024-02-01 03:00")])
    store(spark, root, s)
    raw_files = set(files(f"{root}/samples"))
    retention.run_retention(spark, root, "2024-02-20", 10)
    assert set(files(f"{root}/samples")) == raw_files
    kept, stored = tables.open_tiers(spark, root)
    assert rows(kept.select("value"), "value") == [(3.0,), (5.0,)]
    assert not any(f"{S.HRV}/month=2024-01" in f for f in kept.inputFiles())  # expired months are not even listed
    late = make([("u", S.HRV, 60, "2024-01-05 14:00"), ("u", S.HRV, 7, "2024-02-15 12:00"), ("u", S.HRV, 10, "2024-01-05 12:00"),
                 ("u", S.HRV, 4, "2024-02-01 02:00")])
    for _ in range(2):
        tables.upsert_into_tiers(spark, root, late)
        kept, stored = tables.open_tiers(spark, root)
        assert rows(stored.select("date", "avg_value", "sample_count"), "date") == [
            (dt.date(2024, 1, 5), 30.0, 3), (dt.date(2024, 1, 31), 6.0, 2)]
        assert rows(kept.select("value"), "value") == [(3.0,), (7.0,)]
    cut = tables.raw_from(spark, root)
    assert cut == dt.date(2024, 2, 10) and daily.tiered_daily(
        kept.filter(F.col("metric_type") == S.HRV), stored, "2024-03-12", 90, cut).count() == 3


def test_the_cut_only_moves_forward(spark, make, tmp_path):
    root = str(tmp_path / "r")
    store(spark, root, make([("u", S.HRV, 1, "2024-02-01 12:00")]))
    retention.run_retention(spark, root, "2024-02-20", 10)
    with pytest.raises(ValueError):
        retention.run_retention(spark, root, "2024-02-05", 30)
    with pytest.raises(ValueError):
        retention.run_retention(spark, root, "2024-03-20", 10, tz="UTC")


def test_expired_months_can_be_deleted(spark, make, tmp_path):
    root = str(tmp_path / "r")
    store(spark, root, make([("u", S.HRV, 1, "2024-01-05 12:00"), ("u", S.HRV, 2, "2024-03-15 12:00"), ("u", S.SLEEP, 3, "2024-01-05 05:00")]))
    retention.run_retention(spark, root, "2024-03-20", 10, drop=True)
    tables.upsert_into_tiers(spark, root, make([("u", S.HRV, 50, "2024-01-05 12:00"), ("u", S.HRV, 4, "2024-03-15 12:00")]))
    gone = tables.vacuum(spark, root)
    assert gone and tables.vacuum(spark, root) == []
    kept, stored = tables.open_tiers(spark, root)
    assert rows(kept.select("value"), "value") == [(3.0,), (4.0,)] and rows(stored.select("sum_value")) == [(1.0,)]
    assert rows(tables.rejected(spark, root).select("reason")) == [("already counted",)]
    assert rows(tables.stored_samples(spark, root).select("value"), "value") == [(3.0,), (4.0,)]


def test_a_run_that_died_is_not_visible(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    store(spark, root, make([("u", S.HRV, 1, "2024-01-01 12:00")]))
    new = make([("u", S.HRV, 9, "2024-01-01 12:00")])
    with monkeypatch.context() as m:
        m.setattr(manifest, "_write_log", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            tables.upsert_into_tiers(spark, root, new)
    assert rows(tables.open_tiers(spark, root)[0].select("value")) == [(1.0,)]
    assert tables.upsert_into_tiers(spark, root, new) == 2
    assert rows(tables.open_tiers(spark, root)[0].select("value")) == [(9.0,)]


def batch(spark, path, no, value, start="2026-01-01T10:00:00Z"):
    text = ('{"user_id":"u","batch_no":%d,"samples":[{"metric_type":"%s","value":%s,"unit":"ms","source_device":"d","started_at":"%s"}]}'
            % (no, S.HRV, value, start))
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{no}.json", "w") as f:
        f.write(text + "\n")


def test_stream_ingest_restarts_where_it_stopped(spark, tmp_path):
    landing, sink, checkpoint, root = (str(tmp_path / n) for n in ("landing", "sink", "cp", "store"))
    batch(spark, landing, 1, 10)
    batch(spark, landing, 2, 20, "2026-01-01T06:00:00-04:00")  # the same instant
    for _ in range(2):  # the second run finds nothing new
        pipelines.ingest_batches(spark, landing, sink, checkpoint)
        pipelines.upsert_batches(spark, landing, root, checkpoint + "2")
        assert spark.read.parquet(sink).count() == 2
        assert rows(pipelines.current(spark, sink).select("value")) == [(20.0,)]
        assert rows(tables.stored_samples(spark, root).select("value")) == [(20.0,)]
    batch(spark, landing, 3, 30)
    batch(spark, landing, 4, 40, "2025-01-01T00:00:00Z")  # a year late
    pipelines.ingest_batches(spark, landing, sink, checkpoint)
    pipelines.upsert_batches(spark, landing, root, checkpoint + "2")
    assert rows(pipelines.current(spark, sink).select("value"), "value") == [(30.0,), (40.0,)]
    assert rows(tables.stored_samples(spark, root).select("value"), "value") == [(30.0,), (40.0,)]


def test_current_sorts_a_bounded_number_of_rows_in_a_task(spark, tmp_path, monkeypatch):
    sink, n = str(tmp_path / "sink"), 3000
    key = [("u0", 0) if i % 3 == 0 else (None if i % 50 == 1 else f"u{i % 7}", i % 400) for i in range(n)]  # one key has a third
    made = [(u, S.HRV, float(i), "ms", "d", at("2026-01-01 00:00") + dt.timedelta(minutes=t), None, None, i) for i, (u, t) in enumerate(key)]
    layout = "user_id string, metric_type string, value double, unit string, source_device string, started_at timestamp, ended_at timestamp, metadata string, seq long"
    arrival = F.struct(F.col("seq").alias("number"), F.lit("").alias("file"), F.lit(0).alias("block"), F.col("seq").alias("line"), F.lit(0).alias("place"))
    spark.createDataFrame(made, layout).withColumn(ingest.ARRIVAL, arrival).coalesce(1).write.parquet(f"{sink}/micro_batch=0")
    want = {k: float(i) for i, k in enumerate(key)}
    monkeypatch.setattr(ingest, "SORTED", 100)
    got = pipelines.current(spark, sink)
    assert sorted(r["value"] for r in got.collect()) == sorted(want.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[1]
    assert "Sort" not in plan[plan.rindex("Exchange hashpartitioning"):]  # not the split that a task reads
    assert plan.count("REPARTITION_BY_NUM") == 2
    dealt = ingest._spread(spark.read.parquet(sink), S.SAMPLE_KEY, 30).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 300


def test_a_poisoned_batch_does_not_stop_the_stream(spark, tmp_path):
    landing, root, checkpoint, rejects = (str(tmp_path / n) for n in ("landing", "store", "cp", "rejects"))
    batch(spark, landing, 1, 10)
    sample = '{"metric_type":%s,"value":1,"started_at":"%s"}'
    with open(f"{landing}/2.json", "w") as f:
        f.write('{"user_id":"u","batch_no":2,"samples":[%s]}\n' % ",".join(
            [sample % ("null", "2026-01-01T10:00:00Z"), sample % (f'"{S.HRV}"', "yesterday"), sample % (f'"{S.STEPS}"', "2026-01-01T10:00:00Z")]))
        f.write("{broken\n")
        f.write('{"samples":[%s]}\n' % (sample % (f'"{S.HRV}"', "2026-01-02T10:00:00Z")))
        f.write('{"user_id":"u","batch_no":1760000000000000,"samples":[%s]}\n' % (sample % (f'"{S.HRV}"', "2026-01-03T10:00:00Z")))
    pipelines.upsert_batches(spark, landing, root, checkpoint, rejects=rejects)
    assert tables.stored_samples(spark, root).count() == 3
    found = rows(spark.read.schema("reason string, content string").parquet(f"{rejects}/run=*").select("reason", "content"), "reason")
    assert [r for r, _ in found] == ["no metric", "no user", "unreadable", "unreadable start"]
    assert dict(found)["unreadable"] == "{broken"


def test_a_payload_without_user_and_number_is_completed(spark, tmp_path):
    landing = str(tmp_path / "landing")
    os.makedirs(landing)
    text = '{"samples":[{"metric_type":"%s","value":%d,"unit":"ms","source_device":"d","started_at":"2026-01-01T10:00:00Z"}]}'
    for i, value in enumerate((1, 2)):
        with open(f"{landing}/{i}.json", "w") as f:
            f.write(text % (S.HRV, value) + "\n")
        os.utime(f"{landing}/{i}.json", (1_760_000_000 + i, 1_760_000_000 + i))
    judged = ingest.check_batches(json_batches.read_batches(spark, landing, user_id="me"))
    got = ingest.dedupe_batch(ingest.samples_of(judged, "batch_no"))
    assert rows(got.select("user_id", "value", "unit")) == [("me", 2.0, "ms")]


def test_stream_equals_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    for i in range(6):
        batch(spark, landing, i, i, f"2026-01-0{1 + i % 3}T10:00:00Z")
    pipelines.ingest_batches(spark, landing, str(tmp_path / "s"), str(tmp_path / "c"))
    streamed = rows(pipelines.current(spark, str(tmp_path / "s")).select("started_at", "value"), "started_at")
    whole = ingest.check_batches(json_batches.read_batches(spark, landing))
    assert streamed == rows(ingest.latest_per_key(ingest.samples_of(whole, "batch_no")).select("started_at", "value"), "started_at")


def test_the_same_delivery_twice_is_one(spark, make, tmp_path):
    landing = str(tmp_path / "landing")
    s = make([("u", S.HRV, i, f"2024-0{1 + i}-01 12:00") for i in range(5)])  # months apart
    args = (landing, s.schema, str(tmp_path / "store"), str(tmp_path / "cp"))
    for _ in range(2):
        s.write.mode("append").parquet(landing)
        pipelines.dedupe(spark, *args, files_at_once=1)
    assert rows(tables.stored_samples(spark, str(tmp_path / "store")).select("value"), "value") == [(float(i),) for i in range(5)]


def test_streamed_days_plus_open_days_are_all_days(spark, make, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    s = make([("u", S.HRV, i, f"2024-01-{1 + i:02d} 04:5{i % 10}") for i in range(12)] + [("u", S.HRV, 100, "2024-01-02 10:00")])
    s.repartition(4, "seq").write.parquet(landing)
    pipelines.daily_points(spark, landing, s.schema, root, str(tmp_path / "cp"), "2024-01-08", files_at_once=1)
    late = make([("v", S.HRV, 7, "2023-11-05 10:00"), ("u", S.HRV, 3, "2024-01-03 10:00")])
    late.write.mode("append").parquet(landing)
    pipelines.daily_points(spark, landing, s.schema, root, str(tmp_path / "cp"), "2024-01-08", files_at_once=1)
    both = pipelines.closed_and_open(spark, root)
    assert both.filter("state = 'closed'").count() == 9 and both.filter("state = 'open'").count() == 4
    want = daily.daily_from_raw(s.unionByName(late))
    assert rows(both.select("user_id", "date", "avg_value", "sample_count"), "user_id", "date") == rows(
        want.select("user_id", "date", "avg_value", "sample_count"), "user_id", "date")


def test_xml_goes_into_the_store_once(spark, make, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "export.xml")
    store(spark, root, make([("me", S.HRV, 50, "2026-01-01 10:00")]))
    record = '<Record type="%s" sourceName="w" unit="ms" startDate="2026-01-01 %s:00:00 +0000" endDate="2026-01-01 %s:01:00 +0000" value="%s"/>'
    with open(path, "w") as f:
        f.write("<HealthData>\n" + "\n".join(record % (m, h, h, v) for m, h, v in (
            (S.HRV, 10, 1), (S.HRV, 11, 2), (S.HRV, 11, 3), ("nothing", 12, 4))) + "\n</HealthData>")
    for _ in range(2):
        report = xml_export.import_into_store(spark, path, "me", root)
        assert dict(map(tuple, report.collect())) == {"ok": 3, "quarantined": 1}
        assert rows(tables.stored_samples(spark, root).select("value"), "value") == [(2.0,), (50.0,)]


def test_scratch_goes_to_the_shared_folder(spark):
    assert tables.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
