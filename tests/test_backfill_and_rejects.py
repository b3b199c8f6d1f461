"""Order of arrival, splits of XML files, resumed backfill, rejects and their replay."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.operators import daily, ingest
from pulseframe.sources import backfill, json_batches, manifest, rejects, tables, xml_export
from pulseframe.streaming import pipelines
from tests.conftest import rows

H = S.HRV


def sample(value, start="2026-01-01T10:00:00Z", metric=H):
    return {"metric_type": metric, "value": value, "unit": "ms", "source_device": "d", "started_at": start}


def write(path, name, *lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


def values(spark, path, **guards):
    judged = ingest.check_batches(json_batches.read_batches(spark, path, user_id="me"), **guards)
    return rows(ingest.latest_per_key(ingest.samples_of(judged, "batch_no")).select("value"), "value")


def test_of_lines_in_one_file_the_last_counts(spark, tmp_path):
    path = str(tmp_path / "a")
    write(path, "a.json", *({"samples": [sample(i)]} for i in range(200)))
    assert values(spark, path) == [(199.0,)]
    # files of one time: by name, then by line
    write(path, "b.json", {"samples": [sample(7)]}, {"samples": [sample(5), sample(6)]})
    for name in ("a", "b"):
        os.utime(f"{path}/{name}.json", (1_760_000_000, 1_760_000_000))
    assert values(spark, path) == [(6.0,)]
    os.utime(f"{path}/a.json", (1_760_000_001, 1_760_000_001))
    assert values(spark, path) == [(199.0,)]


def test_batches_of_any_length_keep_their_order(spark, tmp_path):
    """Place 12,000 of a batch comes before place 0 of the next one, and rejects name the right batch."""
    path = str(tmp_path / "a")
    first = {"user_id": "u", "batch_no": 3, "samples": [sample(i) for i in range(12_000)] + [sample(1, "never")]}
    write(path, "a.json", {"user_id": "u", "batch_no": 4, "samples": [sample(-1)]}, first)
    assert values(spark, path, max_samples=None) == [(-1.0,)]
    judged = ingest.check_batches(json_batches.read_batches(spark, path), max_samples=None)
    assert rows(ingest.rejects(judged, "batch_no").select("batch_no", "reason")) == [(3, "unreadable start")]
    write(path, "a.json", first)
    assert values(spark, path, max_samples=None) == [(11_999.0,)]


def test_one_file_is_many_tasks_and_reads_the_same(spark, tmp_path):
    path = str(tmp_path / "export.xml")
    odd = ("""<Record\n  type='%s' sourceName="a &gt; 'b' &amp; c" unit="ms" startDate="2026-01-02 10:00:00 +0100" value="1"/>"""
           """<Record type="%s" sourceName="x>y" unit="ms" startDate="2026-01-03 10:00:00 +0000" endDate="2026-01-03 10:05:00 +0000" value="2">"""
           """<MetadataEntry key="k" value="Record <type"/></Record><Recorder type="no"/>""").replace("Record <type", "Record &lt;type") % (H, H)
    with open(path, "w") as f:
        f.write('<?xml version="1.0"?>\n<!DOCTYPE HealthData [ <!ATTLIST Record type CDATA #REQUIRED> ]>\n<HealthData>\n' + odd)
        for i in range(20_000):
            f.write(f'  <Record type="{H}" sourceName="é{i}" unit="ms" startDate="2026-01-01 10:00:00 +0000" value="{i}"/>\n')
        f.write("<Workout/></HealthData>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        split, whole = xml_export.read_records_split(spark, path), xml_export.read_records(spark, path)
        assert split.rdd.getNumPartitions() > 8 and whole.rdd.getNumPartitions() == 1
        assert split.count() == 20_002 and split.drop("source_file").exceptAll(whole.drop("source_file")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows(split.filter("_value IN ('1', '2') AND _startDate > '2026-01-01 11'").select("_sourceName"), "_sourceName") == [
        ("a > 'b' & c",), ("x>y",)]


def test_a_backfill_goes_on_where_it_was_killed(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    s = make([("u", m, i, f"20{20 + i}-0{1 + i}-05 12:00") for i in range(4) for m in (H, S.STEPS)] + [("u", H, 9, "2020-01-05 12:00")])
    tables.publish(spark, root, s.limit(0), daily.daily_summary(s.limit(0)), buckets=1)
    real, calls = manifest._write_log, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("killed")
        return real(*args)

    monkeypatch.setattr(manifest, "_write_log", killed)
    with pytest.raises(OSError):
        backfill.run_backfill(spark, root, s)
    monkeypatch.setattr(manifest, "_write_log", real)
    done = backfill.finished(spark, root)
    assert len(done) == 4 and tables.stored_samples(spark, root).count() == 4
    loaded = backfill.run_backfill(spark, root, s, at_once=2)
    assert len(loaded) == 4 and not set(loaded) & done
    assert rows(tables.stored_samples(spark, root).select("metric_type", "value"), "metric_type", "value") == sorted(
        (m, float(i)) for i in range(4) for m in (H, S.STEPS))  # of equal keys the first
    version = tables.current_version(spark, root)
    assert backfill.run_backfill(spark, root, s) == [] and tables.current_version(spark, root) == version


def test_rejects_of_streams_are_kept_without_being_asked_for(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    write(landing, "1.json", {"user_id": "u", "batch_no": 1, "samples": [sample(1), sample(2, "never")]}, "{broken",
          {"user_id": "u", "batch_no": 2, "samples": [sample(i, f"2026-01-01T10:0{i}:00Z") for i in range(5)]})
    pipelines.upsert_batches(spark, landing, root, str(tmp_path / "cp"), max_samples=3)
    pipelines.ingest_batches(spark, landing, str(tmp_path / "sink"), str(tmp_path / "cp2"), max_samples=3)
    for path in (f"{root}-rejects", str(tmp_path / "sink-rejects")):
        assert sorted(r.reason for r in rejects.read(spark, path).collect()) == ["too many samples", "unreadable", "unreadable start"]
    found = rejects.read(spark, f"{root}-rejects")
    good, still = rejects.replay(found, lambda r: r.withColumn("content", F.replace("content", F.lit("never"), F.lit("2026-01-09T10:00:00Z"))))
    assert rows(good.select("user_id", "value"), "value") == [("u", float(v)) for v in (0, 1, 2, 2, 3, 4)]
    assert [(r.reason, r.content) for r in still.collect()] == [("unreadable", "{broken")]
    tables.upsert_into_tiers(spark, root, good)
    assert tables.stored_samples(spark, root).count() == 6  # one key was there


def test_an_import_quarantines_with_reason_and_place(spark, make, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "export.xml")
    s = make([("me", H, 50, "2026-01-01 10:00")])
    tables.publish(spark, root, s, daily.daily_summary(s.limit(0)))
    record = '<Record type="%s" sourceName="w" unit="ms" startDate="%s" value="%s"/>'
    with open(path, "w") as f:
        f.write("<HealthData>" + record % ("nothing", "2026-01-01 11:00:00 +0000", 1) + record % (H, "soon", "2")
                + record % (S.SLEEP, "soon", "HKCategoryValueSleepAnalysisAsleepREM") + "</HealthData>")
    for _ in range(2):
        assert dict(map(tuple, xml_export.import_into_store(spark, path, "me", root).collect())) == {"quarantined": 3}
    found = tables.rejected(spark, root)
    assert sorted(r.reason for r in found.collect()) == ["no valid metric", "unreadable start", "unreadable start"]
    assert all(r.place.endswith("export.xml") and r.user_id == "me" and r.source == "xml" for r in found.collect())
    good, still = rejects.replay(found, lambda r: r.withColumn("content", F.replace("content", F.lit("soon"), F.lit("2026-01-05 10:00:00 +0100"))))
    assert rows(good.select("metric_type", "value", F.date_format("started_at", "HH:mm")), "metric_type") == [
        (S.SLEEP, 5.0, "09:00"), (H, 2.0, "09:00")]
    assert [r.reason for r in still.collect()] == ["no valid metric"]
