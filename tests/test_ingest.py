import random

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.functions import metrics as m
from pulseframe.operators import hygiene, ingest, scans, workouts
from pulseframe.sources import json_batches, xml_export
from tests.conftest import at, rows


def sample(metric="HKQuantityTypeIdentifierStepCount", value=1.0, unit="count", device="Watch", start="2026-01-01T10:00:00.000Z",
           end=None, metadata=None):
    return (metric, value, unit, device, start, end, metadata)


@pytest.fixture
def batches(spark):
    def build(*lists):
        return spark.createDataFrame([("u", i, list(b) if b is not None else None, None) for i, b in enumerate(lists)],
                                     json_batches.BATCH_FILES)
    return build


def test_guards(batches):
    got = ingest.check_batches(batches(
        None, [], [sample()], [sample()] * 1000, [sample()] * 1001, [sample(device="x" * 256)], [sample(device="x" * 257)],
        [sample(unit="x" * 257)], [sample(metric="x" * 257)], [sample(unit=None, device=None)]))
    assert rows(got.select("sample_count", "verdict"), "batch_no") == [
        (0, "empty"), (0, "empty"), (1, "accepted"), (1000, "accepted"), (1001, "too many samples"), (1, "accepted"),
        (1, "string too long"), (1, "string too long"), (1, "string too long"), (1, "accepted")]


def test_one_instant_written_two_ways_is_one_sample(batches):
    b = ingest.check_batches(batches([
        sample(value=1.0, start="2026-07-01T10:00:00.000Z"), sample(value=2.0, start="2026-07-01T06:00:00-04:00"),
        sample(value=3.0, start="2026-07-01T06:00:00.001-04:00"), sample(value=9.0, start="not a time")]))
    got = ingest.dedupe_batch(ingest.samples_of(b, "batch_no"))
    assert rows(got.select("value"), "value") == [(2.0,), (3.0,)]
    assert rows(ingest.rejected_samples(b, "batch_no").select("value")) == [(9.0,)]


def test_json_text_with_nulls_and_metadata(spark):
    text = '{"samples":[{"metric_type":"M","value":null,"unit":"u","source_device":"d","started_at":"2026-01-01T00:00:00Z","metadata":{"a":1,"b":"x"}}]}'
    df = json_batches.parse_batches(spark.createDataFrame([("u", 1, text), ("u", 2, "{broken")], "user_id string, batch_no long, payload string"))
    got = rows(ingest.samples_of(ingest.check_batches(df), "batch_no").select("metric_type", "value", "metadata"))
    assert got == [("M", None, '{"a":1,"b":"x"}')]


def test_conflict_rules(make):
    old = make([("u", S.HRV, 1, "2024-01-01 12:00"), ("u", S.HRV, 2, "2024-01-02 12:00")])
    new = make([("u", S.HRV, 20, "2024-01-02 12:00"), ("u", S.HRV, 21, "2024-01-02 12:00"),
                ("u", S.HRV, 30, "2024-01-03 12:00"), ("u", S.HRV, 31, "2024-01-03 12:00")])
    up = ingest.upsert_latest(old, new)
    assert rows(up.select("value"), "started_at") == [(1.0,), (21.0,), (31.0,)]
    assert rows(ingest.upsert_latest(up, new).select("value"), "started_at") == [(1.0,), (21.0,), (31.0,)]
    assert rows(ingest.insert_ignore(old, new).select("value")) == [(30.0,)]
    assert rows(ingest.first_per_key(new).select("value"), "started_at") == [(20.0,), (30.0,)]
    wide = (*S.SAMPLE_KEY, "source_device")
    two = make([("u", S.HRV, 1, "2024-01-01 12:00", None, "Watch"), ("u", S.HRV, 2, "2024-01-01 12:00", None, "Ring")])
    assert ingest.latest_per_key(two).count() == 1 and ingest.latest_per_key(two, wide).count() == 2


def test_dedupe_does_not_depend_on_row_order_or_a_hot_key(make):
    rnd = random.Random(5)
    data = [("u", S.HRV, i, "2024-01-01 12:00") for i in range(300)] + [
        (rnd.choice("abc"), S.HRV, 1000 + i, f"2024-01-01 1{rnd.randrange(10)}:00") for i in range(600)]
    df = make(data)
    want = {}
    for i, (user, metric, value, start) in enumerate(data):
        want[(user, start)] = float(value)
    for parts in (1, 7):
        got = ingest.latest_per_key(df.orderBy(F.rand(parts)).repartition(parts))
        assert {(r["user_id"], r["started_at"].isoformat(" ")[:16]): r["value"] for r in got.collect()} == want


def test_metric_guards(spark):
    names = ["HKQuantityTypeIdentifierVO2Max", "HKQuantityTypeIdentifierDietaryVitaminB12", "HKWorkoutTypeIdentifier",
             "HKDataTypeSleepDurationGoal", "HKClinicalTypeIdentifierX", "x; DROP TABLE", ""]
    df = spark.createDataFrame([(n,) for n in names], "metric_type string")
    got = {r[0]: r[1:] for r in df.select("metric_type", m.is_valid_metric(), m.is_importable(), m.metric_kind()).collect()}
    assert got["HKQuantityTypeIdentifierVO2Max"] == (True, True, "quantity")
    assert got["HKQuantityTypeIdentifierDietaryVitaminB12"] == (True, True, "quantity")
    assert got["HKWorkoutTypeIdentifier"] == (False, False, "workout")
    assert not got["HKDataTypeSleepDurationGoal"][1] and not got["HKClinicalTypeIdentifierX"][1]
    assert not got["x; DROP TABLE"][0] and not got[""][0]


def test_source_filter_text_is_checked(make):
    df = make([("u", S.HRV, 1, "2024-01-01 12:00", None, "Oura Ring"), ("u", S.HRV, 2, "2024-01-01 13:00", None, "Watch")])
    assert df.filter(scans.source_matches("oura")).count() == 1
    for bad in ("", "x" * 65, "a%b", "o'r"):
        with pytest.raises(ValueError):
            scans.source_matches(bad)


def test_stage_names_round_trip(spark):
    df = spark.range(7).select(F.col("id").cast("double").alias("c"))
    got = rows(df.select("c", m.stage_code(m.stage_identifier("c")), m.stage_name("c")), "c")
    assert got == [(0.0, 0.0, None), (1.0, 1.0, None), (2.0, 2.0, "Awake"), (3.0, 3.0, "Core"), (4.0, 4.0, "Deep"),
                   (5.0, 5.0, "REM"), (6.0, None, None)]


def test_normalised_metadata_keeps_types_and_own_keys(spark):
    schema = ("user_id string, metric_type string, value double, unit string, device_name string, source_name string, started_at timestamp, "
              "ended_at timestamp, metadata string, workout_type string, duration_seconds double, distance_m double, energy_kcal double, strokes double, flights double")
    t = at("2024-01-01 12:00")
    none = (None,) * 6
    df = spark.createDataFrame([
        ("u", S.SLEEP, 4.0, "x", None, "Phone", t, t, '{"n":1.5,"ok":true,"sleep_stage":"old"}', *none),
        ("u", S.WORKOUT, None, None, "Watch", "Phone", t, t, None, "Run", 60.0, None, 7.25, None, None),
        ("u", S.HRV, 5.0, "ms", None, "Phone", t, t, "not json", *none)], schema)
    got = {r["metric_type"]: r for r in ingest.normalise_samples(df).collect()}
    assert got[S.SLEEP]["metadata"] == '{"n":1.5,"ok":true,"sleep_stage":"HKCategoryValueSleepAnalysisAsleepDeep"}'
    assert (got[S.SLEEP]["unit"], got[S.SLEEP]["source_device"]) == ("category", "Phone")
    w = got[S.WORKOUT]
    assert (w["value"], w["unit"], w["source_device"]) == (60.0, "seconds", "Watch")
    assert '"total_energy_burned_cal":7.25' in w["metadata"] and "distance" not in w["metadata"]
    assert got[S.HRV]["metadata"] == "not json"


def test_units(spark):
    q = S.QUANTITY_PREFIX
    df = spark.createDataFrame([(q + "BodyTemperature", 98.6, "degF"), (q + "BodyMass", 100.0, "lb"), (q + "BloodGlucose", 5.0, "mmol<180.15588000005408>/L"),
                                (q + "NewThing", 2.0, "km"), (q + "HeartRate", 3.0, "furlong"), (q + "OxygenSaturation", 0.94, "%"),
                                (q + "HeartRate", 2.0, None)], "metric_type string, value double, unit string")
    got = {(r["metric_type"][len(q):], r["unit"]): (None if r["value"] is None else round(r["value"], 3), r["unit_status"]) for r in ingest.normalise_units(df).collect()}
    assert got == {("BodyTemperature", "degC"): (37.0, "preferred"), ("BodyMass", "kg"): (45.359, "preferred"),
                   ("BloodGlucose", "mg/dL"): (90.078, "preferred"), ("NewThing", "m"): (2000.0, "fallback"),
                   ("HeartRate", "unsupported"): (None, "unsupported"), ("OxygenSaturation", "%"): (0.94, "preferred")}


def test_workout_names(spark):
    df = spark.createDataFrame([("HKWorkoutActivityTypeTaiChi",), ("HKWorkoutActivityTypeNope",)], "raw_name string")
    assert dict(rows(workouts.with_display_name(df).select("raw_name", "display_name"))) == {
        "HKWorkoutActivityTypeTaiChi": "TaiChi", "HKWorkoutActivityTypeNope": "Unknown"}
    assert len(m.WORKOUT_NAMES) == len(set(m.WORKOUT_NAMES)) == 82


def test_streaks(make):
    days = ["01", "02", "03", "05", "06", "07", "08", "09", "12"]
    s = make([("u", S.WORKOUT, 60, f"2024-01-{d} 17:0{i}") for d in days for i in (0, 1)])
    assert rows(workouts.streaks(workouts.workouts(s), 5).select("first_day", "days"))[0][1] == 5
    assert workouts.streaks(workouts.workouts(s), 3).count() == 2


def test_contacts(spark):
    t = at("2024-01-01 12:00")
    long = "a" * 243 + "@example.com"
    df = spark.createDataFrame([(" A@B.co ", t), ("a@b.CO", at("2024-01-02 12:00")), ("nope", t), ("a@b", t), ("a b@c.de", t), (long, t),
                                ("a" + long[:242] + "@example.com", t)], "email string, created_at timestamp")
    got = {r["email"]: (r["created_at"], r["signups"]) for r in hygiene.contact_hygiene(df).collect()}
    assert set(got) == {"a@b.co"} | {e for e in (long,) if len(e) <= 254}
    assert got["a@b.co"][1] == 2


XML = """<?xml version="1.0"?>
<HealthData>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="{long}" unit="count" startDate="2026-01-01 10:00:00 -0500" endDate="2026-01-01 10:05:00 -0500" value="120"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Ring" startDate="2026-01-01 10:00:00 +0000" endDate="" value="HKCategoryValueSleepAnalysisAsleepREM">
  <MetadataEntry key="k" value="v"/>
 </Record>
 <Record type="HKQuantityTypeIdentifierVO2Max" unit="ml" startDate="2026-01-01 10:00:00 +0000" value="n/a"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" startDate="last week" value="60"/>
 <Record type="HKWorkoutTypeIdentifier" startDate="2026-01-01 10:00:00 +0000" value="60"/>
 <Record type="bad type" startDate="2026-01-01 10:00:00 +0000" value="60"/>
</HealthData>"""


def test_xml_edges(spark, tmp_path):
    (tmp_path / "export.xml").write_text(XML.format(long="w" * 300))
    out = xml_export.normalise_records(xml_export.read_records(spark, str(tmp_path)), "me")
    got = {r["metric_type"]: r for r in out.collect()}
    steps = got["HKQuantityTypeIdentifierStepCount"]
    assert (steps["value"], len(steps["source_device"]), steps["started_at"].isoformat()) == (120.0, 256, "2026-01-01T15:00:00")
    assert got[S.SLEEP]["value"] == 5.0 and got[S.SLEEP]["ended_at"] is None
    assert got[S.VO2MAX]["value"] is None and got[S.VO2MAX]["import_status"] == "ok"
    assert dict(rows(xml_export.import_report(out))) == {"ok": 3, "skipped": 1, "quarantined": 2}
