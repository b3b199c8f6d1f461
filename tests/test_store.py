"""The versioned store: manifests, deltas and their rules, folding, writers at once, late rows of dropped days."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.operators import daily, retention
from pulseframe.sources import manifest, tables
from tests.conftest import at, rows

H = S.HRV


def empty_summaries(s, tz=S.DEFAULT_TZ):
    return daily.daily_summary(s.filter(F.lit(False)), tz)


def values(spark, root):
    return {(r.user_id, r.started_at): r.value for r in tables.stored_samples(spark, root).collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def in_force(spark, root):
    return manifest.current(spark, root).directories


def test_a_read_is_given_the_directories_in_force_only(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([(f"u{i}", m, i, f"2024-0{1 + i % 3}-05 12:00") for i in range(30) for m in (H, S.STEPS)])
    tables.publish(spark, root, s, empty_summaries(s))
    first = sorted(tables.stored_samples(spark, root).inputFiles())
    for k in range(3):
        tables.upsert_into_tiers(spark, root, make([("u1", H, 50 + k, "2024-02-05 12:00")]))
    files = tables.stored_samples(spark, root).inputFiles()
    listed = {d.path(root) for d in in_force(spark, root) if d.tier == "samples"}
    assert {f.removeprefix("file://").rsplit("/", 1)[0] for f in files} == listed
    assert len(files) == len(first) + 3  # one new row writes one file
    assert set(tables.open_tiers(spark, root)[0].inputFiles()) == set(files)
    assert tables.vacuum(spark, root) and sorted(tables.stored_samples(spark, root).inputFiles()) == sorted(files)


def test_many_upserts_read_as_much_as_one(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([(f"u{i}", H, i, "2024-01-05 12:00") for i in range(40)])
    tables.publish(spark, root, s, empty_summaries(s), buckets=2)
    new = make([("u1", H, 7, "2024-01-05 12:00")])
    for _ in range(20):
        tables.upsert_into_tiers(spark, root, new)
    deltas = [d for d in in_force(spark, root) if d.delta]
    assert len(deltas) <= tables.MOST_DELTAS  # folded on the way
    tables.compact(spark, root)
    assert not any(d.delta for d in in_force(spark, root))
    assert len(tables.stored_samples(spark, root).inputFiles()) == 2
    number = tables.current_version(spark, root)
    assert tables.compact(spark, root) == number  # nothing to fold
    assert values(spark, root)["u1", at("2024-01-05 12:00").replace(tzinfo=None)] == 7 and tables.stored_samples(spark, root).count() == 40


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_deltas_equal_a_plain_model(spark, tmp_path, monkeypatch, seed):
    """Deliveries under changing rules, in buckets that are folded now and then."""
    monkeypatch.setattr(tables, "MOST_DELTAS", 3)
    rng, root, model, seq = random.Random(seed), str(tmp_path / "r"), {}, 0

    def delivery(many):
        nonlocal seq
        out = []
        for _ in range(many):
            seq += 1
            own = rng.choice([seq, seq, rng.randrange(1, 200)]) * 1000 + seq
            out.append((f"u{rng.randrange(4)}", H, float(seq), "ms", "d", at(f"2024-0{rng.randrange(1, 3)}-01 1{rng.randrange(3)}:00"),
                        None, None, own))
        return out

    def frame(data):
        return spark.createDataFrame(data, S.SAMPLES).repartition(3)

    first = {r[0:2] + (r[5],): r for r in delivery(6)}
    tables.publish(spark, root, frame(list(first.values())), empty_summaries(frame(list(first.values()))), buckets=2)
    model = {k: (r[2], r[8]) for k, r in first.items()}
    for _ in range(7):
        rule, new = rng.choice(["last", "last", "seq", "seq", "first"]), delivery(rng.randrange(1, 8))
        best = {}
        for r in sorted(new, key=lambda r: r[8], reverse=rule == "first"):
            best[r[0:2] + (r[5],)] = (r[2], r[8])
        for k, r in best.items():
            if k not in model or rule == "last" or (rule == "seq" and r[1] >= model[k][1]):
                model[k] = r
        if rule == "first":
            tables.insert_into_tiers(spark, root, frame(new))
        else:
            tables.upsert_into_tiers(spark, root, frame(new), by_seq=rule == "seq")
    want = {(u, t.replace(tzinfo=None)): v for (u, _, t), (v, _) in model.items()}
    assert values(spark, root) == want
    tables.compact(spark, root)
    assert values(spark, root) == want


def test_metrics_with_odd_names_are_found_again(spark, make, tmp_path):
    root = str(tmp_path / "r")
    names = [S.QUANTITY_PREFIX + "A/b", "x=y%20 z", "{a,b}*[c]", "plain"]
    s = make([("u", n, i, "2024-01-05 12:00") for i, n in enumerate(names)])
    tables.publish(spark, root, s, empty_summaries(s))
    tables.upsert_into_tiers(spark, root, make([("u", n, 10 + i, "2024-01-05 12:00") for i, n in enumerate(names)]))
    assert dict(map(tuple, tables.stored_samples(spark, root).select("metric_type", "value").collect())) == {
        n: 10.0 + i for i, n in enumerate(names)}


def test_two_writers_lose_no_row(spark, make, tmp_path, monkeypatch):
    """A second writer commits just before the first one does, once elsewhere and once in the same bucket."""
    root = str(tmp_path / "r")
    s = make([("u", H, 1, "2024-01-05 12:00")])
    tables.publish(spark, root, s, empty_summaries(s))
    real, built = manifest.commit, []

    def interleaved(other):
        def commit(*args):
            monkeypatch.setattr(manifest, "commit", real)
            tables.upsert_into_tiers(spark, root, other)
            return real(*args)

        monkeypatch.setattr(manifest, "commit", commit)

    change = tables.Delivery.change
    monkeypatch.setattr(tables.Delivery, "change", lambda self, entry: built.append(entry.number) or change(self, entry))
    interleaved(make([("u", S.STEPS, 5, "2024-03-05 12:00")]))
    assert tables.upsert_into_tiers(spark, root, make([("u", H, 2, "2024-01-06 12:00")])) == 3
    assert built == [1, 1]  # the change was put on top as it was
    interleaved(make([("u", H, 30, "2024-01-05 12:00"), ("u", H, 40, "2024-01-07 12:00")]))
    assert tables.upsert_into_tiers(spark, root, make([("u", H, 3, "2024-01-05 12:00")])) == 5
    assert built[2:] == [3, 3, 4]  # built again on the other's version
    assert rows(tables.stored_samples(spark, root).select("value"), "value") == [(2.0,), (3.0,), (5.0,), (40.0,)]


def test_a_log_file_is_never_replaced(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u", H, 1, "2024-01-05 12:00")])
    tables.publish(spark, root, s, empty_summaries(s))
    entry = manifest.current(spark, root)
    assert manifest._write_log(spark, root, entry.number, {"manifest": "other"}) is False
    assert manifest.current(spark, root) == entry


ZONES = ["Asia/Tokyo", "America/Los_Angeles", "America/New_York", "Pacific/Kiritimati"]


@pytest.mark.parametrize("tz", ZONES)
def test_late_rows_after_a_drop_count_once_as_if_nothing_was_dropped(spark, make, tmp_path, tz):
    """Rows around the edges of months, in hours that are in another month for UTC."""
    early = [("u", H, v, t) for v, t in (
        (10, "2024-01-31 16:00"), (20, "2024-02-01 03:00"), (30, "2024-02-01 14:00"), (1.00004, "2024-01-10 12:00"),
        (2, "2024-02-20 12:00"), (5, "2024-03-20 12:00"))] + [("u", S.SLEEP, 3, "2024-01-10 05:00", "2024-01-10 06:00")]
    late = make([("u", H, v, t) for v, t in (
        (40, "2024-02-01 15:00"), (41, "2024-02-01 00:30"), (1.00004, "2024-01-10 13:00"), (7, "2023-12-31 23:30"),
        (9, "2024-02-20 13:00"), (6, "2024-03-20 13:00"))] + [("v", H, 8, "2024-01-31 20:00"), ("u", S.SLEEP, 4, "2024-01-11 05:00")])
    seen = []
    for drop in (True, False):
        root = str(tmp_path / f"r{drop}")
        s = make(early)
        tables.publish(spark, root, s, empty_summaries(s, tz))
        retention.run_retention(spark, root, "2024-03-14", 30, tz, drop=drop)
        for _ in range(2):
            tables.upsert_into_tiers(spark, root, late)
            samples, summaries = tables.open_tiers(spark, root)
            points = daily.daily_quantity_view(samples, summaries, tz).drop("unit")
            seen.append((rows(points, "user_id", "day"), rows(samples.select("value"), "value")))
    assert seen[0] == seen[1] == seen[2] == seen[3]
    assert tables.current_version(spark, str(tmp_path / "rTrue")) == 5


def test_a_second_drop_and_known_keys(spark, make, tmp_path):
    root, tz = str(tmp_path / "r"), "Asia/Tokyo"
    s = make([("u", H, i, f"2024-0{m}-{d:02d} 20:00") for i, (m, d) in enumerate([(1, 5), (1, 31), (2, 1), (2, 28), (3, 1), (3, 30)])])
    tables.publish(spark, root, s, empty_summaries(s, tz))
    for as_of in ("2024-03-14", "2024-04-20"):
        retention.run_retention(spark, root, as_of, 30, tz, drop=True)
    assert tables._entry(spark, root).settings["dropped_before"] == "2024-03-02"
    known = make([("u", H, 99, "2024-01-05 20:00"), ("u", H, 99, "2024-02-01 20:00")])
    before = rows(tables.open_tiers(spark, root)[1], "date")
    tables.upsert_into_tiers(spark, root, known)
    assert rows(tables.open_tiers(spark, root)[1], "date") == before
    found = tables.rejected(spark, root).selectExpr("substr(get_json_object(content, '$.started_at'), 1, 10) AS day", "reason")
    assert rows(found, "day") == [("2024-01-05", "already counted"), ("2024-02-01", "already counted")]


def test_the_ledger_is_folded_and_still_knows_its_keys(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u", H, 1, "2024-01-05 12:00"), ("u", H, 2, "2024-03-30 12:00")])
    tables.publish(spark, root, s, empty_summaries(s), buckets=1)
    retention.run_retention(spark, root, "2024-04-20", 30, drop=True)
    late = [make([("u", H, v, f"2024-01-05 1{v}:30")]) for v in (3, 4, 5)]
    for new in late:
        tables.upsert_into_tiers(spark, root, new)
    tables.compact(spark, root)
    assert len([d for d in in_force(spark, root) if d.tier == "ledger"]) == 1
    number = tables.current_version(spark, root)
    assert tables.compact(spark, root) == number
    for new in late:
        tables.upsert_into_tiers(spark, root, new)
    assert rows(tables.open_tiers(spark, root)[1].select("sum_value", "sample_count")) == [(13.0, 4)]
    assert tables.rejected(spark, root).count() == 3


def test_a_late_null_takes_a_day_away(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u", H, 10, "2024-01-05 12:00"), ("u", H, 5, "2024-01-06 12:00"), ("u", H, 1, "2024-03-15 12:00")])
    tables.publish(spark, root, s, empty_summaries(s))
    retention.run_retention(spark, root, "2024-03-20", 10)
    tables.upsert_into_tiers(spark, root, make([("u", H, None, "2024-01-05 12:00")]))
    assert rows(tables.open_tiers(spark, root)[1].select("date", "sum_value")) == [(dt.date(2024, 1, 6), 5.0)]


def test_the_first_whole_day_of_a_month():
    assert {z: str(tables.first_whole_day("2024-03", z)) for z in ZONES} == {
        "Asia/Tokyo": "2024-03-02", "America/Los_Angeles": "2024-03-01", "America/New_York": "2024-03-01",
        "Pacific/Kiritimati": "2024-03-02"}


def test_large_deltas_are_not_broadcast(spark, make, tmp_path):
    """Their files are small beside their rows, which Spark's size check does not see."""
    root = str(tmp_path / "r")
    s = make([("u1", H, 1, "2024-01-05 12:00")])
    tables.publish(spark, root, s, empty_summaries(s), buckets=1)
    many = spark.range(tables.FEW + 1).select(
        F.lit("u2").alias("user_id"), F.lit(H).alias("metric_type"), F.lit(1.0).alias("value"), F.lit("u").alias("unit"),
        F.lit("Ring").alias("source_device"), F.timestamp_seconds(F.lit(1_704_456_000) + F.col("id")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("string").alias("metadata"), F.col("id").alias("seq"))
    tables.upsert_into_tiers(spark, root, many.limit(10))
    assert "BroadcastHashJoin" in plan(tables.stored_samples(spark, root))
    tables.upsert_into_tiers(spark, root, many)
    assert {d.rows for d in in_force(spark, root) if d.tier == "samples"} == {1, 10, tables.FEW + 1}
    assert "BroadcastHashJoin" not in plan(tables.stored_samples(spark, root))
    assert tables.stored_samples(spark, root).count() == tables.FEW + 2


def test_manifests_without_row_counts_are_read(spark, make, tmp_path):
    root = str(tmp_path / "r")
    s = make([("u1", H, 1, "2024-01-05 12:00")])
    tables.publish(spark, root, s, empty_summaries(s), buckets=1)
    tables.upsert_into_tiers(spark, root, make([("u1", H, 2, "2024-01-05 12:00")]))
    (path,) = [p for p in (tmp_path / "r" / manifest.MANIFESTS).iterdir() if p.name == manifest.current(spark, root).settings["manifest"]]
    lines = [json.loads(x)[:-1] for x in path.read_text().splitlines()]
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    path.with_name(f".{path.name}.crc").unlink()
    assert {d.rows for d in in_force(spark, root)} == {None}
    assert list(values(spark, root).values()) == [2]
