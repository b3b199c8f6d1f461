import datetime as dt
import random

from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.functions.time import days_before
from pulseframe.operators import daily, retention, stats
from tests.conftest import rows

POINT = ("user_id", "metric_type", "date", "avg_value", "min_value", "max_value", "sum_value", "sample_count")
AS_OF = dt.date(2024, 3, 20)


def history(make, seed=7, n=600):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        when = start + dt.timedelta(minutes=rnd.randrange(0, 80 * 1440))
        out.append((rnd.choice("ab"), rnd.choice([S.HRV, S.STEPS, S.SLEEP]), rnd.choice([None, rnd.randrange(0, 9999) / 100]),
                    when.isoformat(sep=" ")))
    return make(out)


def test_nulls_are_skipped(make):
    df = make([("u", S.HRV, 10, "2024-01-01 12:00"), ("u", S.HRV, None, "2024-01-01 13:00"),
               ("u", S.HRV, 0, "2024-01-01 14:00"), ("u", S.HRV, None, "2024-01-02 13:00")])
    assert rows(daily.daily_from_raw(df).select(*POINT[2:])) == [(dt.date(2024, 1, 1), 5.0, 0.0, 10.0, 10.0, 2)]


def test_rounding_is_half_up_whatever_the_order(make):
    base = [("u", S.HRV, v, f"2024-01-01 12:{i:02d}") for i, v in enumerate([0.1] * 7 + [0.31])]
    first = rows(daily.daily_from_raw(make(base)).select("avg_value"))
    assert first == [(0.1263,)]  # 1.01 / 8 = 0.12625
    assert rows(daily.daily_from_raw(make(base[::-1]).repartition(5)).select("avg_value")) == first


def test_retention_changes_no_daily_value(make):
    """Moving days between the tiers leaves the unified series as it was."""
    s = history(make)
    whole = rows(daily.daily_from_raw(s.filter(~F.col("metric_type").startswith(S.CATEGORY_PREFIX))).select(*POINT), *POINT[:3])
    for raw_days in (1, 30, 70):
        plan = retention.retain(s, None, AS_OF, raw_days)
        assert rows(daily.daily_quantity_view(plan.samples, plan.summaries).withColumnRenamed("day", "date").select(*POINT), *POINT[:3]) == whole
        tiered = daily.tiered_daily(plan.samples.filter(~F.col("metric_type").startswith(S.CATEGORY_PREFIX)), plan.summaries, AS_OF, 400, days_before(AS_OF, raw_days))
        assert rows(tiered.select(*POINT), *POINT[:3]) == whole


def test_retention_in_steps_equals_one_run(make):
    s = history(make)
    once = retention.retain(s, None, AS_OF, 20)
    first = retention.retain(s, None, AS_OF - dt.timedelta(days=15), 20)
    second = retention.retain(first.samples, first.summaries, AS_OF, 20)
    cols = (*POINT, "unit")
    assert rows(second.summaries.select(*cols), *POINT[:3]) == rows(once.summaries.select(*cols), *POINT[:3])
    again = retention.retain(second.samples, second.summaries, AS_OF, 20)
    assert rows(again.summaries.select(*cols), *POINT[:3]) == rows(once.summaries.select(*cols), *POINT[:3])
    assert again.report.count() == 0
    assert second.samples.filter(F.col("metric_type") == S.SLEEP).count() == s.filter(F.col("metric_type") == S.SLEEP).count()


def test_a_late_sample_is_merged_into_its_summary(make):
    early = make([("u", S.HRV, 10, "2024-01-01 12:00"), ("u", S.HRV, 20, "2024-01-01 13:00")])
    late = make([("u", S.HRV, 60, "2024-01-01 14:00")])
    old = retention.retain(early, None, AS_OF, 30).summaries
    merged = retention.retain(late, old, AS_OF, 30).summaries
    assert rows(merged.select(*POINT[3:])) == [(30.0, 10.0, 60.0, 90.0, 3)]


def test_raw_wins_on_the_shared_day(make, spark):
    s = make([("u", S.HRV, 50, "2024-02-19 12:00"), ("u", S.HRV, 60, "2024-03-01 12:00")])
    old = daily.daily_summary(make([("u", S.HRV, 1, "2024-02-18 12:00"), ("u", S.HRV, 2, "2024-02-19 12:00"),
                                    ("v", S.HRV, 3, "2024-02-19 12:00")]))
    got = rows(daily.series_range(s, old, "2024-01-01", AS_OF, days_before(AS_OF, 30)).select("user_id", "date", "avg_value", "source"), "user_id", "date")
    assert got == [("u", dt.date(2024, 2, 18), 1.0, "summary"), ("u", dt.date(2024, 2, 19), 50.0, "raw"),
                   ("u", dt.date(2024, 3, 1), 60.0, "raw"), ("v", dt.date(2024, 2, 19), 3.0, "summary")]


def test_ranges_wholly_in_one_tier(make):
    s = make([("u", S.HRV, 50, "2024-03-01 12:00")])
    old = daily.daily_summary(make([("u", S.HRV, 1, "2024-01-18 12:00")]))
    assert daily.series_range(s, old, "2024-01-01", "2024-01-31", days_before(AS_OF, 30)).count() == 1
    assert daily.series_range(s, old, "2024-02-25", "2024-03-10", days_before(AS_OF, 30)).count() == 1
    assert daily.series_range(s, None, "2024-01-01", "2024-01-31", days_before(AS_OF, 30)).count() == 0


def test_without_a_cut_all_raw_rows_count_and_summaries_fill_the_rest(make):
    s = make([("u", S.HRV, i, f"2024-0{1 + i // 28}-{1 + i % 28:02d} 12:00") for i in range(60)])
    assert daily.tiered_daily(s, None, AS_OF, 90).count() == 60
    old = daily.daily_summary(make([("u", S.HRV, 500, "2024-01-05 12:00"), ("u", S.HRV, 600, "2023-12-31 12:00")]))
    got = daily.tiered_daily(s, old, AS_OF, 90)
    assert got.count() == 61 and rows(got.filter("source = 'summary'").select("avg_value")) == [(600.0,)]


def test_weighted_mean_is_the_mean_of_the_samples(make):
    s = history(make).filter(F.col("metric_type") == S.HRV)
    points = daily.daily_from_raw(s)
    got = dict(rows(points.groupBy("user_id").agg(stats.weighted_mean())))
    want = {}
    for user, value in rows(s.select("user_id", "value")):
        if value is not None:
            want.setdefault(user, []).append(value)
    assert all(abs(got[u] - sum(v) / len(v)) <= 0.005 + 1e-9 for u, v in want.items())


def test_dry_run_names_what_stays(make):
    got = dict(rows(retention.dry_run(history(make), AS_OF, 10).select("metric_type", "action")))
    assert got == {S.HRV: "summarise", S.STEPS: "summarise", S.SLEEP: "keep raw"}
