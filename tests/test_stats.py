import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.operators import daily, stats, trends
from pulseframe.plans import tools
from tests.conftest import rows


def series(make, values, metric=S.HRV, user="u", start=dt.date(2024, 1, 1)):
    return daily.daily_from_raw(make([(user, metric, v, f"{start + dt.timedelta(days=i)} 17:00") for i, v in enumerate(values)]))


def linear(values, p):
    v = sorted(values)
    x = p * (len(v) - 1)
    lo, hi = math.floor(x), math.ceil(x)
    return v[lo] + (v[hi] - v[lo]) * (x - lo)


@pytest.mark.parametrize("values", [[42.0], [40.0, 50.0], [random.Random(1).randrange(100, 9000) / 100 for _ in range(61)]])
def test_percentiles_interpolate(make, values):
    r = stats.metric_stats(series(make, values)).first()
    for name, p in (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9)):
        assert abs(r[name] - linear(values, p)) <= 0.005 + 1e-9
    mean = sum(values) / len(values)
    assert abs(r["std_dev"] - math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))) <= 0.005 + 1e-9
    assert (r["good_day_above"], r["poor_day_below"]) == (r["p75"], r["p25"])


@pytest.mark.parametrize("n, want", [(13, None), (14, 7.0)])
def test_trend_needs_fourteen_days(make, n, want):
    r = trends.week_over_week(series(make, list(range(1, n + 1)))).first()
    assert (r["delta"], r["direction"]) == (want, "improving" if want else None)


@pytest.mark.parametrize("lift, tolerance, want", [(0, 0, "stable"), (2, 2, "stable"), (2, 0, "improving"),
                                                   (-2, 2, "stable"), (-2.1, 2, "declining")])
def test_trend_direction(make, lift, tolerance, want):
    points = series(make, [50.0] * 7 + [50.0 + lift] * 7)
    assert trends.week_over_week(points, tolerance).first()["direction"] == want


def test_trend_counts_days_with_data_not_calendar_days(make, spark):
    gap = series(make, [10.0] * 7).unionByName(series(make, [30.0] * 7, start=dt.date(2024, 3, 1)))
    assert trends.week_over_week(gap).first()["delta"] == 20.0


def test_kind_decides_between_total_and_mean(make):
    s = make([("u", m, v, f"2024-01-0{d} 17:0{i}") for m in (S.STEPS, S.HRV) for d in (1, 2) for i, v in enumerate((10, 20))])
    got = dict(rows(stats.kind_averages(daily.daily_from_raw(s)).select("metric_type", "avg")))
    assert got == {S.STEPS: 30.0, S.HRV: 15.0}


def test_search_bounds_are_inclusive_and_sorted(make):
    points = series(make, [5, 10, 15, 20, 25])
    got = rows(stats.search_records(points, 10, 20).select("value"))
    assert sorted(got) == [(10.0,), (15.0,), (20.0,)]
    assert sorted(rows(stats.search_records(points, 10, 25, limit=2).select("value"))) == [(20.0,), (25.0,)]
    assert sorted(rows(stats.search_records(points, limit=2, ascending=True).select("value"))) == [(5.0,), (10.0,)]
    c = stats.search_counts(points, 10, 20).first()
    assert (c["days_searched"], c["days_matched"]) == (5, 3)


def test_compare_periods_edges(make):
    points = series(make, [0, 0, 4, 6])
    r = stats.compare_periods(points, ("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), "x" * 40, "b").first()
    assert (r["a_avg"], r["b_avg"], r["delta"], r["pct_change"]) == (0.0, 5.0, 5.0, None)
    assert r["verdict"] == "b is higher than " + "x" * 32
    r = stats.compare_periods(points, ("2024-01-01", "2024-01-02"), ("2025-01-03", "2025-01-04")).first()
    assert (r["b_points"], r["b_avg"], r["verdict"]) == (0, None, "insufficient data")
    r = stats.compare_periods(points, ("2024-01-03", "2024-01-04"), ("2024-01-03", "2024-01-04"), "a", "b").first()
    assert r["verdict"] == "b is the same than a"
    with pytest.raises(ValueError):
        stats.compare_periods(points, ("2024-01-03", "2024-01-01"), ("2024-01-03", "2024-01-04"))


def test_approximate_percentiles_are_values_of_the_series(make):
    values = [float(v) for v in range(1, 101)]
    r = stats.approx_metric_stats(series(make, values, start=dt.date(2023, 1, 1))).first()
    assert (r["p10"], r["p50"], r["p90"]) == (10.0, 50.0, 90.0)


def test_rolling_mean_uses_calendar_days(make):
    points = series(make, [7.0, 14.0]).unionByName(series(make, [70.0], start=dt.date(2024, 1, 20)))
    assert rows(trends.rolling_mean(points).select("rolling_avg"), "date") == [(7.0,), (10.5,), (70.0,)]


def test_declining_runs(make):
    got = rows(trends.declining_runs(series(make, [9, 8, 7, 6, 9, 8, 9, 5]), 3).select("days", "lowest"))
    assert got == [(3, 6.0)]


def test_baseline_status(make):
    users = [("g", [40, 50, 60]), ("y", [40, 60, 45]), ("r", [50, 50, 20])]
    points = None
    for u, v in users:
        p = series(make, v, user=u)
        points = p if points is None else points.unionByName(p)
    assert dict(rows(trends.baseline_status(points).select("user_id", "status"))) == {"g": "green", "y": "yellow", "r": "red"}


def test_recovery_sets_newest_seven_against_the_rest(make):
    s = make([("u", S.HRV, 40 + i, f"2024-01-{10 + i:02d} 17:00") for i in range(12)]
             + [("few", S.HRV, 50, "2024-01-20 17:00")])
    got = {r["user_id"]: r for r in tools.coaching_recovery(s, "2024-01-22").collect()}
    assert got["u"]["hrv_delta_samples"] == 6.0 and got["u"]["hrv_trend"] == "improving"
    assert got["u"]["coaching_note"].startswith("Good recovery")
    assert got["few"]["hrv_delta_samples"] is None and got["few"]["hrv_trend"] == "unknown"


@pytest.mark.parametrize("hours, flag", [(7.5, "good"), (6.5, "borderline"), (6.4, "poor")])
def test_sleep_quality_edges(make, hours, flag):
    end = dt.datetime(2024, 1, 15, 4) + dt.timedelta(hours=hours)
    s = make([("u", S.SLEEP, 4, "2024-01-15 04:00", str(end))])
    assert tools.coaching_sleep(s, "2024-01-20").first()["quality_flag"] == flag


def test_user_filter_and_workout_metadata(make):
    s = make([("u", S.WORKOUT, 600, "2024-01-15 17:00", None, None, '{"workout_type":"HKWorkoutActivityTypeRunning","duration_seconds":600,"total_distance_meters":0}'),
              ("u", S.WORKOUT, 600, "2024-01-16 17:00", None, None, '{"duration_seconds":90,"total_distance_meters":2345.6}'),
              ("u", S.WORKOUT, 600, "2024-01-17 17:00"), ("v", S.WORKOUT, 600, "2024-01-17 17:00")])
    out = tools.get_workouts(s, "2024-01-20", user_id="u")
    got = rows(out["workouts"].select("workout_type", "duration_minutes", "distance_km", "calories_burned"), "started_at")
    assert got == [("Running", 10.0, None, None), ("unknown", 1.5, 2.35, None), ("unknown", 0.0, None, None)]
    assert out["summary"].first()["total_workouts"] == 3


def test_empty_input_gives_empty_reports(make, spark):
    s = make([("u", S.HRV, 1, "2024-01-01 12:00")]).filter(F.lit(False))
    assert tools.get_metric_stats(s, None, "2024-01-20").count() == 0
    assert tools.get_coaching_brief(s, "2024-01-20").count() == 0
    assert tools.get_health_summary(s, "2024-01-20").count() == 0
