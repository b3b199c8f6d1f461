import datetime as dt
import random

from pulseframe import schema as S
from pulseframe.operators import sleep
from pulseframe.plans import tools
from tests.conftest import at, rows


def test_night_rule_stages_and_missing_ends(make):
    s = make([("u", S.SLEEP, 3, "2024-01-15 10:59", "2024-01-15 11:59"),   # 05:59 local: night before
              ("u", S.SLEEP, 4, "2024-01-15 11:00", "2024-01-15 11:30"),   # 06:00 local: this night
              ("u", S.SLEEP, 5, "2024-01-16 03:00", "2024-01-16 03:20"),
              ("u", S.SLEEP, 0, "2024-01-16 03:00", "2024-01-16 09:00"), ("u", S.SLEEP, 1, "2024-01-16 03:01", "2024-01-16 09:00"),
              ("u", S.SLEEP, 2, "2024-01-16 03:02", "2024-01-16 09:00"), ("u", S.SLEEP, 3, "2024-01-16 04:00", None),
              ("u", S.SLEEP, 3, "2024-01-16 05:00", "2024-01-16 06:00", "Apple Watch")])
    got = rows(sleep.nights(sleep.segments(s)).select("night_date", "core_minutes", "deep_minutes", "rem_minutes", "total_minutes", "segment_count"), "night_date")
    assert got == [(dt.date(2024, 1, 14), 60.0, 0.0, 0.0, 60.0, 1), (dt.date(2024, 1, 15), 0.0, 30.0, 20.0, 50.0, 2)]
    by_source = sleep.nights_by_priority(s, ["Garmin", "Apple Watch", "Oura"])
    assert rows(by_source.select("night_date", "total_minutes"), "night_date") == [(dt.date(2024, 1, 14), 60.0), (dt.date(2024, 1, 15), 60.0)]


def test_sleep_is_searched_in_minutes(make):
    s = make([("u", S.SLEEP, 4, "2024-01-15 04:00", "2024-01-15 09:00"), ("u", S.SLEEP, 4, "2024-01-16 04:00", "2024-01-16 11:00")])
    got = tools.search_records(s, None, "2024-01-20", max_value=360, metrics=(S.SLEEP,))["records"]
    assert rows(got.select("date", "value")) == [(dt.date(2024, 1, 14), 300.0)]
    r = tools.compare_periods(s, None, "2024-01-20", ("2024-01-14", "2024-01-14"), ("2024-01-15", "2024-01-15"), metrics=(S.SLEEP,)).first()
    assert (r["a_avg"], r["b_avg"]) == (300.0, 420.0)


def test_sessions_match_a_sweep(make):
    rnd = random.Random(3)
    out, want = [], []
    for user in "abc":
        segs = []
        for _ in range(150):
            a = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(0, 6 * 86400))
            segs.append((a, a + dt.timedelta(seconds=rnd.randrange(0, 3600))))
        out += [(user, S.SLEEP, 3, str(a), str(b)) for a, b in segs]
        segs.sort()
        cur = None
        for a, b in segs:
            if cur and a < cur[1] + dt.timedelta(minutes=30):
                cur = [cur[0], max(cur[1], b), cur[2] + 1]
            else:
                want.append((user, *cur)) if cur else None
                cur = [a, b, 1]
        want.append((user, *cur))
    got = rows(sleep.sessions(make(out)).select("user_id", "session_start", "session_end", "segments"), "user_id", "session_start")
    strip = [(u, at(str(a)).replace(tzinfo=None), at(str(b)).replace(tzinfo=None), n) for u, a, b, n in want]
    assert got == strip


def test_best_and_worst_night_break_ties_by_date(make):
    s = make([("u", S.SLEEP, 4, f"2024-01-1{d} 04:00", f"2024-01-1{d} 05:00") for d in (6, 7, 8)])
    r = sleep.best_worst_night(sleep.nights(sleep.segments(s))).first()
    assert (str(r["best_night"]), str(r["worst_night"]), r["nights"]) == ("2024-01-15", "2024-01-15", 3)
