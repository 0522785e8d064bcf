"""Activity reports against plain Python on inputs with ties, gaps and NULLs."""

import random
from collections import Counter
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from pagetally.operators.activity import daily_activity, event_report, weekly_retention
from pagetally.operators.funnel import funnel
from pagetally.operators.last_touch import last_touch
from pagetally.operators.sessions import user_sessions
from tests.cases import START, by_user, events_df, random_events

def collected(df):
    return sorted(tuple(row) for row in df.collect())


def expected_sessions(rows, gap):
    out = []
    for user, history in by_user(rows).items():
        sessions = []
        for ts, _, _ in history:
            if sessions and ts - sessions[-1][-1] <= gap:
                sessions[-1].append(ts)
            else:
                sessions.append([ts])
        out += [(user, i, len(s), s[0], s[-1]) for i, s in enumerate(sessions, 1)]
    return sorted(out)


@pytest.mark.parametrize("minutes", [1, 7, 30, 360])
def test_sessions(spark, minutes):
    rows = random_events(minutes)
    got = collected(user_sessions(events_df(spark, rows), f"{minutes} minutes"))
    assert got == expected_sessions(rows, timedelta(minutes=minutes))


def test_session_goes_on_after_exactly_the_gap(spark):
    times = [0, 30, 60, 90 + 1e-6 / 60, 91]
    rows = [(i, START + timedelta(minutes=m), 1, "view", 0.0, None) for i, m in enumerate(times)]
    got = collected(user_sessions(events_df(spark, rows), "30 minutes"))
    assert got == expected_sessions(rows, timedelta(minutes=30))
    assert [r[2] for r in got] == [3, 2]


@pytest.mark.parametrize("steps", [("signup", "view", "purchase"), ("view", "view"), ("click",)])
def test_funnel(spark, steps):
    rows = random_events(len(steps), most=12)
    want = []
    for user, history in by_user(rows).items():
        reached = []
        for step in steps:
            after = [ts for ts, _, kind in history
                     if kind == step and (not reached or ts > reached[-1])]
            if not after:
                break
            reached.append(after[0])
        if len(reached) == len(steps):
            want.append((user, *reached))
    assert 0 < len(want) < 60
    assert collected(funnel(events_df(spark, rows), steps)) == sorted(want)


def test_funnel_of_many_repeats_of_a_time(spark):
    """A third of all rows at a few of one user's moments, as a default time would give."""
    rows = [(i, START + timedelta(seconds=i % 3), 7, kind, 0.0, None)
            for i in range(900) for kind in ("signup", "view", "purchase")]
    assert collected(funnel(events_df(spark, rows))) == [
        (7, START, START + timedelta(seconds=1), START + timedelta(seconds=2))]


@pytest.mark.parametrize("step_seconds", [5, 60])
def test_last_touch(spark, step_seconds):
    rows = random_events(step_seconds, most=25, minutes=300, step_seconds=step_seconds)
    want = []
    for user, history in by_user(rows, "purchase", "click").items():
        clicks = [(ts, i) for ts, i, kind in history if kind == "click"]
        for ts, event_id, kind in history:
            if kind == "purchase":
                before = [c for c in clicks if c[0] <= ts]
                touch_ts, touch_id = max(before) if before else (None, None)
                want.append((event_id, user, ts, touch_id, touch_ts))
    assert any(w[3] is None for w in want) and any(w[2] == w[4] for w in want)
    got = last_touch(events_df(spark, rows))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_last_touch_keeps_every_copy_at_one_time(spark):
    """A third of all rows at one user's one moment, as a default time would give."""
    rows = [(i, START, 7, "purchase", 0.0, None) for i in range(400)]
    rows += [(1000 + i, START - timedelta(days=i), 7, "click", 0.0, None) for i in range(5)]
    rows += [(2000 + i, START + timedelta(minutes=i), i, "purchase", 0.0, None) for i in range(50)]
    got = last_touch(events_df(spark, rows)).collect()
    assert len(got) == 450
    assert {r.click_id for r in got if r.user_id == 7 and r.purchase_ts == START} == {1000}


def test_last_touch_without_ids(spark):
    at = [START + timedelta(minutes=i) for i in range(4)]
    rows = [(1, at[0], 1, "click", 0.0, None), (None, at[1], 1, "click", 0.0, None),
            (None, at[2], 1, "purchase", 0.0, None), (None, at[2], 1, "purchase", 0.0, None),
            (2, at[3], 1, "purchase", 0.0, None)]
    got = last_touch(events_df(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter({
        (None, 1, at[2], 1, at[0]): 2, (2, 1, at[3], 1, at[0]): 1})


def test_event_report(spark):
    rows = random_events(3)
    want = Counter()
    for _, ts, _, kind, *_ in rows:
        day = ts and ts.date()
        for key in ((day, kind, 0), (day, None, 1), (None, None, 3)):
            want[key] += 1
    got = event_report(events_df(spark, rows)).collect()
    assert Counter({(r.day, r.event_type, r.level): r.n_events for r in got}) == want
    assert len(got) == len(want)


def test_daily_activity(spark):
    rows = [r for r in random_events(4, minutes=60 * 24 * 20) if r[1] is None or r[1].day % 5]
    days = {}
    for _, ts, user, _, value, _ in rows:
        if ts is not None:
            users, total = days.setdefault(ts.date(), (set(), []))
            users.add(user)
            total.append(Decimal(str(value or 0)))
    ordered = sorted(days)
    want = []
    for i, day in enumerate(ordered):
        users, values = days[day]
        rolling = sum(sum(days[d][1]) for d in ordered[max(0, i - 6): i + 1])
        want.append((day, len(users - {None}), float(sum(values)), float(rolling)))
    assert collected(daily_activity(events_df(spark, rows))) == want


@pytest.mark.parametrize("value", [1e300, 1e-300])
def test_values_that_cannot_be_summed_fail_the_job(spark, value):
    rows = [(1, START, 1, "view", 1.0, None), (2, START, 1, "view", value, None)]
    with pytest.raises(PySparkException, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW|too small"):
        daily_activity(events_df(spark, rows)).collect()


def test_values_that_are_not_finite_stay_in_their_windows(spark):
    rows = [(i, START + timedelta(days=i), 1, "view", 1.0, None) for i in range(10)]
    rows += [(20, START + timedelta(days=1), 2, "view", float("nan"), None),
             (21, START + timedelta(days=9), 2, "view", float("inf"), None)]
    got = daily_activity(events_df(spark, rows), rows=3).orderBy("day").collect()
    assert [str(r.value) for r in got] == ["1.0", "nan", *["1.0"] * 7, "inf"]
    assert [str(r.rolling_value) for r in got] == ["1.0", "nan", "nan", "nan", *["3.0"] * 5, "inf"]


def test_small_and_large_values_are_summed_exactly(spark):
    rows = [(i, START, i % 9, "view", 4e-7, None) for i in range(1000)]
    rows += [(i, START + timedelta(days=2), 1, "view", 5e12, None) for i in range(3)]
    got = [r.value for r in daily_activity(events_df(spark, rows)).orderBy("day").collect()]
    assert got == [0.0004, 1.5e13]


def test_daily_sums_do_not_depend_on_the_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, 0.7, 2e9 + 0.01] * 50
    want = float(sum(Decimal(str(v)) for v in values))
    for seed in range(3):
        random.Random(seed).shuffle(values)
        rows = [(i, START, i % 7, "view", v, None) for i, v in enumerate(values)]
        assert daily_activity(events_df(spark, rows, seed + 1)).head().value == want


def test_weekly_retention(spark):
    rows = random_events(5, most=8, minutes=60 * 24 * 40)
    active = set()
    for user, history in by_user(rows).items():
        first = history[0][0].date()
        active |= {((ts.date() - first).days // 7, user) for ts, _, _ in history}
    want = Counter(week for week, _ in active)
    got = weekly_retention(events_df(spark, rows)).collect()
    assert {r.week: r.n_users for r in got} == dict(want)


def test_reports_do_not_depend_on_the_session_zone(spark):
    """Includes the hour that New York's clocks skipped on 2024-03-10."""
    rows = [(i, START.replace(day=9) + timedelta(minutes=25 * i), i % 2, "click", 1.0, None)
            for i in range(40)]
    events = events_df(spark, rows)
    jobs = (user_sessions, event_report, daily_activity, weekly_retention, last_touch)
    before = [Counter(map(tuple, job(events).collect())) for job in jobs]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [Counter(map(tuple, job(events).collect())) for job in jobs] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
