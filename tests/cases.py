"""Small hand-made and random inputs for the brute-force comparisons."""

import random
from datetime import datetime, timedelta

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
START = datetime(2024, 3, 30, 22, 0)
TYPES = ("signup", "view", "click", "purchase", "error")


def events_df(spark, rows, slices=3):
    return spark.createDataFrame(rows, EVENTS_SCHEMA).repartition(slices)


def random_events(seed, users=60, most=40, minutes=600, step_seconds=60):
    """Random histories with many equal times, one user with most rows, and NULLs."""
    rng = random.Random(seed)
    rows = []
    for user in range(users):
        n = 600 if user == 0 else rng.randrange(most)
        for _ in range(n):
            ts = START + timedelta(seconds=step_seconds * rng.randrange(minutes))
            rows.append((len(rows), ts, user, rng.choice(TYPES), rng.randrange(9999) / 100, None))
    for _ in range(20):
        ts = START + timedelta(minutes=rng.randrange(minutes))
        rows.append((len(rows), ts, None, rng.choice(TYPES), 1.0, None))
        rows.append((len(rows), None, rng.randrange(users), rng.choice(TYPES), 1.0, None))
        rows.append((len(rows), ts, rng.randrange(users), None, None, None))
    rng.shuffle(rows)
    return rows


def by_user(rows, *types):
    """user -> time-ordered (ts, event_id, type), without rows that cannot be placed."""
    users = {}
    for event_id, ts, user, kind, *_ in rows:
        if user is not None and ts is not None and (not types or kind in types):
            users.setdefault(user, []).append((ts, event_id, kind))
    return {user: sorted(history, key=lambda e: e[:2]) for user, history in users.items()}
