"""Users who take a series of steps in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Time slice within which a user's events are looked at one by one.
SLICE = "1 minute"


def funnel(
    events: DataFrame,
    steps: Sequence[str] = ("signup", "view", "purchase"),
) -> DataFrame:
    """First time of each step for the users who complete all of them.

    Step 1 is a user's first event of the first type; every later step is the
    first event of its type strictly after the step before. Times are in
    ``step_1_ts``, ``step_2_ts`` and so on.

    Events are read once and meet in slices of a user's time, so that a user with most
    of the rows is spread over many tasks. A slice is summed up by what it does to a user
    who comes in with a number of steps done: ``from_s_to_j`` is when such a user, s steps
    done, has done step j. A user is then a row per slice, at most 526,000 a year.
    """
    in_slice = Window.partitionBy("user_id", "slice")
    per_user = Window.partitionBy("user_id")
    n = len(steps)
    rows = events.where(
        F.col("event_type").isin(*steps)
        & F.col("user_id").isNotNull()
        & F.col("ts").isNotNull()
    ).select("user_id", "event_type", "ts", F.window("ts", SLICE).start.alias("slice"))
    for j in range(1, n + 1):
        is_step = F.col("event_type") == steps[j - 1]
        rows = rows.select("*", *[
            F.min(F.when(is_step & (F.lit(True) if s == j - 1 else F.col("ts") > F.col(f"from_{s}_to_{j - 1}")),
                         F.col("ts"))).over(in_slice).alias(f"from_{s}_to_{j}")
            for s in range(j)
        ])
    users = rows.groupBy("user_id", "slice").agg(*[
        F.first(c).alias(c) for c in rows.columns if c.startswith("from_")])
    for j in range(1, n + 1):
        # Before its slice a step is not done, after it the step is.
        done = sum((F.col(f"slice_{i}") < F.col("slice")).cast("int") for i in range(1, j)) if j > 1 else F.lit(0)
        reached = F.lit(True) if j == 1 else F.col(f"slice_{j - 1}") <= F.col("slice")
        time = F.coalesce(*[F.when(done == s, F.col(f"from_{s}_to_{j}")) for s in range(j)])
        found = F.when(reached, time)
        users = users.withColumn(f"step_{j}_ts", F.min(found).over(per_user))
        users = users.withColumn(f"slice_{j}", F.window(f"step_{j}_ts", SLICE).start)
    times = [f"step_{j}_ts" for j in range(1, n + 1)]
    # One row per user: the one of the slice that holds the last step.
    return users.where(F.col("slice") == F.col(f"slice_{n}")).select("user_id", *times)
