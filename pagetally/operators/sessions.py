"""Sessions by inactivity gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Number each user's sessions; a longer silence than ``gap`` starts a new one.

    Events of one user in the same tumbling window of width ``gap`` are always in
    the same session, so they are first reduced to count, start and end, mostly
    before the shuffle. Only these pieces are ordered per user: a user's group is
    bounded by the length of the history divided by ``gap``, not by its events.
    """
    pieces = (
        events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .select("user_id", "ts", F.window("ts", gap).start.alias("piece"))
        .groupBy("user_id", "piece")
        .agg(
            F.count("*").alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    in_order = Window.partitionBy("user_id").orderBy("first_ts")
    previous_end = F.lag("last_ts").over(in_order)
    starts = previous_end.isNull() | (
        F.col("first_ts") > previous_end + F.expr(f"INTERVAL {gap}")
    )
    return (
        pieces.withColumn("starts", starts.cast("bigint"))
        .withColumn("session_no", F.sum("starts").over(in_order))
        .groupBy("user_id", "session_no")
        .agg(
            F.sum("n").alias("n_events"),
            F.min("first_ts").alias("session_start"),
            F.max("last_ts").alias("session_end"),
        )
    )
