"""As-of join: the last event of one type before each event of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Time slice within which a user's history is ordered. Times have
# microseconds, so a slice holds at most 60 million distinct ones.
SLICE = "1 minute"


def last_touch(events: DataFrame, target: str = "purchase", touch: str = "click") -> DataFrame:
    """For each ``target`` event, the same user's last ``touch`` at or before it.

    Of touches at the same time the one with the highest ``event_id`` counts.
    Targets without an earlier touch are kept, with NULL touch columns. Events
    without a user or time, and touches without an id, are left out.
    """
    is_touch = F.col("event_type") == touch
    rows = events.where(
        F.col("event_type").isin(target, touch)
        & (F.col("event_id").isNotNull() | ~is_touch)
        & F.col("user_id").isNotNull()
        & F.col("ts").isNotNull()
    ).select(
        "user_id",
        "ts",
        "event_id",
        F.when(is_touch, F.col("ts")).alias("touch_ts"),
        F.when(is_touch, F.col("event_id")).alias("touch_id"),
    )
    found = _by_slice(rows)
    return found.select(
        F.col("event_id").alias(f"{target}_id"),
        "user_id",
        F.col("ts").alias(f"{target}_ts"),
        F.col("touch_id").alias(f"{touch}_id"),
        F.col("touch_ts").alias(f"{touch}_ts"),
    )


def _by_slice(rows: DataFrame) -> DataFrame:
    """The last touch of every target, whatever the size of a user.

    Rows are reduced to the distinct times of a user. The last touch of earlier
    slices is put in front of each slice, so that every slice can be filled on
    its own, and the targets then look their time up, in a plain join whose large
    partitions adaptive execution may split.
    """
    # Both uses of the points read all their columns, in the same order, so that
    # Spark shuffles them once and reuses the shuffle.
    points = (
        rows.groupBy("user_id", "ts")
        .agg(
            F.count(F.when(F.col("touch_id").isNull(), True)).alias("n_targets"),
            F.max("touch_ts").alias("touch_ts"),
            F.max("touch_id").alias("touch_id"),
        )
        .withColumn("slice", F.window("ts", SLICE).start)
    )
    earlier_slices = (
        Window.partitionBy("user_id")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        points.groupBy("user_id", "slice")
        .agg(
            F.sum("n_targets").alias("slice_targets"),
            F.max("touch_ts").alias("touch_ts"),
            F.max_by("touch_id", "touch_ts").alias("touch_id"),
        )
        .select(
            "user_id",
            F.col("slice").alias("ts"),
            F.last("touch_ts", ignorenulls=True).over(earlier_slices).alias("touch_ts"),
            F.last("touch_id", ignorenulls=True).over(earlier_slices).alias("touch_id"),
            F.lit(0).cast("bigint").alias("n_targets"),
            "slice",
            "slice_targets",
        )
        .where(F.col("touch_id").isNotNull() & (F.col("slice_targets") > 0))
        .drop("slice_targets")
    )
    # A carried touch sorts before a point at the very start of its slice.
    within_slice = (
        Window.partitionBy("user_id", "slice")
        .orderBy("ts", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = (
        points.withColumn("seq", F.lit(1))
        .unionByName(carried.withColumn("seq", F.lit(0)))
        .select(
            "user_id",
            "ts",
            "n_targets",
            F.last("touch_ts", ignorenulls=True).over(within_slice).alias("touch_ts"),
            F.last("touch_id", ignorenulls=True).over(within_slice).alias("touch_id"),
        )
        .where(F.col("n_targets") > 0)
    )
    targets = rows.where(F.col("touch_id").isNull()).select("user_id", "ts", "event_id")
    return targets.join(filled.drop("n_targets"), ["user_id", "ts"])
