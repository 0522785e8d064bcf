"""Activity reports over ``events(event_id, ts, user_id, event_type, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values are added up as decimals, so that the order of addition does not matter. A
# double is taken as the shortest decimal that stands for it.
EXACT = "decimal(38,20)"


def event_report(events: DataFrame) -> DataFrame:
    """Event counts by day and type, with subtotals per day and in total.

    ``level`` is 0 for day and type, 1 for a day, 3 for the total. The rollup
    triples its input, so it runs on the day-and-type counts, not on events.
    """
    counts = (
        events.groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(F.count("*").alias("n"))
    )
    return (
        counts.rollup("day", "event_type")
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.sum("n").alias("n_events"),
        )
        .select("day", "event_type", "level", "n_events")
    )


def daily_activity(events: DataFrame, rows: int = 7) -> DataFrame:
    """Users and value per day, and the value over the last ``rows`` days present.

    Sums are exact up to 20 decimals and 10**18. A value or sum beyond that fails the job,
    as does one that is not zero but would become it. NaN and infinity make the sums of their
    days what they do in floating point, and touch no other day.

    The rolling window has no partition key: it sees one row per calendar day,
    at most about 3.7 million for all dates Spark can hold, never the events.
    """
    trailing = Window.orderBy("day").rowsBetween(1 - rows, Window.currentRow)
    value = F.col("value")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    exact = F.when(finite, value).cast(EXACT)
    held = F.when(
        (exact == 0) & (value != 0),
        F.raise_error(F.concat(F.lit("value too small to add up: "), value.cast("string"))).cast(EXACT),
    ).otherwise(exact)
    user_days = (
        events.where(F.col("ts").isNotNull())
        .groupBy(F.to_date("ts").alias("day"), "user_id")
        .agg(F.sum(held).alias("exact"), F.sum(F.when(~finite, value)).alias("other"))
    )
    daily = user_days.groupBy("day").agg(
        F.count("user_id").alias("n_users"), F.sum("exact").alias("exact"), F.sum("other").alias("other"))

    def total(exact: Column, other: Column) -> Column:
        number = exact.cast("double")
        return F.when(other.isNull(), number).otherwise(other + F.coalesce(number, F.lit(0.0)))

    return daily.select(
        "day",
        "n_users",
        total(F.col("exact"), F.col("other")).alias("value"),
        total(F.sum("exact").over(trailing), F.sum("other").over(trailing)).alias("rolling_value"),
    )


def weekly_retention(events: DataFrame) -> DataFrame:
    """Distinct users active in each week after the day of their first event.

    Week 0 starts on that day. Only the distinct days of a user are shuffled,
    so a user's group is bounded by the calendar.
    """
    days = (
        events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .select("user_id", F.to_date("ts").alias("day"))
        .distinct()
    )
    first_day = F.min("day").over(Window.partitionBy("user_id"))
    week = F.floor(F.date_diff("day", first_day) / 7).cast("bigint")
    return (
        days.select("user_id", week.alias("week"))
        .groupBy("week")
        .agg(F.countDistinct("user_id").alias("n_users"))
    )
