"""Streaming counts and de-duplication, and how to run them.

The streams carry ``ts`` as ``timestamp`` (see ``sources.tables.stream_events``).
Days are UTC days whatever the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pagetally.session import shared_dir


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Event counts by day and type for append mode.

    A day is emitted once, when the watermark has passed its end; the last days
    of the data therefore stay open. Spark adds up counts before the shuffle.
    """
    day_no = F.floor(F.unix_seconds("window.start") / 86400).cast("int")
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count("*").alias("n_events"))
        .select(F.date_from_unix_date(day_no).alias("day"), "event_type", "n_events")
    )


def deduplicate(events: DataFrame, delay: str = "1 hour", spread: int = 32) -> DataFrame:
    """Events without repeats of an ``event_id`` that arrive within ``delay``.

    Copies of one event are first thinned out among the tasks that read them, in
    ``spread`` groups, so that at most ``spread`` of them meet in one task however
    often the event was delivered. That doubles the state; ``spread=1`` leaves it
    out. Events without an id are all kept: nothing tells them to be copies.
    """
    marked = events.withWatermark("ts", delay).withColumn(
        "own", F.when(F.col("event_id").isNull(), F.uuid())
    )
    if spread > 1:
        marked = (
            marked.withColumn("reader", F.spark_partition_id() % spread)
            .dropDuplicatesWithinWatermark(["event_id", "own", "reader"])
            .drop("reader")
        )
    return marked.dropDuplicatesWithinWatermark(["event_id", "own"]).drop("own")


def append_available(
    rows: DataFrame, output: str, checkpoint: str, state_partitions: int | None = None
) -> int:
    """Append what has arrived since the last run with this checkpoint, then stop.

    Returns how many rows came too late and were dropped, as the stateful operators count
    them: an aggregation counts what is left of late rows after adding them up by task. The
    parquet sink logs finished batches, so a run repeated after a failure adds nothing
    twice. Adaptive execution does not size stateful shuffles: their number of partitions
    is taken from ``state_partitions``, or else the session, on the first run, and stays.
    The session's setting is changed while the query starts, so plan nothing else in the
    same session at that moment.
    """
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", output)
        .trigger(availableNow=True)
    )
    return _finish(_start(rows, writer, state_partitions))


def _start(rows: DataFrame, writer: DataStreamWriter, state_partitions: int | None) -> StreamingQuery:
    conf, setting = rows.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(setting)
    conf.set(setting, str(state_partitions or before))
    try:
        return writer.start()  # copies the settings
    finally:
        conf.set(setting, before)


def _finish(query: StreamingQuery) -> int:
    """Wait for the end; the number of rows dropped for being late."""
    dropped: dict[int, int] = {}

    def look() -> None:
        # Only the last batches are kept, so look often.
        for progress in query.recentProgress:
            dropped[progress.batchId] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    while not query.awaitTermination(1):
        look()
    look()
    return sum(dropped.values())


def run_complete(rows: DataFrame, purpose: str, state_partitions: int | None = None) -> DataFrame:
    """Run an aggregating stream over a finished folder and read its whole result.

    In complete mode no group stays open and no row is too late.
    """
    spark = rows.sparkSession
    base = shared_dir(spark, purpose)

    def keep(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(f"{base}/rows")

    keep(spark.createDataFrame([], rows.schema), -1)
    writer = (
        rows.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    )
    _finish(_start(rows, writer, state_partitions))
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def deduplicate_finished(events: DataFrame) -> DataFrame:
    """``deduplicate`` for a folder that is complete: every event once, whenever its copies came.

    Of copies that differ the one with the earliest time is kept, unknown times last, and
    among equal times the one with the smallest other columns. Events without an id are
    all kept. Copies are thinned out before the shuffle, so no state and no group grows
    with the number of copies.
    """
    others = [c for c in events.columns if c not in ("event_id", "ts")]
    order = F.struct(F.col("ts").isNull().alias("unknown"), "ts", *others)
    first = (
        events.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min(order).alias("kept"))
        .select("event_id", "kept.*")
    )
    return first.select(*events.columns).union(events.where(F.col("event_id").isNull()))
