"""Batch and streaming readers over a folder of parquet tables, and a writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pagetally.session import shared_dir

# Files store ``ts`` as local time without a zone. Batch jobs keep it so
# (``timestamp_ntz``). A stream's watermark needs ``timestamp``; reading the
# column as that type takes the stored value as UTC whatever the session's zone.
EVENTS_STREAM_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _found(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def stream_events(
    spark: SparkSession,
    folder: str,
    file_glob: str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Stream the table ``events.parquet`` of a folder, be it one file or a folder of files.

    ``file_glob`` streams the files of these names instead, as they arrive. It raises if
    there is nothing of the kind yet. Files are taken in the order of their times, in
    batches of at most so many files or bytes.
    """
    reader = spark.readStream.schema(EVENTS_STREAM_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    name = file_glob or "events.parquet"
    found = _found(spark, f"{folder}/{name}")
    if not found:
        raise FileNotFoundError(f"no {name} in {folder}")
    if file_glob is None and found[0].isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a result once; an existing one is not overwritten."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there.

    For results that a job reads several times. Unlike a cache it outlives lost
    executors, and the files tell the planner the true size.
    """
    path = shared_dir(df.sparkSession, purpose)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
