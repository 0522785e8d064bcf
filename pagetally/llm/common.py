"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetally.sources.tables import materialize


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``id`` and ``text``; other columns cannot clash."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def utf8_rows(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes | None]]:
    """Ids and texts of a batch, the texts as bytes and one at a time.

    What Arrow holds on to from batches before is given back, as an idle worker would keep it.
    """
    pa.default_memory_pool().release_unused()
    texts = batch.column("text").cast(pa.large_binary())
    for key, text in zip(batch.column("id"), texts, strict=True):
        yield key.as_py(), text.as_py()
    del texts
    pa.default_memory_pool().release_unused()


def record_batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def partitions_of(spark: SparkSession) -> int:
    """The number of partitions that the session deals a shuffle to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected graph given as columns ``u`` and ``v``.

    Alternates large-star and small-star steps, each a join and an aggregation, until
    every node hangs on the smallest node it can reach. Each round's edges are written to
    the shared folder, so the lineage stays short and a lost executor costs no more than
    the current round. Nodes without an edge do not appear. A graph that has not
    settled after ``max_rounds`` raises; rounds grow with the logarithm of its size.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .union(now.select("v", "v")).distinct())
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Every edge now points from the larger node to the smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m")).where("u <> v").distinct())
        now = materialize(small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in column ``name``, without one task per key.

    Rows are dealt to parts by their whole content, numbered inside each part and
    shifted by the sizes of the parts before it, so a key's rows spread over all parts.
    Which row gets which number does not matter to the caller, only that none is left out.
    """
    parts = max(64, 2 * partitions_of(df.sparkSession))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*df.columns)
    return (dealt.withColumn("_at", F.row_number().over(inside) - 1)
            .join(sizes, [*keys, "_part"])
            .withColumn(name, (F.col("_at") + F.col("_shift")).cast("long"))
            .drop("_part", "_at", "_shift"))


def ranked(df: DataFrame, order: list[str], name: str, group: list[str] | None = None) -> DataFrame:
    """Number the rows in an order, from 0 in each group, in ``name``; ``<name>_of`` is their number.

    Rows are dealt by ranges of (group, order), so one group spreads over many tasks, and
    each range is shifted by the sizes of those before it. ``df`` is read twice, so it
    should be a written table; ``order`` should end in a column that is unique. The result is
    a written table. Column names that begin with ``_at`` are used inside.
    """
    keys = [*(group or []), *order]
    placed = materialize(
        df.repartitionByRange(partitions_of(df.sparkSession), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(*(group or []), part.alias("_at_part")).agg(
        F.min("_at").alias("_at_first"), F.count("*").alias("_at_n"))
    whole = Window.partitionBy(*(group or []))
    before = whole.orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range.
    sizes = materialize(sizes.select(
        *(group or []), "_at_part", "_at_first", F.sum("_at_n").over(whole).alias(f"{name}_of"),
        F.coalesce(F.sum("_at_n").over(before), F.lit(0)).alias("_at_before")), "sizes")
    return (placed.withColumn("_at_part", part).join(sizes, [*(group or []), "_at_part"])
            .withColumn(name, F.col("_at") - F.col("_at_first") + F.col("_at_before"))
            .drop("_at", "_at_part", "_at_first", "_at_before"))
