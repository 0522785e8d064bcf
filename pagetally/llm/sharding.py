"""Sharding by balanced label propagation, with built-in functions only.

Documents with equal texts are linked. Linked documents start spread evenly over the shards
and then, round by round, each wants to join the shard that has most of its group.
Wishes are granted under quotas: from shard a to shard b as many may go as come back, plus
b's free places shared out over those who want in, to the last place. What a group holds in a
full shard may join the rest of it in a free one if it goes as a whole. No shard ever holds more linked documents
than its final number of rows, so documents without links fill the rest and the shards
end with row counts at most one apart, whatever was moved.

A group larger than a shard is first cut into parts that fit into one; those cuts
cannot be avoided. Rounds that ask for free places
only alternate with rounds of swaps, until nothing moves in either or for ``rounds`` rounds. All counting is
by group and shard, aggregated before it is shuffled; what reaches the driver is a number per
shard.

Defined results: a null text is an empty one (all of these are one group); rows that repeat
an id are documents of their own; an empty table gives no rows; with fewer documents than
shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import numbered, slim
from pagetally.sources.tables import materialize

SHARDS = 40
ROUNDS = 8
ROW_BYTES = 16


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(slim(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("text_key")), "documents")


def _round(now: DataFrame, quota: dict[int, int], turn: int) -> DataFrame:
    """One round of wishes and moves of (row, grp, shard).

    In every other round, one of swaps, full shards may be wished for too.
    """
    swap = turn % 2 == 1
    spark = now.sparkSession
    held = {r.shard: r.n for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = spark.createDataFrame(
        [(s, q - held.get(s, 0)) for s, q in quota.items()], "shard int, free long")
    counts = now.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.xxhash64("grp", "shard"), "shard")
    best = counts.join(F.broadcast(free.where(F.lit(swap) | (F.col("free") > 0)).select("shard")), "shard", "left_semi").groupBy("grp").agg(
        F.max(rank).alias("best"))
    rooms = F.broadcast(free.select(F.col("shard").alias("to"), "free"))
    # A better shard than the best free one is full: what it has goes as a whole or not at all.
    whole = F.col("best") < rank
    wishes = (
        counts.join(best, "grp").where(F.col("best") != rank)
        .select("grp", "shard", F.col("best.shard").alias("to"), "n", (F.col("best.n") - F.col("n")).alias("gain"),
                whole.alias("whole"))
        .join(rooms, "to").where("NOT whole OR n <= free").drop("free")
    )
    wishes = materialize(wishes, "wishes")
    # At most 2 * shards * shards rows.
    pairs = wishes.groupBy("shard", "to", "whole").agg(F.sum("n").alias("wish"))
    back = pairs.where("NOT whole").select(
        F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("wish").alias("back"), F.lit(False).alias("whole"))
    # Shares are differences of rounded running shares, so they add up to all places that are wanted.
    turned = Window.partitionBy("to", "whole").orderBy(F.xxhash64("shard", "to", F.lit(turn)), "shard")
    every = F.sum(F.expr("if(whole, 0, wish)")).over(Window.partitionBy("to"))
    given = F.expr("least(free, all)")
    share = F.expr("least(free, all) * upto div all - least(free, all) * (upto - wish) div all")
    grants = (
        pairs.join(back, ["shard", "to", "whole"], "left").join(rooms, "to")
        .withColumn("all", every).withColumn("upto", F.sum("wish").over(turned))
        .select("shard", "to", "whole", F.when(
            F.col("whole"), F.least("wish", F.col("free") - given - F.col("upto") + F.col("wish"))).otherwise(
            F.least("wish", F.coalesce("back", F.lit(0)) + share)).alias("granted"))
    )
    inside = Window.partitionBy("shard", "to", "whole").orderBy(F.desc("gain"), "grp")
    before = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = (
        wishes.withColumn("before", before).join(F.broadcast(grants), ["shard", "to", "whole"])
        .select("grp", "shard", "to", "n", "whole", F.least("n", F.col("granted") - F.col("before")).alias("go"))
        .where("go > 0 AND (NOT whole OR go = n)").drop("whole")
    )
    marked = materialize(now.join(moves, ["grp", "shard"], "left"), "moves")
    # At most one group for each pair of shards moves in part.
    part = numbered(marked.where("go < n").select("grp", "shard", "row", "to", "go"), ["grp", "shard"], "nth")
    return (
        marked.where("go IS NULL OR go = n").select("row", "grp", F.coalesce("to", "shard").alias("shard"))
        .union(part.select("row", "grp", F.expr("CASE WHEN nth < go THEN to ELSE shard END").alias("shard")))
    )


def cut_links(placed: DataFrame) -> int:
    """Links between rows of one group in different shards, of (grp, shard) rows."""
    pairs = lambda c: F.sum(F.expr(f"cast({c} AS decimal(38, 0)) * ({c} - 1) / 2"))
    sizes = placed.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    inside = sizes.agg(pairs("n")).first()[0] or 0
    total = sizes.groupBy("grp").agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0] or 0
    return int(total - inside)


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int = SHARDS, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, size, text_crc32, text_key, shard, slot) per row of ``docs``.

    Slots number the rows of a shard from 0. Row counts of shards are at most one apart.
    """
    base = _base(docs, id_col, text_col)
    total = base.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    fits = max(1, total // shards)
    # Written out, so that the join is a plain one whose large partitions can be split.
    groups = materialize(base.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select(
        "text_key", F.ceil(F.col("n") / fits).cast("int").alias("parts")), "groups")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("string")
    linked = base.join(groups, "text_key").select("row", F.concat_ws("-", "text_key", part).alias("grp"))
    spread = numbered(materialize(linked, "linked"), [], "nth")
    now = materialize(spread.select("row", "grp", F.pmod("nth", F.lit(shards)).cast("int").alias("shard")), "placed")
    still = 0
    for turn in range(rounds):
        new = materialize(_round(now, quota, turn), "placed")
        still = still + 1 if new.exceptAll(now).isEmpty() else 0
        now = new
        if still == 2:
            break
    held = {r.shard: r.n for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, end = [], 0
    for s in range(shards):
        end += quota[s] - held.get(s, 0)
        ends.append(end)
    alone = materialize(base.join(now, "row", "left_anti").select("row"), "alone")
    filled = numbered(alone, [], "nth").select("row", F.size(F.filter(
        F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("nth"))).alias("shard"))
    placed = materialize(now.select("row", "shard").union(filled), "placed")
    return numbered(placed, ["shard"], "slot").join(base, "row").select(
        F.col("id").alias(id_col), "size", "text_crc32", "text_key", "shard", "slot")
