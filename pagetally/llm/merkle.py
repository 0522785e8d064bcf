"""Merkle manifest of a data set: one hash tree per group, stored in blocks.

A tree joins its leaves two by two, level by level; a last node without a partner is hashed
alone. The roots of the groups, in the order of the groups, are the leaves of one more tree,
whose root stands for the whole data set.

A tree is kept as aligned subtrees of ``height`` levels. A block holds the digests of one
subtree in van Emde Boas order: the upper half of its levels first, then each subtree
below, both laid out in the same way, so a path from leaf to root stays in few cache lines
whatever their size. ``address`` computes a node's place; building and sibling look-up use no
pointers. The roots of the blocks are the leaves of the next blocks, and so on until
one block is left in each group. Paths come back the same way: a block appends the siblings
that it holds to those of its own root, which its parent block has handed down, so a
proof needs one join per block level and never a whole tree in one place.

H is the lower-case hexadecimal SHA-256 of what it is given, digests as hexadecimal text.

Defined results: rows are ordered by id, nulls first, then by leaf digest, so rows that repeat
an id have a place of their own and equal rows are interchangeable; a null group is a group of
its own and comes first; a lone leaf is the root of its group; without siblings the proof is the
hash of an empty text; null fields count as ``-``, an empty text as ``0:``; an empty table
gives no rows. Only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import id_type, ranked, record_batch
from pagetally.sources.tables import materialize

HEIGHT = 10
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# An entry of a path: where the sibling stands, then its digest.
LEFT, RIGHT, ALONE = range(3)
ENTRY = 1 + DIGEST


def digest_of(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


@functools.cache
def address(levels: int) -> tuple[np.ndarray, ...]:
    """For a full binary tree of so many levels: the place of each node, by depth.

    The upper half of the levels comes first, then the subtrees below it from left to right.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper, lower = levels // 2, levels - levels // 2
    top, below = address(upper), address(lower)
    starts = (1 << upper) - 1 + np.arange(1 << upper) * ((1 << lower) - 1)
    return (*top, *((starts[:, None] + places).ravel() for places in below))


def levels_above(leaves: int) -> int:
    """How many times so many nodes are joined in twos until one is left."""
    return max(0, leaves - 1).bit_length()


class Block:
    """A subtree: digests in van Emde Boas order, as many leaves as are present."""

    def __init__(self, nodes: bytearray | bytes, leaves: int, height: int):
        self.nodes, self.height = nodes, height
        self.places = address(height + 1)
        # Present nodes by depth; depth 0 is the root.
        self.present = [-(-leaves // (1 << (height - d))) for d in range(height + 1)]

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        block = cls(bytearray(((2 << height) - 1) * DIGEST), len(leaves), height)
        for depth in range(height, -1, -1):
            for i in range(block.present[depth]):
                if depth == height:
                    block[depth, i] = leaves[i]
                else:
                    children = range(2 * i, min(2 * i + 2, block.present[depth + 1]))
                    block[depth, i] = digest_of(*(block[depth + 1, c] for c in children))
        return block

    def __getitem__(self, node: tuple[int, int]) -> bytes:
        at = int(self.places[node[0]][node[1]]) * DIGEST
        return bytes(self.nodes[at:at + DIGEST])

    def __setitem__(self, node: tuple[int, int], digest: bytes) -> None:
        at = int(self.places[node[0]][node[1]]) * DIGEST
        self.nodes[at:at + DIGEST] = digest

    def path(self, leaf: int) -> bytes:
        """The entries from a leaf up to the block's root."""
        out = []
        for depth in range(self.height, 0, -1):
            other = leaf ^ 1
            if other >= self.present[depth]:
                out.append(bytes((ALONE,)) + bytes(DIGEST))
            else:
                out.append(bytes((LEFT if other < leaf else RIGHT,)) + self[depth, other])
            leaf >>= 1
        return b"".join(out)


def siblings(path: bytes) -> list[bytes]:
    return [path[i + 1:i + ENTRY] for i in range(0, len(path), ENTRY) if path[i] != ALONE]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for i in range(0, len(path), ENTRY):
        other = path[i + 1:i + ENTRY]
        if path[i] == ALONE:
            leaf = digest_of(leaf)
        else:
            leaf = digest_of(other, leaf) if path[i] == LEFT else digest_of(leaf, other)
    return leaf


@dataclass
class Forest:
    """A tree per group. ``levels[j]`` holds the blocks (grp, block, total, nodes, members) that
    span ``height * j`` to ``height * (j + 1)`` levels above the leaves; ``roots`` holds (grp, digest)."""

    levels: list[DataFrame]
    roots: DataFrame
    height: int


def _pack(items: DataFrame, kept: list[str], height: int) -> DataFrame:
    """Blocks of rows (grp, at, total, digest, ...): (grp, block, total, head, nodes, members)."""
    rows = items.groupBy("grp", F.shiftright("at", height).alias("block")).agg(
        F.first("total").alias("total"),
        # At most 2^height rows, in the order of their places.
        F.sort_array(F.collect_list(F.struct("at", "digest", *kept))).alias("members"))
    rows = rows.select("grp", "block", "total", "members.digest", F.struct(
        *[F.col(f"members.{c}").alias(c) for c in kept]).alias("members") if kept else F.lit(0).alias("members"))
    schema = rows.drop("digest").schema.add("head", "binary").add("nodes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [f for f in batch.schema if f.name != "digest"]
            heads, nodes = [], []
            for total, leaves in zip(batch.column("total").to_pylist(), batch.column("digest"), strict=True):
                block = Block.build(leaves.as_py(), min(height, levels_above(total)))
                heads.append(block[0, 0])
                nodes.append(bytes(block.nodes))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in same), pa.array(heads, pa.binary()), pa.array(nodes, pa.binary())],
                schema=pa.schema([*same, ("head", pa.binary()), ("nodes", pa.binary())]))

    return rows.mapInArrow(run, schema)


def build(items: DataFrame, kept: list[str], height: int = HEIGHT) -> Forest:
    """Trees over rows (grp, at, total, digest); columns ``kept`` stay with the lowest blocks."""
    levels = [materialize(_pack(items, kept, height), "blocks")]
    while not (more := levels[-1].where(F.col("total") > 1 << height)).isEmpty():
        upper = more.select(
            "grp", F.col("block").alias("at"), F.col("head").alias("digest"),
            F.shiftright(F.col("total") + ((1 << height) - 1), height).alias("total"))
        levels.append(materialize(_pack(upper, [], height), "blocks"))
    tops = [b.where(F.col("total") <= 1 << height).select("grp", F.col("head").alias("digest")) for b in levels]
    return Forest(levels, functools.reduce(DataFrame.union, tops), height)


def _children(blocks: DataFrame, height: int) -> DataFrame:
    """(grp, block, path, subroot, root) of the nodes that are the leaves of blocks with a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            out = pa.schema([("grp", kinds["grp"]), ("block", pa.int64()), *((c, pa.binary()) for c in ("path", "subroot", "root"))])
            for row in batch.to_pylist():
                first = row["block"] << height
                n = min(1 << height, row["total"] - first)
                block = Block(row["nodes"], n, min(height, levels_above(row["total"])))
                yield record_batch(out, [
                    [row["grp"]] * n, list(range(first, first + n)), [block.path(i) + row["path"] for i in range(n)],
                    [row["subroot"]] * n, [row["root"]] * n])

    grp = blocks.schema["grp"].dataType.simpleString()
    rows = blocks.select("grp", "block", "total", "nodes", "path", "subroot", "root")
    return rows.mapInArrow(run, f"grp {grp}, block long, path binary, subroot binary, root binary")


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest blocks with the path of their root; ``above`` has (grp, path, subroot, root) of each group."""
    found = None
    for blocks in reversed(forest.levels):
        top = blocks.where(F.col("total") <= 1 << forest.height).join(above, "grp")
        if found is not None:
            top = top.unionByName(blocks.where(F.col("total") > 1 << forest.height).join(found, ["grp", "block"]))
        found = _children(top, forest.height) if blocks is not forest.levels[0] else top
    return found


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    altered: dict[str, Column] | None = None, is_altered: Column | None = None, height: int = HEIGHT,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    ``altered`` gives other values of some fields for the rows where ``is_altered`` holds; the
    trees are of the rows as they are, and the changed leaf is folded with the original
    siblings. Digests come as lower-case hexadecimal text.
    """
    columns = [docs[c] for c in fields]
    changed = F.lit(None).cast("binary")
    if altered:
        changed = F.when(is_altered, leaf_digest([altered.get(c, docs[c]) for c in fields]))
    # A null group sorts before all others, which start with a sign.
    leaves = materialize(docs.select(
        docs[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit("")).alias("grp"),
        leaf_digest(columns).alias("digest"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    places = ranked(leaves, ["id", "digest", "row"], "at", ["grp"]).withColumnRenamed("at_of", "total")
    forest = build(places, ["id", "changed"], height)

    roots = materialize(forest.roots, "subroots")
    tops = ranked(roots, ["grp"], "at").select(
        F.lit(0).alias("grp"), "at", F.col("at_of").alias("total"), "digest", F.col("grp").alias("of"))
    top = build(tops, ["of"], height)
    start = top.roots.select("grp", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    # Each member of a lowest block of this tree is a group.
    above = materialize(_group_paths(with_paths(top, start), height), "above")
    return _proofs(with_paths(forest, above), height, id_col, id_type(docs, id_col))


def _group_paths(blocks: DataFrame, height: int) -> DataFrame:
    """(grp, path, subroot, root) of the groups in the lowest blocks of the tree of roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("grp", pa.string()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                names = row["members"]["of"]
                block = Block(row["nodes"], len(names), min(height, levels_above(row["total"])))
                yield record_batch(out, [
                    names, [block.path(i) + row["path"] for i in range(len(names))],
                    [block[block.height, i] for i in range(len(names))], [row["root"]] * len(names)])

    return blocks.mapInArrow(run, "grp string, path binary, subroot binary, root binary")


def _proofs(blocks: DataFrame, height: int, id_col: str, id_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("members").type.field("id").type.value_type
            out = pa.schema([("id", kind), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof", "folded"))])
            for row in batch.to_pylist():
                ids, changed, columns = row["members"]["id"], row["members"]["changed"], [[] for _ in out]
                block = Block(row["nodes"], len(ids), min(height, levels_above(row["total"])))
                for i, key in enumerate(ids):
                    leaf, path = block[block.height, i], block.path(i) + row["path"]
                    found = (key, leaf.hex(), row["subroot"].hex(), row["root"].hex(),
                             digest_of(*siblings(path)).hex(), fold(changed[i] or leaf, path).hex())
                    for column, value in zip(columns, found, strict=True):
                        column.append(value)
                yield record_batch(out, columns)

    rows = blocks.select("total", "nodes", "members", "path", "subroot", "root")
    found = rows.mapInArrow(run, f"id {id_kind}, leaf string, subroot string, root string, proof string, folded string")
    return found.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
