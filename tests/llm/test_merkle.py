"""Trees, proofs and changed rows against plain Python over whole trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagetally.llm import merkle
from tests.llm.cases import ODD_TEXTS, as_set


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    fields = list(row)
    if fields[3] is not None:
        fields[3] += more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, place, start):
    """The siblings on the way up, and the root that a start leads to."""
    found = []
    for level in tree[:-1]:
        run = level[place // 2 * 2:place // 2 * 2 + 2]
        found += [x for i, x in enumerate(run) if i != place % 2]
        run[place % 2] = start
        start, place = h(*run), place // 2
    return found, start


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([r[2] for r in sorted(groups[g])]) for g in names]
    top, out = levels([t[-1][0] for t in trees]), []
    for i, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for place, (_, _, digest, row) in enumerate(sorted(groups[name])):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            low, folded = climb(tree, place, leaf(row, 1) if tampered else digest)
            high, folded = climb(top, i, folded)
            root = top[-1][0]
            out.append((row[0], digest, tree[-1][0], root, h(*low, *high), folded, folded == root))
    return as_set(out)


def query(docs, **more):
    altered = (docs["n_chars"].cast("decimal(20,0)") + 1).cast("string")
    return merkle.manifest(
        docs, altered={"n_chars": altered},
        is_altered=F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, **more)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_whole_manifest(spark, height):
    """Trees of one to five block levels; groups of 1, 2, 3, 5, 8 and 33 rows and a null group."""
    rows = [(100 * g + i, f"s{i % 3}", name, i, f"text {i} é")
            for g, (name, n) in enumerate([("a", 1), ("b", 2), ("é", 3), ("", 5), ("d", 8), ("en", 33)])
            for i in range(n)]
    rows += [(900 + i, None, None, None, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, None, "en", 3, "no id"), (None, "x", "d", 9223372036854775807, None), (5, "s", "en", 2, "twice"),
             (5, "s", "en", 3, "twice"), (7, "s", "d", 1, "equal"), (7, "s", "d", 1, "equal"), (-7, "s", "d", 1, "minus")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("id", "at", "grp", "block", "root", "digest", "row", "total"):
        docs = docs.withColumn(name, F.lit("extra"))
    got = query(docs, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected(rows)
    assert as_set(got.collect()) == want
    assert {r[-1] for r in want} == {True, False}


def test_one_row_and_none(spark):
    rows = [(1, "s", "en", 4, "text")]
    assert as_set(query(spark.createDataFrame(rows, SCHEMA)).collect()) == expected(rows)
    assert query(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_without_changes_every_row_is_verified(spark):
    rows = [(i, "s", "en", i, "x") for i in range(40)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=3).collect()
    assert len(got) == 40 and all(r.verified for r in got)


@pytest.mark.parametrize("depths", range(1, 12))
def test_layout(depths):
    """Every node has a place of its own, and each half of the levels lies in one run."""
    places = merkle.address(depths)
    assert sorted(p for level in places for p in level.tolist()) == list(range((1 << depths) - 1))
    upper = depths // 2
    assert sorted(p for level in places[:upper] for p in level.tolist()) == list(range((1 << upper) - 1))
    size = (1 << (depths - upper)) - 1
    for j in range(1 << upper if upper else 0):
        run = [places[upper + d][(j << d) + i] for d in range(depths - upper) for i in range(1 << d)]
        assert max(run) - min(run) == size - 1 and min(run) == places[upper][j]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31, 32])
def test_a_changed_sibling_or_leaf_changes_the_root(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    block = merkle.Block.build(leaves, merkle.levels_above(n))
    again = merkle.Block(bytes(block.nodes), n, block.height)
    for i in range(n):
        path = again.path(i)
        assert merkle.fold(leaves[i], path) == block[0, 0]
        assert merkle.fold(bytes(32), path) != block[0, 0]
        for at in range(0, len(path), merkle.ENTRY):
            if path[at] != merkle.ALONE:
                broken = path[:at + 1] + bytes(32) + path[at + 33:]
                assert merkle.fold(leaves[i], broken) != block[0, 0]
