"""Laws of the result, and fewer cut links than an even spread has."""

import zlib
from collections import Counter, defaultdict

import pytest

from pagetally.llm import sharding
from pagetally.llm.common import numbered
from tests.llm.cases import ODD_TEXTS, documents, seeded


def check(df, texts, shards):
    rows = sharding.assign(df, shards=shards).collect()
    assert len(rows) == len(texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_key][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    return (sum(pairs(sum(g.values())) - sum(map(pairs, g.values())) for g in groups.values()),
            sum(pairs(sum(g.values())) for g in groups.values()))


def test_small_groups_are_kept_whole(spark):
    rng = seeded(12)
    texts = [(i, f"text {rng.randrange(60)}" if i % 3 == 0 else f"own {i}") for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    cut, total = check(df, texts, 8)
    assert total > 300 and cut == 0


def test_a_group_larger_than_shards_is_cut_no_more_than_it_must(spark):
    texts = [(i, "same" if i % 3 == 0 else f"own {i}") for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    cut, total = check(df, texts, 10)
    # 300 copies in shards of 90 have at least this many links between shards.
    least = total - 3 * (90 * 89 // 2) - 30 * 29 // 2
    assert least <= cut < 0.9 * total


def test_pairs_beside_a_hot_group_are_kept_whole(spark):
    texts = ["hot"] * 1330 + [f"pair {i % 200}" for i in range(400)] + [f"ten {i % 40}" for i in range(400)]
    texts += [f"own {i}" for i in range(4000 - len(texts))]
    seeded(15).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(df, list(enumerate(texts)), 20)
    shards = defaultdict(set)
    for r in sharding.assign(df, shards=20).collect():
        shards[texts[r.doc_id]].add(r.shard)
    assert [t for t, s in shards.items() if t.startswith(("pair", "ten")) and len(s) > 1] == []


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_odd_documents(spark, shards):
    df = documents(spark, ODD_TEXTS)
    check(df, list(enumerate(ODD_TEXTS)), shards)
    repeated = [(1, "a"), (1, "a"), (1, None), (None, ""), (None, "b")]
    check(spark.createDataFrame(repeated, "doc_id long, text string"), repeated, shards)


def test_no_documents(spark):
    assert sharding.assign(documents(spark, [])).isEmpty()


def test_cut_links(spark):
    df = spark.createDataFrame([("a", 0)] * 3 + [("a", 1)] * 2 + [("b", 1)] * 4, "grp string, shard int")
    assert sharding.cut_links(df) == 6


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 0, id % 7) AS k")
    found = defaultdict(list)
    for r in numbered(df, ["k"], "nth").collect():
        found[r.k].append(r.nth)
    assert all(sorted(n) == list(range(len(n))) for n in found.values())
    assert sorted(r.nth for r in numbered(df, [], "nth").collect()) == list(range(1000))


def test_only_built_in_functions(spark):
    """No Python runs on the executors."""
    plan = sharding.assign(documents(spark, ["a", "a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
