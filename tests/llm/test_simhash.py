"""Fingerprints, links and components against plain Python over all pairs."""

import re

import pytest
import xxhash

from pagetally.llm import simhash
from pagetally.llm.common import connected_components
from tests.llm.cases import ODD_TEXTS, as_set, documents, seeded, words


def expected_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [expected_print(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                name[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    first = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return as_set((key, f"{prints[i]:016x}", first[root(i)]) for i, (key, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows(spark):
    rng = seeded(1)
    base = [words(rng, n) for n in (3, 4, 5, 6, 8, 400, 400)]
    texts = list(ODD_TEXTS)
    for text in base * 4:
        parts = text.split()
        parts[rng.randrange(len(parts))] = rng.choice(("new", "the"))
        texts += [text, " ".join(parts)]
    out = list(enumerate(texts)) + [(None, base[-1]), (3, base[-2]), (3, base[-2])]
    return out


@pytest.mark.parametrize("max_bucket", [64, 1])
def test_components(spark, rows, max_bucket):
    """Once with block joins alone, once with every shared block handled as a large one."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_copies(df, max_bucket=max_bucket).select("doc_id", "fingerprint", "component_id")
    want = expected(rows)
    assert as_set(got.collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 10


def test_close_fingerprints_link_in_both_ways(spark):
    rng = seeded(2)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            s ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(s)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")

    def groups(max_bucket):
        edges = simhash.close_pairs(df, max_bucket)
        found = {}
        for r in connected_components(edges).collect():
            found.setdefault(r.component, set()).add(r.node)
        return sorted(map(sorted, found.values()))

    small, large = groups(1000), groups(1)
    assert small == large and len(small) >= 10


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").union(spark.range(500, 501).selectExpr("id", "id"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)}


def test_a_graph_that_does_not_settle_raises(spark):
    with pytest.raises(RuntimeError, match="did not settle"):
        connected_components(spark.range(300).selectExpr("id AS u", "id + 1 AS v"), max_rounds=1)


def test_no_documents(spark):
    assert simhash.near_copies(documents(spark, [])).isEmpty()


def sets_of(texts):
    return [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def classes_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = simhash._signatures(rows, 5)
    return rows, found.selectExpr("row AS node", "n", "fp", "bands")


@pytest.mark.parametrize("n", [250, 1000])
def test_a_common_line_makes_no_pairs(spark, n):
    """Texts of 25 own words and one line in common; pairs grow with the texts, not with their square."""
    rng, names = seeded(4), [f"word{i}" for i in range(3000)]
    line = words(rng, 12, names)
    rows, classes = classes_of(spark, [words(rng, 25, names) + " " + line for _ in range(n)])
    links, decided = simhash.similar_links(classes, rows, 5, 0.8)
    assert links.isEmpty() and sum(d.count() for d in decided) < 2 * n


@pytest.mark.parametrize("small_band", [16, 1])
def test_texts_of_one_form_are_decided_exactly(spark, small_band):
    """Texts that share three quarters of their words: alike for bands, not similar enough.

    With a small band of one text, rare shingles decide what the bands' first texts leave open.
    """
    rng, names = seeded(5), [f"word{i}" for i in range(3000)]
    form = words(rng, 75, names)
    texts = [form + " " + words(rng, 25, names) for _ in range(120)]
    # Every third text has a copy with its last word changed.
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[::3]]
    rows, classes = classes_of(spark, texts)
    links, decided = simhash.similar_links(classes, rows, 5, 0.8, small_band)
    found, sets = {tuple(r) for r in links.collect()}, sets_of(texts)
    want = {(3 * i, 120 + i) for i in range(40)}
    assert all(jaccard(sets[u], sets[v]) >= 0.8 for u, v in found) and found == want
    if small_band == 1:
        assert sum(d.count() for d in decided) < 25 * len(texts)


def test_texts_of_shared_fillings_make_few_pairs(spark):
    """Texts that share a form and some of their fillings: rare shingles meet, but at most 0.75 agree."""
    rng, names = seeded(8), [f"word{i}" for i in range(3000)]
    form, parts = words(rng, 75, names), [words(rng, 10, names) for _ in range(12)]
    texts, sets = [], []
    for text in (" ".join([form, *rng.sample(parts, 3)]) for _ in range(200)):
        [own] = sets_of([text])
        if all(jaccard(own, other) < 0.75 for other in sets):
            texts.append(text)
            sets.append(own)
    n = len(texts)
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[::3]]
    rows, classes = classes_of(spark, texts)
    links, decided = simhash.similar_links(classes, rows, 5, 0.8, small_band=1)
    assert n > 30 and {tuple(r) for r in links.collect()} == {(3 * i, n + i) for i in range(len(texts) - n)}
    assert sum(d.count() for d in decided[3:]) < n


def test_recall_of_similar_pairs(spark):
    """Of pairs with a similarity of 0.8 to 0.87, alone in their bands, at least 0.97 are found."""
    rng, names = seeded(6), [f"word{i}" for i in range(3000)]
    texts = []
    while len(texts) < 800:
        text = words(rng, rng.choice((60, 200, 400)), names).split()
        other = list(text)
        for _ in range(max(1, len(text) // 50)):
            other[rng.randrange(len(other))] = "changed"
        pair = [" ".join(text), " ".join(other)]
        if 0.8 <= jaccard(*sets_of(pair)) <= 0.87:
            texts += pair
    rows, classes = classes_of(spark, texts)
    found = {tuple(r) for r in simhash.similar_links(classes, rows, 5, 0.8)[0].collect()}
    assert found <= {(i, i + 1) for i in range(0, 800, 2)} and len(found) >= 0.97 * 400


def test_close_fingerprints_are_candidates_of_similar_copies(spark):
    """Without any band, texts at most two bits apart are still met, and checked on their shingles."""
    rng, names = seeded(7), [f"word{i}" for i in range(3000)]
    base = [words(rng, 1500, names) for _ in range(5)]
    texts = base + [t.rsplit(" ", 1)[0] + " changed" for t in base]
    rows, classes = classes_of(spark, texts)
    prints = {r.node: r.fp & (1 << 64) - 1 for r in classes.collect()}
    close = {(i, 5 + i) for i in range(5) if (prints[i] ^ prints[5 + i]).bit_count() <= 2}
    assert close
    # A text with the fingerprint of another one, but none of its shingles.
    stranger = classes.where("node = 0").selectExpr("99L AS node", "n", "fp", "CAST(array() AS array<long>) AS bands")
    rows = rows.union(spark.createDataFrame([(99, words(rng, 1500, names))], rows.schema))
    lone = classes.selectExpr("node", "n", "fp", "CAST(array() AS array<long>) AS bands").union(stranger)
    links, decided = simhash.similar_links(lone, rows, 5, 0.8)
    assert {tuple(r) for r in links.collect()} == close
    assert (0, 99) in {tuple(r) for r in decided[0].collect()}
