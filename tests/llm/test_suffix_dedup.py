"""Removed bytes against a count of every string of 200 bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from pagetally.llm import suffix_dedup as sd
from tests.llm.cases import ODD_TEXTS, as_set, documents, seeded


def expected(rows):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i:i + sd.LENGTH] for i in range(len(data) - sd.LENGTH + 1))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        spans = []
        for i in range(len(data) - sd.LENGTH + 1):
            if seen[data[i:i + sd.LENGTH]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + sd.LENGTH
                else:
                    spans.append([i, i + sd.LENGTH])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        out.append((key, len(data), len(data) - len(kept), tuple(map(tuple, spans)), hashlib.sha256(kept).hexdigest()))
    return as_set(out)


def got(df, **options):
    rows = sd.remove_repeats(df, **options).collect()
    return as_set((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), r.kept_sha256)
                  for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = seeded(8)

    def text(n, letters="abcdefghij é"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [text(n) for n in (150, 180, 198, 200, 201, 260, 400, 900)]
    out = [(i, "".join(rng.choice([text(rng.randrange(150)), rng.choice(passages)])
                       for _ in range(rng.randrange(8)))) for i in range(60)]
    wave = text(161)
    edge = text(199)
    out += [(100, "a" * 199), (101, "b" * 200), (102, "c" * 201), (103, "de" * 150), (104, "xyz" * 100 + text(50)),
            (105, wave * 3), (106, (wave * 3)[5:380]), (107, edge + "q"), (108, edge + "r"), (109, "r" + edge),
            (110, out[3][1]), (None, out[4][1]), (5, out[5][1]), (5, out[6][1])]
    return out + list(enumerate(ODD_TEXTS, 200))


@pytest.mark.parametrize("small_group, batches", [(sd.SMALL_GROUP, sd.BATCHES), (1, 3)])
def test_removed_bytes(spark, rows, monkeypatch, small_group, batches):
    """Windows compared in one task, and all of them by splitting runs."""
    monkeypatch.setattr(sd, "SMALL_GROUP", small_group)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    assert got(df, batches=batches) == want
    assert sum(w[2] > 0 for w in want) > 30 and sum(w[2] == 0 for w in want) > 10


def test_no_documents_and_no_repeats(spark):
    assert sd.remove_repeats(documents(spark, [])).isEmpty()
    assert got(documents(spark, ["x" * 150, None])) == expected([(0, "x" * 150), (1, None)])


def test_long_texts_are_sampled_in_pieces(monkeypatch):
    """Every window has the head that a window with the same bytes has anywhere else."""
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 105, 5000, np.uint8))
    whole = sd.Sampler()
    heads = {}
    for found, _, firsts, lasts in whole.runs(data):
        for head, first, last in zip(found, firsts, lasts):
            for p in range(first, last + 1):
                heads[data[p:p + sd.LENGTH]] = head
    monkeypatch.setattr(sd, "PIECE", 700)
    seen = 0
    for shift in (0, 1, 333):
        for found, _, firsts, lasts in sd.Sampler().runs(data[shift:]):
            for head, first, last in zip(found, firsts, lasts):
                for p in range(first, last + 1):
                    assert heads[data[shift + p:shift + p + sd.LENGTH]] == head
                    seen += 1
    assert seen == sum(len(data) - s - sd.LENGTH + 1 for s in (0, 1, 333))
    assert len({h for h in heads.values()}) < len(data) / 60


def test_family_merges_equal_sizes(spark):
    family = sd.Family(spark)
    sizes = []
    for batch in range(5):
        family.add(spark.range(batch * 10, batch * 10 + 12).withColumnRenamed("id", "head"))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    assert {r.head for r in family.repeated_heads().collect()} == {
        b * 10 + i for b in range(1, 5) for i in (0, 1)}
    assert family.levels[2].read().count() == 42
    family.drop()


def test_clean_keeps_columns_nulls_and_valid_text(spark):
    rng = seeded(9)
    passage = "".join(rng.choice("äöü xyz") for _ in range(300))
    texts = [None, "", "front ä" + passage + "ä back", "other é" + passage + "é end", "alone " * 3, passage + "!"]
    df = documents(spark, texts)
    out = sd.clean(df)
    assert out.columns == df.columns
    found = {r.doc_id: r.text for r in out.collect()}
    spans = {r.doc_id: r.spans for r in sd.remove_repeats(df).collect()}
    for i, text in enumerate(texts):
        data = None if text is None else text.encode()
        for s in reversed(spans[i]):
            data = data[:s.start] + data[s.end:]
        assert found[i] == (None if data is None else data.decode("utf-8", "ignore"))
    assert found[2].startswith("front") and found[2].endswith("back") and len(found[2]) < 20


def test_clashing_names_and_no_leftovers(spark):
    rng = seeded(9)
    passage = "".join(rng.choice("abc ") for _ in range(300))
    df = documents(spark, ["one" + passage, "two" + passage, None])
    for name in ("_null", "_k1", "_k2", "_kept", "_text", "__Text"):
        df = df.withColumn(name, df["key"])
    tables = spark.catalog.listTables()
    out = sd.clean(df)
    assert out.columns == df.columns
    assert [(r.text, r._kept) for r in out.orderBy("doc_id").collect()] == [("one", "extra"), ("two", "extra"), (None, "extra")]
    assert spark.catalog.listTables() == tables


def test_a_failure_leaves_no_tables(spark, monkeypatch):
    tables = spark.catalog.listTables()
    monkeypatch.setattr(sd, "_edges", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sd.clean(documents(spark, ["x" * 300, "y" + "x" * 300]))
    assert spark.catalog.listTables() == tables
