"""Hits against a search for every window of every item."""

import re

import pytest

from pagetally.llm import decontamination as dc
from tests.llm.cases import ODD_TEXTS, as_set, documents, seeded, words

WORD = re.compile(dc.WORD)


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {}
    for key, text in items:
        found = split(text)
        size = min(dc.WINDOW_WORDS, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i:i + size]), set()).add(key)
    out = []
    for key, text in docs:
        found, hit, seen = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(found) - size + 1):
                own = windows.get(tuple(found[i:i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    seen |= own
        ids = tuple(sorted(str(s) for s in seen if s is not None))
        out.append((key, len(found), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(found)))
    return as_set(out)


def got(docs, items):
    rows = dc.decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return as_set((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in rows)


def items_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("vocabulary, lengths", [
    (("a", "B", "cc"), (1, 3, 7, 12, 13, 20)),  # the same grams again and again
    (tuple(f"w{i}" for i in range(300)) + ("Über", "É", "x1"), (13, 14, 40)),
])
def test_hits(spark, vocabulary, lengths):
    rng = seeded(10)
    docs = [(i, words(rng, rng.randrange(150), vocabulary)) for i in range(60)]
    items = [(100 + i, words(rng, n, vocabulary)) for i, n in enumerate(lengths)]
    for i in range(20):
        parts = docs[i][1].split()
        at = rng.randrange(max(1, len(parts) - 20))
        items.append((i, "! ".join(parts[at:at + rng.choice((12, 13, 14, 30))]).upper()))
    items += [(900, None), (901, "..."), (None, docs[3][1]), (100, docs[4][1]), (7, docs[5][1])]
    docs += list(enumerate(ODD_TEXTS, 500)) + [(None, docs[6][1]), (1, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = expected(docs, items)
    assert got(df, items_df(spark, items)) == want
    assert sum(w[2] > 0 for w in want) > 15


def test_clashing_names_and_empty_tables(spark):
    text = words(seeded(11), 30, tuple(f"w{i}" for i in range(90)))
    docs = documents(spark, [text, "other", None])
    items = items_df(spark, [(1, text), (2, "other")])
    assert [r[2] for r in got(docs, items)] == [30, 1, 0]
    assert got(documents(spark, []), items) == []
    assert [r[2:] for r in got(docs, items_df(spark, []))] == [(0, (), False)] * 3


def test_words_lower_ascii_letters_only(spark):
    texts = ["ÀB c-D\x00É", "PLAIN Ascii_text 9", "İstanbul ẞ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(dc.words_of(df["text"])).collect()]
    assert found == [split(t) for t in texts]
