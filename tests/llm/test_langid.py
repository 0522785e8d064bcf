"""Held-out accuracy on the given documents, vectors and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import langid
from pagetally.llm.queries import op4_language_id
from tests.conftest import TESTDATA
from tests.llm.cases import ODD_TEXTS, documents

ENGLISH = ["the quick brown fox jumps over the lazy dog and then the dog sleeps"] * 3
GERMAN = ["der schnelle braune fuchs springt über den faulen hund und schläft"] * 3
GREEK = ["η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"] * 3


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(t, n) for n, ts in (("en", ENGLISH), ("de", GERMAN), ("el", GREEK)) for t in ts]
    rows += [(None, "en"), ("unlabelled", None), ("", "de")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("vector", F.lit(1))
    return langid.learn(df.repartition(4))


def test_held_out_documents_of_the_given_tables(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()}
    got = op4_language_id(spark, f"{TESTDATA}/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_learned_languages_are_told_apart(spark, profiles):
    texts = ["the dog jumps", "DER HUND SPRINGT", "το σκυλί πηδάει", *ODD_TEXTS, "123 ... !!"]
    got = {r.doc_id: r for r in langid.identify(documents(spark, texts), profiles).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["en", "de", "el"]
    for i, text in enumerate(texts):
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters)
        assert (got[i].score == 0) == (not letters) or letters


def test_prototypes_do_not_depend_on_partitioning(spark, profiles):
    rows = [(t, n) for n, ts in (("el", GREEK), ("de", GERMAN), ("en", ENGLISH)) for t in ts]
    again = langid.learn(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    assert again.labels == profiles.labels == ("de", "el", "en")
    assert (again.rows == profiles.rows).all()


def test_vectors_bind_order_and_bundle_sums():
    space = langid.Space(512)
    packed, counts = langid.sequences("abc abc")
    table = dict(zip(packed.tolist(), space.vectors(packed).astype(int)))
    a, b, c = (space.letter(ord(x)).astype(int) for x in "abc")
    key = ord("a") << 42 | ord("b") << 21 | ord("c")
    assert (table[key] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    want = sum(n * table[p] for p, n in zip(packed.tolist(), counts.tolist()))
    assert (space.bundle([(packed, counts)])[0] == want).all()
    assert abs(np.dot(a, b)) < 150


def test_bundles_of_many_sequences_are_made_in_parts(monkeypatch):
    space, texts = langid.Space(64), [langid.sequences("hello world"), langid.sequences("wide words and more")]
    whole = space.bundle(texts)
    monkeypatch.setattr(langid, "SEQUENCES_AT_ONCE", 3)
    assert (space.bundle(texts) == whole).all()


def test_nothing_learned(spark):
    empty = langid.learn(spark.createDataFrame([], "text string, lang string"))
    got = langid.identify(documents(spark, ["some text", None]), empty).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(documents(spark, []), empty).isEmpty()


def test_many_labels(spark, monkeypatch):
    """1,500 labels, sums sent on in parts, and one label with nearly all rows."""
    alphabet = [chr(0x4E00 + i) for i in range(1500)]
    own = [(c + alphabet[i - 1] + c, f"l{i:04}") for i, c in enumerate(alphabet)]
    rows = spark.createDataFrame(own + [own[7]] * 3000, "text string, lang string").repartition(6)
    whole = langid.learn(rows)
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 100)
    parts = langid.learn(rows.repartition(9))
    assert whole.labels == parts.labels == tuple(n for _, n in own)
    assert (whole.rows == parts.rows).all()
    got = langid.identify(documents(spark, [t for t, _ in own]), whole)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {i: n for i, (_, n) in enumerate(own)}


def test_a_very_long_text(spark, profiles):
    texts = [ENGLISH[0] + " ", "а", "x"]
    got = langid.identify(documents(spark, [t * (6_000_000 // len(t)) for t in texts]), profiles).collect()
    first = next(r for r in got if r.doc_id == 0)
    assert first.lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
