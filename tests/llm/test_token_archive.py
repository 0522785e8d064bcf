"""Ids, files and single documents against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetally.llm import token_archive as ta
from tests.llm.cases import ODD_TEXTS, as_set, documents, seeded, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    *ODD_TEXTS, "<|endoftext|>", "a<|endoftext|> b", "it's they'll 'S don't''s", " lead", "trail  ", "tab\tand  two\n\n\nlines \n x",
    "a\xa0b c　d\x85e\x1cf", "12 345x_y-z!? ... é漢字😀 über", "\r\n\x0b\x0cx", "word " * 3000, "᠎x​y﻿z",
]


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """By ascending id, nulls first; rows of one id by length and checksum."""
    made = []
    for key, text in rows:
        crc = zlib.crc32(np.array(ids(text), "<u4").tobytes())
        made.append(((key is not None, key or 0, len(ids(text)), crc), key))
    out, start = [], 0
    for (_, _, n, crc), key in sorted(made, key=lambda x: x[0]):
        out.append((key, start, n, crc))
        start += n
    return as_set(out)


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 ab'sé1漢.!<|>") | st.characters(codec="utf-8"), max_size=40))
def test_pieces_have_the_ids_of_the_whole(text):
    array = ta.encoder(PATH)(text)
    assert np.frombuffer(array, "<u2").tolist() == ids(text)[:-1]


def test_long_texts_are_cut_at_borders(monkeypatch):
    monkeypatch.setattr(ta, "TEXT_AT_ONCE", 7)
    monkeypatch.setattr(ta, "REMEMBERED", 3)
    encode = ta.Encoder(PATH)
    for text in TEXTS:
        assert np.frombuffer(encode(text or ""), "<u2").tolist() == ids(text)[:-1]


def test_other_models_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encode = ta.Encoder(path)
    assert not encode.by_units
    for text in ("Some Words here", "", "x  y\n"):
        assert np.frombuffer(encode(text), encode.width).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows():
    rng = seeded(31)
    out = list(enumerate([*TEXTS, *(words(rng, rng.randrange(1, 300)) for _ in range(100))]))
    rng.shuffle(out)
    return out + [(None, "none"), (None, "other"), (3, "again"), (3, "again"), (3, "different words"), (-1, "first")]


@pytest.mark.parametrize("file_bytes", [1, 2000, ta.FILE_BYTES])
def test_files_read_back(spark, rows, file_bytes):
    """A file per document, a few files a range, and one file a range."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    catalog = ta.write_archive(docs, PATH, 2, file_bytes=file_bytes)
    got = ta.checksums(catalog)
    assert as_set(got.collect()) == expected(rows)
    files = catalog.collect()
    assert sum(f.n_docs for f in files) == len(rows)
    assert (len(files) == len(rows)) == (file_bytes == 1)


def test_single_documents(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] > 3], "doc_id long, text string")
    listed = ta.list_documents(ta.write_archive(docs, PATH, 2, file_bytes=3000))
    got = ta.read_documents(listed.where("id IN (5, 17, 40)")).collect()
    texts = dict(rows)
    assert {r.id: r.ids for r in got} == {k: ids(texts[k]) for k in (5, 17, 40)}


def test_the_dictionary_is_shared_and_checked(spark, tmp_path):
    rng = seeded(32)
    texts = [words(rng, 60) for _ in range(300)]
    docs = documents(spark, texts)
    folder = f"file://{tmp_path}"
    catalog = ta.write_archive(docs, PATH, 2, folder=folder).collect()
    readers = [ta.Reader(f.path) for f in catalog]
    assert len({r.digest for r in readers}) == 1
    dictionary = (tmp_path / f"{readers[0].digest}.dictionary").read_bytes()
    assert zstandard.ZstdCompressionDict(dictionary).dict_id() > 0
    # Without the dictionary a short document cannot be read, and with it it is smaller.
    alone = sum(len(zstandard.compress(np.array(ids(t), "<u2").tobytes(), ta.LEVEL)) for t in texts)
    assert sum(sum(r.index().column("size").to_pylist()) for r in readers) < 0.8 * alone
    (tmp_path / f"{readers[0].digest}.dictionary").write_bytes(dictionary[:-1] + b"?")
    ta._dictionary.cache_clear()
    with pytest.raises(ValueError, match="hash"):
        ta.Reader(catalog[0].path)


def test_no_archive_and_no_documents(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"something that is no archive" * 9)
    with pytest.raises(ValueError, match="no token archive"):
        ta.Reader(f"file://{tmp_path}/x")
    catalog = ta.write_archive(documents(spark, []), PATH, 2)
    assert catalog.isEmpty() and ta.checksums(catalog).isEmpty() and ta.list_documents(catalog).isEmpty()
