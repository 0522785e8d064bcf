"""Pieces and texts against the library, spans and character maps against plain Python."""

import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetally.llm import sentencepiece_codec as sc
from tests.llm.cases import ODD_TEXTS, documents, seeded, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as file:
    BLOB = file.read()
CODEC = sc.Codec(BLOB)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=BLOB)
PARTS = st.sampled_from([" ", "  ", "\n", "▁", "▁▁", "the", "ing", "é", "é", "日本", "😀", "</s>", "<s>", "<unk>",
                         "<0x41>", "\x00", "\r", "\t", "x" * 70, "Straße"])
TEXTS = st.lists(st.one_of(PARTS, st.text(max_size=6)), max_size=12).map("".join).filter(
    lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t))


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_ids_and_text_are_the_library_s(text):
    ids, starts, ends = CODEC.encode(text.encode())
    assert ids.tolist() == LIBRARY.encode(text, add_eos=True)
    assert CODEC.decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
    assert starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=10))
def test_any_ids_decode_like_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_new_chunks_are_merged_in_one_call(monkeypatch):
    """Whatever stands beside a chunk, its ids are those of the chunk alone."""
    codec, rng = sc.Codec(BLOB), seeded(11)
    chunks = sorted({"▁" * rng.randrange(3) + "".join(rng.choice("abßé日😀\r\x00") for _ in range(rng.randrange(1, 9)))
                     for _ in range(2000)} | {"▁", "▁▁", "x" * 200, "▁the", "the"})
    calls, encode = [], codec.merger.encode
    monkeypatch.setattr(codec.merger, "encode", lambda given, **how: calls.append(given) or encode(given, **how))
    got = codec._merge(chunks)
    assert len(calls) == 1 and isinstance(calls[0], str)
    assert got == {c: struct.pack(f"<{len(i)}i", *i) for c, i in zip(chunks, encode(chunks, out_type=int))}
    assert codec._merge(["\n", "a"]) == {c: struct.pack("<i", *encode(c, out_type=int)) for c in ("\n", "a")}


def test_spans_hold_the_text_of_their_pieces():
    text = "The Straße über  all\n日本 end"
    data = text.encode()
    ids, starts, ends = CODEC.encode(data)
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist()):
        if LIBRARY.is_byte(i) or i == LIBRARY.eos_id():
            continue
        assert data[a:b].decode().replace(" ", "▁") == LIBRARY.id_to_piece(i).removeprefix(
            "" if data[a:b].startswith(b" ") else "▁")


def trie(entries):
    """A compiled character map with the given replacements, laid out one unit per label."""
    values, blob = {}, b""
    for key, text in entries.items():
        values[key] = len(blob)
        blob += text + b"\0"
    units = {0: 0}
    free = 1

    def place(at, prefix):
        nonlocal free
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        base = free * 256
        free += 1
        offset = at ^ base
        units[at] = units.get(at, 0) | offset << 10 | (1 << 8 if leaf else 0)
        if leaf:
            units[base] = values[prefix] | 1 << 31
        for label in labels:
            units[base ^ label] = label
        for label in labels:
            place(base ^ label, prefix + bytes([label]))

    place(0, b"")
    table = [units.get(i, 0) for i in range(free * 256)]
    packed = struct.pack(f"<{len(table)}I", *table)
    return struct.pack("<I", len(packed)) + packed + blob


def test_longest_known_prefix_is_replaced_and_remembers_its_place():
    entries = {b"a": b"1", b"ab": b"22", b"abcd": b"", "é".encode(): b"e", b"q": b"  "}
    table = sc.CharacterMap(trie(entries))
    for text in ("a", "ab", "abc", "abcd", "xabcdab", "é", "zq", "ba" * 40):
        data, at = text.encode(), 0
        while at < len(data):
            want = max((k for k in entries if data.startswith(k, at)), key=len, default=None)
            assert table.longest(data, at) == ((len(want), entries[want]) if want else (0, b""))
            at += len(want) if want else 1
    walk = sc.Normalizer(table, dummy_prefix=True, drop_extra_spaces=True, mark_spaces=True)
    normal, places = walk("  xab  abcd é q".encode())
    assert normal.decode() == "▁x22▁e"
    assert places.tolist() == [2, 2, 2, 2, 3, 3, 5, 5, 5, 12, 14]


def test_encode_and_decode_documents(spark):
    rng = seeded(7)
    texts = ODD_TEXTS + [words(rng, 200) for _ in range(20)] + ["long " * 200_000]
    df = documents(spark, texts)
    encoded = sc.encode(df, PATH, keep=("text",))
    got = sc.decode(encoded, PATH).withColumn("covered", sc.span_bytes()).collect()
    assert len(got) == len(texts)
    for r in got:
        text = r.text or ""
        assert r.text == texts[r.doc_id]
        assert r.ids == LIBRARY.encode(text, add_eos=True)
        assert r.decoded == LIBRARY.decode(r.ids)
        assert r.covered == len(text.encode())
    assert sc.encode(documents(spark, []), PATH).isEmpty()


def test_decoding_in_the_same_pass(spark):
    rng = seeded(8)
    texts = ODD_TEXTS + [words(rng, 200) for _ in range(20)] + ["long " * 600_000, "after it"]
    df = documents(spark, texts).withColumn("other", F.col("doc_id") * 2)
    want = sc.decode(sc.encode(df, PATH, keep=("other", "text")), PATH)
    got = sc.encode(df, PATH, keep=("other", "text"), decoded=True)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())
    assert sc.encode(documents(spark, []), PATH, decoded=True).isEmpty()


def test_query_digests(spark, tmp_path):
    from pagetally.llm.queries import op5_sentencepiece
    texts = ["", None, "The end.\nNew  line", "日本"]
    documents(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op5_sentencepiece(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_large_model_files_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sc, "MAX_MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="bytes"):
        sc.encode(documents(spark, ["a"]), PATH).select(F.lit(1))
