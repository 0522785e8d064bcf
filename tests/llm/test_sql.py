"""Queries against their SQL, and the columns of every query, on the given tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from pagetally.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import TESTDATA
from tests.llm.cases import as_set

FOLDER = f"{TESTDATA}/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op2_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op3_decontamination":
        "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op4_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op5_sentencepiece": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op6_quality": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint "
                   "n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op7_chat": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string "
                "formatted_chars:bigint",
    "op8_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op9_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op10_licenses": "doc_id:bigint licenses:string sentence_ids:string n_sentences:bigint",
    "op11_collocations": "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
    "op12_merkle": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string "
                   "verified:boolean",
    "op13_token_archive": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
}


def test_every_query_is_listed():
    assert set(QUERIES) == set(COLUMNS)
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    table, extra = {"op2_warc": ("pages", 0), "op7_chat": ("conversations", 1)}.get(name, ("documents", 0))
    result = QUERIES[name](spark, FOLDER)
    first = [f"{n}:{t}" for n, t in result.dtypes][:len(COLUMNS[name].split())]
    assert first == COLUMNS[name].split()
    if name == "op11_collocations":
        # Its rows are phrases; the SQL says which.
        assert not result.isEmpty()
        return
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() if name == "op7_chat" else rows.count()
    assert result.count() == want + extra


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    expected = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    got = QUERIES[name](spark, FOLDER).select(*names)
    assert as_set(got.collect()) == as_set(expected.fetchall())


def test_pipeline_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
