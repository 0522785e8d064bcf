"""Queries where the session's master is a cluster and the shared folder is a mount."""

import pytest

import __spark_entry__ as contract
from tests.llm.cases import as_set, seeded, words

WRITE_INTERMEDIATE_TABLES = [
    "pipeline",
    "op1_suffix_dedup",
    "op3_decontamination",
    "op8_simhash",
    "op9_sharding",
    "op12_merkle",
    "op13_token_archive",
    "op2_warc",
    "op11_collocations",
    "op7_chat",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, folder = seeded(4), str(tmp_path_factory.mktemp("tables"))
    names = [f"w{i}" for i in range(300)]
    texts = [words(rng, 100, names) + ". one two" * 4 for _ in range(40)]
    texts += [texts[0], texts[1] + " " + texts[2], None, ""]
    tables = {
        "documents": ([(i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)],
                      "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, texts[5]), (1, words(rng, 30, names))], "item_id long, text string"),
        "pages": ([(i, f"http://h{i % 3}/{i}", f"<p>{i % 7}</p>") for i in range(20)],
                  "page_id long, url string, html string"),
        "conversations": ([(i // 4, i % 4, ("user", "assistant")[i % 2], f"text {i}") for i in range(40)],
                          "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", WRITE_INTERMEDIATE_TABLES)
def test_a_cluster_with_a_shared_mount_gives_the_same_rows(spark, folder, monkeypatch, name):
    want = as_set(contract.queries()[name](spark, folder).collect())
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert as_set(contract.queries()[name](spark, folder).collect()) == want
    assert want
