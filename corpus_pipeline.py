"""A training corpus from raw documents, stage by stage.

Each stage takes a session, documents and the folder of tables, and is written as
Parquet and read again before the next one starts. All stages but the last return the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.llm import decontamination, quality_crf, sentencepiece_codec, simhash, suffix_dedup
from pagetally.session import scratch
from pagetally.sources.tables import materialize, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the counted rules or the line labels reject.

    Each row is judged for itself by its text; one without a text, or of fewer than 50 words, goes.
    """
    field = quality_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.keep_good(docs, field)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written with a number of their own for each row, and its column."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts with close fingerprints or similar five-word shingles.

    What close fingerprints lead to is checked on the shingles, too.
    Of the rows of a component the one with the smallest id stays, of several with this id the
    first row, whatever other texts have the same ids; one without an id stays only if
    none has an id. Texts without words are one component; no documents give none.
    """
    rows, row = _numbered(docs)
    with scratch(spark) as outside:
        groups = simhash.similar_copies(rows, row)
        ranked = rows.select(row, "doc_id").join(groups, row)
        order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(row).alias("row"))
        first = ranked.groupBy("component").agg(F.min(order).alias("first"))
        chosen = materialize(first.select(F.col("first.row").alias(row)), "chosen")
        with outside():
            # Fewer than those that stay, so that the texts need a shuffle at larger sizes only.
            copies = materialize(groups.select(row).join(chosen, row, "left_anti"), "copies")
    return rows.join(copies, row, "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes and more that occur again; every document stays.

    Rows that repeat a text, whatever their ids, lose all of it that is long enough; a null text stays null.
    """
    cut = suffix_dedup.clean(docs)
    if "n_chars" not in docs.columns:
        return cut
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", length).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark contaminates, each row for itself."""
    rows, row = _numbered(docs)
    found = decontamination.decontaminate(rows, read_table(spark, sf_dir, "benchmark"), id_col=row)
    # Written, so that the planner knows how few they are and does not shuffle the texts.
    bad = materialize(found.where("contaminated").select(F.col(row)), "contaminated")
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def tokens(
    spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None,
) -> DataFrame:
    """Token ids with their byte spans, and whether decoding them gives the text back.

    A row per document, repeated ids too; a null or empty text has the end id only.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    # In one pass: this stage finds the executors' memory as the stages before it have left it.
    decoded = sentencepiece_codec.encode(docs, path, keep=("text",), decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends",
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_free),
    ("sentencepiece", tokens),
]

# No SQL engine has the line labels, the pieces or connected components at this size; tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again.

    What a stage wrote on its way is deleted when its result is written, or when it fails.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as outside:
            result = stage(spark, docs, sf_dir)
            with outside():
                docs = materialize(result, name)
    return STAGES[-1][1](spark, docs, sf_dir)
