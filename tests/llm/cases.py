"""Awkward documents that every operator has to take."""

import random

from pyspark.sql import functions as F

ODD_TEXTS = [None, "", " ", "\n\t\x0b", "a", "A b", "é", "<|im_end|>", "x" * 5000, "same text here", "same text here"]


def documents(spark, texts, first=0, **names):
    """doc_id and text, with extra columns whose names the operators use inside."""
    rows = [(None if t is Ellipsis else first + i, None if t is Ellipsis else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "row", "words", "head", "fp", "key", "ids", "line", "kept", "grp", "shard", "n"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def words(rng, n, vocabulary=("the", "And", "of", "tree", "über", "Straße", "x1", "good", "word")):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def seeded(seed):
    return random.Random(seed)


def as_set(rows):
    return sorted(map(tuple, rows), key=str)
