"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""
from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use inside, or that they return
    T.StructField("digest", T.StringType()), T.StructField("size", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("row", T.StringType()), T.StructField("mix", T.StringType()),
    T.StructField("__row", T.StringType()), T.StructField("__digest", T.StringType()), T.StructField("Rank", T.StringType())])


def rows():
    long_text = " ".join(f"w{i % 977} Ünï{i % 13}" for i in range(30000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
        (2, "The quick  brown fox jumps over the lazy dog\nnear the river bank today", "a"),
        (3, "The quick brown fox jumps over the lazy dog near the river bank today", "b"),
        (3, "The quick brown fox jumps over the lazy dog near the river bank today", "b"),   # a repeated row
        (4, None, "a"), (5, "", None), (6, " \t\n\x0b\x0c\r", "b"), (7, long_text, "a"), (8, long_text + " ", "a"),
        (None, "no id here at all", "c"), (None, "no id here at all", "c"), (9, "no id here  at all", None),
        (10, "x", ""), (11, "y" * 5000, "a"), (12, "two words", "d"), (13, "two words", "d"),
        (14, "日本語のテキスト と 絵文字 🙂 nul", "ü"), (15, None, None),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "d", "s", "c", 5, "r", "m", "rr", "dd", "k") for i, t, s in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
