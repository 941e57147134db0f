"""Rows for the tests."""

from pyspark.sql import types as T

LONG = "word " * 60_000 + "unbroken" * 20_000


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in (
        "lang", "source", "label", "score", "predicted", "n_words", "n_tokens", "ids", "spans", "labels", "n_chars", "w", "h", "k", "n",
        "hash", "component_id", "contaminated", "fingerprint", "_sum", "toxic", "quality", "rank", "block")]])


def documents(spark, rows):
    """(doc_id, text) rows with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *["x"] * (len(SCHEMA) - 2)) for i, t in rows], SCHEMA)


#: nulls in both columns, empty and very long texts, repeated rows, one id for two texts
ODD = [(1, None), (2, ""), (3, LONG), (4, "one two three four five six"), (4, "one two three four five six"),
       (None, "one two three four five six"), (5, "  \n\t "), (6, "héllo wörld — 日本語 \U0001f600"), (6, "another text of that id here")]
