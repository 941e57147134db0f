"""Every operator over nulls, empty and very long texts, repeated rows, clashing columns and no rows at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (bpe, decontaminate, fingerprint, html_text, jaccard, licenses, quality, secrets, toxicity,
                         url_filter)

import public_tokenizers

SF_SMALL = "/root/testdata/sf0.001"

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _pages(docs):
    return docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://a.example.net/x"))


def _quality(docs):
    table = quality.with_statistics(docs)
    rows = table.withColumn("quality", (F.col("s_n_words") > 3).cast("int"))
    return table.select("doc_id", quality.fit(rows).score().alias("score"))


def _toxicity(docs):
    model = toxicity.fit(docs.withColumn("toxic", F.col("text").contains("three").cast("int")))
    return model.score(docs).select("doc_id", "score", "predicted")


OPERATORS = {
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "url_filter": lambda d: url_filter.judge(_pages(d), iterations=2),
    "secrets": lambda d: secrets.scan_secrets(d),
    "fingerprint": lambda d: fingerprint.fingerprint_chain(d),
    "quality": _quality,
    "bpe": lambda d: bpe.encode(d, VOCABULARY, PATTERN),
    "decontamination": lambda d: decontaminate.contamination(d, d.withColumnRenamed("doc_id", "item_id")),
    "html": lambda d: html_text.extract(_pages(d)),
    "toxicity": _toxicity,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_out(odd, name):
    assert len(OPERATORS[name](odd).collect()) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none, name):
    assert OPERATORS[name](none).collect() == []


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        assert n == 4 or out.columns == docs.columns
        docs = out if n == 4 else spark.createDataFrame(out.collect(), out.schema)
    assert docs.filter("doc_id = 4").count() == 1
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, 3, 5, 6}


CLASHING = ["score", "predicted", "spans", "redacted", "n_hex", "n_assign", "base_sha256", "component_id", "contaminated", "row", "scored",
            "text_hash", "n_shingles", "a.b"]


@pytest.mark.parametrize("n", range(4))
def test_stages_keep_clashing_columns(spark, odd, n):
    docs = odd.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    out = corpus_pipeline.STAGES[n][1](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_secrets_are_cut_and_counted(spark):
    text = "x " * 9 + "password = abcdefghijklmnop9 end"
    docs = spark.createDataFrame([(1, text, len(text)), (2, None, 7), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_secrets(spark, docs, SF_SMALL).collect()}
    assert "abcdefghijklmnop9" not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"], got[3]["n_chars"]) == (None, 7, "plain", 5)


@pytest.mark.parametrize("n", range(5))
def test_stages_without_rows(spark, none, n):
    docs = none.select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    assert corpus_pipeline.STAGES[n][1](spark, docs, SF_SMALL).collect() == []
