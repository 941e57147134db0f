"""Fingerprints of very repetitive texts, and ids that are no numbers."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint as P


@pytest.mark.parametrize("n", [20_000, 32_768, 65_538, 200_000])
def test_repeated_words_stay_alike(n):
    a, b, other = ("word " * n).encode(), ("word " * (n + 3)).encode(), b"quite another text " * 50
    assert P.likeness(P.vectors([a]), P.vectors([b])) > 0.99
    assert P.likeness(P.vectors([a]), P.vectors([other])) < 0.1
    assert P.likeness(P.vectors([a]), P.parsed(P.written(P.vectors([a])))) == 1.0


def test_sums_and_differences_keep_their_sign():
    a, b = P.vectors([b"x y z x y z " * 30_000]), P.vectors([b"p q r"])
    assert (P.minus(P.plus(b, a), a) == b).all()


@pytest.mark.parametrize("buckets", [1, 4, 9])
def test_text_ids_stand_in_their_order(spark, buckets):
    ids = [f"doc-{i:04d}" for i in range(300)] + ["é", "", None, None, "doc-0007"]
    rows = [(k, f"text number {i} of many") for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r["fingerprint"]: r for r in P.fingerprint_chain(docs, buckets=buckets).collect()}
    sums = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -sums[r[1]]), reverse=True)
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(order, [*order[1:], order[0]]):
        own, new = (P.vectors(P.paragraphs(t)) for t in (text, following))
        r = got[P.written(own)]
        assert r["doc_id"] == key and r["near_next"] == P.likeness(own, new)
