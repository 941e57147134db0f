"""A large table of the toxicity model is sent in groups: no word of a text is written or shuffled."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity


def _rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)) + (["nasty", "foulest"] if i % 2 else ["gentle"])), i % 2) for i in range(500)]
    return [*rows, (None, None, 0), (900, "", 1), (901, rows[0][1], 0), (901, rows[0][1], None)]


def test_texts_are_scored_in_place_by_groups(spark, monkeypatch):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, toxic int")
    one, many = (toxicity.fit(docs, max_rows=n) for n in (100_000, 150))
    assert many.shared.table.count() > 300 and one.shared.sent is not None and many.shared.sent is None
    want = sorted(map(str, one.score(docs).collect()))
    for words in (toxicity.GROUP_WORDS, 100):
        monkeypatch.setattr(toxicity, "GROUP_WORDS", words)
        scored = many.score(docs)
        assert "Exchange" not in scored._jdf.queryExecution().toString() and "Join" not in scored._jdf.queryExecution().toString()
        assert sorted(map(str, scored.collect())) == want


def test_packs_give_parents_back():
    hashes = np.array([3, 7, 11, 2**63], np.uint64)
    for parents in (hashes, np.array([3, 9, 11, 9], np.uint64), np.array([2**63, 1, 1, 5], np.uint64)):
        m, heads, places = toxicity._headed(hashes, parents)
        assert (toxicity._parents(hashes, m, pa.scalar(heads, pa.binary()), pa.scalar(places, pa.binary())) == parents).all()
