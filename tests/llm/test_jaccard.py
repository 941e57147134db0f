"""The join against all pairs of literal shingle sets."""

import random

import numpy as np
import pytest
from llm_brute import components

from tessera.llm import jaccard

from llm_rows import documents

SF_SMALL = "/root/testdata/sf0.001"


def _texts(seed, n=240):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    base = [rng.choices(vocabulary, k=rng.choice((3, 5, 12, 60, 120))) for _ in range(12)]
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += passage
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 900])
def test_components_equal_brute_force(spark, block):
    rows = _texts(5)
    got = jaccard.jaccard_components(documents(spark, rows), block_shingles=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_driver_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = jaccard.jaccard_components(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(10 - i, " ".join(base[:100 - 3 * i] + [f"x{j}" for j in range(3 * i)])) for i in range(8)]
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[1] for k, v in components(rows).items()}
    assert len({r["component_id"] for r in got}) == 1


def test_ids_of_null_and_copies(spark):
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (3, "a  b c d e f"), (None, "lonely words without any id here")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, rows)).collect()), key=str)
    assert got == [(3, 3), (7, 3), (None, 3), (None, None)]


def test_verify_of_a_group_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        cut = rng.integers(0, 80, rng.integers(0, 16))
        s[cut] = rng.integers(0, 1 << 60, len(cut)).astype(np.uint64)
        sets.append(np.unique(s))
    of = jaccard.verify(sets, np.arange(len(sets)), 80)
    link = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    reach = np.linalg.matrix_power(link.astype(float), 128) > 0
    assert ((of[:, None] == of[None, :]) == reach).all()


def _chain(rng, n, step, size=100):
    """Sets of ``size`` of which each shares all but ``step`` with the one before."""
    tokens = rng.integers(0, 1 << 60, size + step * n).astype(np.uint64)
    return [np.unique(tokens[step * i : step * i + size]) for i in range(n)]


def test_visitors_ask_even_when_their_part_is_the_largest_in_the_group():
    rng = np.random.default_rng(2)
    a = _chain(rng, 40, 10)
    y = a[20].copy()
    y[:10] = rng.integers(0, 1 << 60, 10).astype(np.uint64)  # linked with a[20] and its neighbours only
    z = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets, labels = [*a, np.unique(y), np.unique(z)], np.array([0] * 40 + [1, 2])
    of = jaccard.verify(sets, labels, 80, np.array([True] * 40 + [False] * 2))
    assert of[40] == of[0] and of[41] != of[0]


def test_groups_of_a_loose_cluster_are_bounded(spark, monkeypatch):
    """A cluster of one candidate chain that verification leaves in single sets, and two pairs."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(240)]
    for i in (7, 100):
        sets[i + 1] = np.unique(np.append(sets[i][:48], rng.integers(0, 1 << 60, 2).astype(np.uint64)))
    rows = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "k long, n long, shingles binary")
    clusters = spark.createDataFrame([(i, 0) for i in range(240)], "a long, root long")
    groups, plain = [], jaccard._verified

    def seen(rows, *args, **kw):
        groups.extend(r["s"] for r in rows.selectExpr("cluster", "block", "octet_length(shingles) / 8 as n")
                      .groupBy("cluster", "block").agg({"n": "sum"}).toDF("c", "b", "s").collect())
        return plain(rows, *args, **kw)

    monkeypatch.setattr(jaccard, "_verified", seen)
    found = {r["a"]: r["root"] for r in jaccard.linked(rows, clusters, 80, block_shingles=1200).collect()}
    assert max(groups) < 3.5 * 1200  # of 12,000: a block and a pack, by a hash
    assert {k: v for k, v in found.items() if k != v} == {8: 7, 101: 100}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 102)], "a long, b long")
    roots = {r["a"]: r["root"] for r in jaccard.components(edges).collect()}
    assert set(roots.values()) == {1, 100} and len(roots) == 63
