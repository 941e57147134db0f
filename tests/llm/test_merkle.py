"""Merkle manifest against plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """(root, [siblings by level as (left, right)] for each node)."""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for i in range(len(nodes)):
            run = at[i] // 16 * 16
            paths[i].append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 16])))
            at[i] //= 16
        level = [_h("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def _plain(rows):
    def lower(row):
        text = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
        return (*row[:4], text)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[source] = own, *_tree([_leaf(r) for r in own])
    root, upper = _tree([trees[s][1] for s in sources])
    out = []
    for source, above in zip(sources, upper):
        own, subroot, paths = trees[source]
        for row, path in zip(own, paths):
            steps = path + above
            node = _leaf(lower(row) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else row)
            for left, right in steps:
                node = _h(left + node + right)
            out.append((row[0], _leaf(row), subroot, root, _h("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def _got(spark, rows, depth=M.LEVELS):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("tree", "pos", "hash", "total", "id", "leaf", "place", "part", "block", "path", "root"):
        table = table.withColumn(name, F.lit("x"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return table, sorted((tuple(r) for r in M.manifest(
        table, claimed={"text": F.translate("text", M._UPPER, M._LOWER)}, when=chosen, depth=depth).collect()), key=str)


def _rows(sizes, rng):
    at = 10**17  # beyond what a float holds
    for source, n in sizes:
        for _ in range(n):
            at += rng.randint(1, 3)
            yield (at, source, rng.choice(["en", None, ""]), rng.choice([None, at % 99]), rng.choice(["Abc É", None, "", f"T{at}"]))


@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 16)], [("a", 17), ("b", 1)], [("a", 257), (None, 3), ("", 15)],
    [(f"s{i}", 1 + i % 3) for i in range(40)], [("hot", 1300), ("é", 256), ("z", 32)]])
def test_equals_plain_recursion(spark, sizes):
    rows = list(_rows(sizes, random.Random(4)))
    assert _got(spark, rows)[1] == _plain(rows)


def test_trees_of_many_exchanges(spark):
    """Small superblocks, so that outer nodes have superblocks of their own."""
    rows = list(_rows([("hot", 700), ("b", 16), *[(f"s{i}", 1) for i in range(20)]], random.Random(6)))
    assert _got(spark, rows, 1)[1] == _plain(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", "x", 1, "B"), (1, "a", None, 2, "Q" * 1_000_000), (1, "a", None, 2, "other"),
            (1, "a", None, 2, "other"), (2, "a", "y", None, "")] + [(5, "b", "l", 0, "Same")] * 300
    table, got = _got(spark, rows)
    assert got == _plain(rows)
    first = M.manifest(table, with_proof=True).collect()
    assert all(r["verified"] and M.folded(r["leaf"], r["proof"]) == r["root"] for r in first)
    assert {M.proof_hash(r["proof"]) for r in first} == {r[4] for r in got}


def test_no_rows(spark):
    assert _got(spark, [])[1] == []
