"""Conversation repair against a plain search over all ways."""

import random

import brute_conversations as brute
from pyspark.sql import functions as F

from tessera.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _table(spark, rows):
    out = spark.createDataFrame(rows, SCHEMA)
    for name in ("fault", "part", "body", "sum", "copies", "audit", "conv", "_kind", "least"):
        out = out.withColumn(name, F.lit("x"))
    return out


def _got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def _rows(rng, conv, n):
    return [(conv, rng.choice([i, i, max(0, i - 1), i + 1]) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", None]),
             rng.choice(["Hi.", "hi", "", " \t", "What? ", "Yes!\n", "é", None, f"text {rng.randrange(6)}."])) for i in range(n)]


def test_search_equals_plain_search():
    rng = random.Random(1)
    for i in range(800):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 150 if i % 20 == 0 else 9))]
        want = brute.least([(0, r, "t") for r, _ in rows], [C.FAULTS[f] for _, f in rows])[:2]
        assert C.repair(rows) == want


def test_run_tables_join_to_the_whole():
    rng = random.Random(5)
    for _ in range(100):
        rows = [(rng.choice("sua"), rng.choice([0, 0, 1, 3])) for _ in range(20)]
        cut = rng.randint(0, 20)
        parts = C.joined_tables(C.run_table(rows[:cut], C.STATES), C.run_table(rows[cut:], C.STATES))
        assert parts == C.run_table(rows, C.STATES)


def test_odd_rows_equal_plain_repair(spark):
    rng = random.Random(2)
    rows = [r for conv in [None, *range(40)] for r in _rows(rng, conv, rng.randint(1, 14))]
    rows += rng.choices(rows, k=60)  # repeated rows, ties of turns
    table = _table(spark, rows)
    want = brute.repair_all(rows, brute.damage(rows))
    assert _got(C.repaired(C.damaged(table), table)) == want
    undamaged = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _got(C.repaired(table)) == brute.repair_all(rows, undamaged)


def test_a_conversation_over_many_ranges(spark):
    """A third of all rows in one conversation, cut into pieces by the range sort."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{rng.randrange(400)}" + rng.choice(["", ".", "."])) for i in range(700)]
    rows += [r for conv in range(100, 300) for r in _rows(rng, conv, 6)]
    table = _table(spark, rows).repartition(5)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _got(C.repaired(table)) == brute.repair_all(rows, plain)


def test_long_text_and_no_rows(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (2, 0, "user", "")]
    got = _got(C.repaired(_table(spark, rows)))
    assert got == brute.repair_all(rows, rows)
    assert C.repaired(_table(spark, [])).collect() == []
    lost = _table(spark, rows)
    assert _got(C.repaired(lost.limit(0), lost)) == {k: (0, 0, 0, 0, 0, 0, "", EMPTY_HASH) for k in (1, 2)}
