"""What SMOTE-NC sends to the driver, by the plan of a small input."""

import re

from tessera.operators.smotenc import smotenc


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_rows_are_never_broadcast(spark):
    """There is one for each synthetic row, and the planner takes them for a handful."""
    rows = [(i, "a" if i % 5 else "b", float(i % 17), float(i % 11), i % 3) for i in range(200)]
    out = smotenc(spark.createDataFrame(rows, "id long, c string, x double, y double, k int"), "c", "id", ["x", "y"], ["k"])
    rows = out.collect()
    joins = [line for line in _plan(out).splitlines() if re.search(r"Join(\(.*?\))? \[c#\d+, rank#\d+L?\]", line)]
    assert joins and not [line for line in joins if "Broadcast" in line]
    assert [sum(r["c"] == c for r in rows) for c in "ab"] == [160, 160]
