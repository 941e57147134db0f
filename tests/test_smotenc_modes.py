"""Categorical values of synthetic rows: one row a seed, not one for each neighbour and column."""

import re

from pyspark.sql import functions as F

from tessera.operators import smotenc as S


def test_modes_are_taken_from_arrays(spark):
    rows = [(0, [3.0, 1.0, 3.0]), (1, [2.0, 1.0]), (2, [5.0]), (3, [None, None, 1.0]), (4, [None, 1.0]), (5, [float("nan"), 2.0, float("nan")])]
    df = spark.createDataFrame(rows, "id long, a array<double>")
    got = df.select("id", F.transform("a", lambda v: F.struct(v.alias("c"))).alias("c")).select("id", S._mode("c").alias("m")).collect()
    counted = df.select("id", F.explode("a").alias("v")).groupBy("id", "v").count()
    want = counted.groupBy("id").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("m")).collect()
    assert {r["id"]: str(r["m"]) for r in got} == {r["id"]: str(r["m"]) for r in want}


def test_a_seed_is_joined_once(spark):
    rows = [(i, "a" if i % 5 else "b", float(i * 7 % 11), float(i % 13), float(i % 3), float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, c string, x double, y double, p double, q double")
    out = S.smotenc(df, "c", "row_id", ["x", "y"], ["p", "q"])
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not [line for line in joins if re.search(r"\(nn_rank#\d+L? = ", line)]
    assert {r["c"]: r["n"] for r in out.groupBy("c").agg(F.count("*").alias("n")).collect()} == {"a": 96, "b": 96}
