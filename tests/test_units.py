"""Unit tests: guards, persistence, registry, sampling invariants, SMOTE-NC on tiny classes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import models as ML
from tessera.operators import sampling as SM
from tessera.operators.smotenc import smotenc
from tessera.sources import io as IO


def test_registry_and_names():
    assert list(ML.model_registry()) == ["Decision Tree", "Random Forest", "XGBoost"]
    assert "Extra Trees" in ML.model_registry(True)
    assert ML.normalise_model_name("random_forest") == "Random Forest"
    assert ML.normalise_model_name("nope") == ML.DEFAULT_MODEL
    assert ML.normalise_model_name(None) == ML.DEFAULT_MODEL


def test_require_path_and_importance_load(spark):
    with pytest.raises(FileNotFoundError, match="Run the fit step"):
        IO.require_path(spark, "/nonexistent/x.parquet", "Run the fit step first.")
    d = tempfile.mkdtemp(prefix="tessera-test-")
    p = os.path.join(d, "imp")
    spark.createDataFrame([("a", 1.0)], "name string, v double").write.parquet(p)
    assert IO.load_importance(spark, p) is None
    assert IO.load_importance(spark, os.path.join(d, "missing")) is None


def test_split_exact_quotas(spark):
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    s = SM.stratified_split(df, "y", "id", 0.2, 42)
    got = {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(v for (y, sp), v in got.items() if sp == "test") == 200
    assert got[("a", "test")] == 140 and got[("b", "test")] == 40 and got[("c", "test")] == 20


def test_split_layout_independent(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)]
    base = spark.createDataFrame(rows, "id long, y string")
    outs = []
    for n in (1, 4, 16):
        s = SM.stratified_split(base.repartition(n), "y", "id", 0.2, 42)
        outs.append(sorted(r["id"] for r in s.where(F.col("split") == "test").collect()))
    assert outs[0] == outs[1] == outs[2]


def test_folds_balanced(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(403)]
    f = SM.stratified_folds(spark.createDataFrame(rows, "id long, y string"), "y", "id", 5, 42)
    sizes = {(r["y"], r["fold"]): r["n"] for r in f.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in ("a", "b"):
        v = [sizes[(y, k)] for k in range(5)]
        assert max(v) - min(v) <= 1


def test_smotenc_tiny_classes(spark):
    rows = [(1, "big", 1.0, 0.0), (2, "big", 2.0, 1.0), (3, "big", 3.0, 0.0), (4, "big", 4.0, 1.0),
            (5, "small", 10.0, 1.0), (6, "small", 12.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, y string, x double, c double")
    out = smotenc(df, "y", "id", ["x"], ["c"], k_max=5)
    counts = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"big": 4, "small": 4}
    syn = out.where("synthetic").collect()
    assert len(syn) == 2
    for r in syn:  # k = 1: interpolate between the two small rows; categorical = neighbour's
        assert 10.0 <= r["x"] <= 12.0 and r["c"] == 1.0


def test_smotenc_guard(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "id long, y string, x double")
    with pytest.raises(ValueError, match="two rows or more"):
        smotenc(df, "y", "id", ["x"], [])


def test_preprocessor_roundtrip(spark, tmp_path):
    from tessera.operators.features import Preprocessor, fit_preprocessor
    from tessera.plans.spec import TableSpec
    spec = TableSpec(id_col="id", target="y", numeric=("x",), nominal=("g",),
                     ordinal=(("o", ("lo", "hi")),))
    df = spark.createDataFrame([(1, "a", 1.0, "u", "lo"), (2, "b", 3.0, "v", "hi"), (3, "a", None, "u", "zz")],
                               "id long, y string, x double, g string, o string")
    pre = fit_preprocessor(df, spec)
    pre.save(str(tmp_path))
    back = Preprocessor.load(str(tmp_path), spec)
    assert back.classes == ["a", "b"] and back.nominal == {"g": ["u", "v"]}
    enc = {r["id"]: r for r in back.encode(df).collect()}
    assert enc[3]["o"] == -1.0 and enc[2]["g"] == 1.0 and enc[2]["label"] == 1.0
    assert pre.stds["x"] == pytest.approx(1.0)
