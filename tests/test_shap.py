"""Tree SHAP invariants: additivity (sum phi = f(x) - base) and brute-force Shapley
values on random small trees."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import explain as X


def _random_tree(rng, n_feat, depth):
    splits, leaves, nid = {}, {}, [0]

    def build(node, d):
        if d == depth or rng.random() < 0.2:
            leaves[node] = [rng.random() for _ in range(3)]
            return
        left, right = nid[0] + 1, nid[0] + 2
        nid[0] += 2
        splits[node] = (rng.randrange(n_feat), round(rng.random(), 2), left, right)
        build(left, d + 1)
        build(right, d + 1)
    build(0, 0)
    return splits, leaves


def _f(splits, leaves, x, cls):
    n = 0
    while n in splits:
        f, t, l, r = splits[n]
        n = l if x[f] <= t else r
    return leaves[n][cls]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shap_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    nf = 3
    splits, leaves = _random_tree(rng, nf, 3)
    model = X.literal_tree(splits, leaves, 3)
    xs = [(i, *[round(rng.random(), 3) for _ in range(nf)]) for i in range(6)]
    zs = [(100 + i, *[round(rng.random(), 3) for _ in range(nf)]) for i in range(4)]
    feats = [f"f{i}" for i in range(nf)]
    schema = "id long, " + ", ".join(f"{f} double" for f in feats)
    got = {(r["id"], r["feature"], r["class"]): r["phi"] for r in
           X.tree_shap(spark.createDataFrame(xs, schema), spark.createDataFrame(zs, schema), feats, model, "id").collect()}
    for x in xs:
        for i in range(nf):
            for c in range(3):
                tot = 0.0
                others = [j for j in range(nf) if j != i]
                for z in zs:
                    for k in range(len(others) + 1):
                        for S in itertools.combinations(others, k):
                            w = math.factorial(k) * math.factorial(nf - k - 1) / math.factorial(nf)
                            with_i = [x[1 + j] if (j in S or j == i) else z[1 + j] for j in range(nf)]
                            without = [x[1 + j] if j in S else z[1 + j] for j in range(nf)]
                            tot += w * (_f(splits, leaves, with_i, c) - _f(splits, leaves, without, c))
                exp = tot / len(zs)
                assert got.get((x[0], f"f{i}", c), 0.0) == pytest.approx(exp, abs=1e-12)


def test_additivity_on_fitted_tree(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random(), float(rng.randrange(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    df = df.withColumn("label", F.when(F.col("a") + F.col("b") > 1.2, 2.0).when(F.col("a") > 0.5, 1.0).otherwise(0.0))
    m = DecisionTreeClassifier(maxDepth=4, seed=1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    lt = X.spark_trees(m, 3)
    ev, bg = df.where("id < 20"), df.where("id >= 200")
    phi = X.tree_shap(ev, bg, ["a", "b"], lt, "id").groupBy("id", "class").agg(F.sum("phi").alias("s"))
    fx = X.model_output(ev, ["a", "b"], lt, "id")
    base = {r["class"]: r["base"] for r in X.base_values(bg, ["a", "b"], lt).collect()}
    s = {(r["id"], r["class"]): r["s"] for r in phi.collect()}
    for r in fx.collect():
        assert s.get((r["id"], r["class"]), 0.0) == pytest.approx(r["fx"] - base.get(r["class"], 0.0), abs=1e-9)


@pytest.mark.parametrize("kind", ["forest", "booster", "extra"])
def test_fitted_ensembles_match_brute_force(spark, kind):
    """Shapley values of whole ensembles, over all subsets of features of the scoring function itself."""
    import numpy as np

    from tessera.operators import models as ML
    rng = random.Random(3)
    feats = ["a", "b", "c"]
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    rows = [(*r, float(int(r[1] + r[2] > 1.1) + int(r[3] > 0.6))) for r in rows]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double")
    if kind == "forest":
        m = ML.fit("Random Forest", df, feats, n_trees=5, max_depth=5)
        model = X.spark_trees(m, 3)
    else:
        m = ML.fit("XGBoost", df, feats, rounds=4, max_depth=3) if kind == "booster" else ML.fit("Extra Trees", df, feats, n_trees=5)
        model = m.tree_model()
    ev, bg = rows[:3], rows[100:104]
    mixed, keys = [], []
    for x in ev:
        for z in bg:
            for mask in range(8):
                keys.append((x[0], z[0], mask))
                mixed.append((len(mixed), *[x[1 + j] if mask >> j & 1 else z[1 + j] for j in range(3)]))
    table = spark.createDataFrame(mixed, "row_id long, a double, b double, c double")
    if kind == "booster":
        scored = {r["row_id"]: r["rawPrediction"] for r in m.predict_frame(table, feats).collect()}
    else:
        scored = {r["row_id"]: r["probability"] for r in ML.predict(m, table, feats, 3).collect()}
    f = {k: np.array(scored[i]) for i, k in enumerate(keys)}
    got = {(r["row_id"], r["feature"], r["class"]): r["phi"] for r in
           X.tree_shap(df.where("row_id < 3"), df.where("row_id between 100 and 103"), feats, model, "row_id").collect()}
    assert len(got) == 27
    weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    for x in ev:
        for i, name in enumerate(feats):
            want = sum(weight[bin(s).count("1")] * (f[x[0], z[0], s | 1 << i] - f[x[0], z[0], s])
                       for z in bg for s in range(8) if not s >> i & 1) / len(bg)
            assert [got[x[0], name, c] for c in range(3)] == pytest.approx(list(want), abs=1e-9)


def test_background_in_parts_and_trees_in_groups(spark, monkeypatch):
    from tessera.operators import treewalk
    rng = random.Random(9)
    model = X.literal_tree(*_random_tree(rng, 3, 4), 3)
    model.trees = model.trees * 3
    schema = "id long, f0 double, f1 double, f2 double"
    xs, zs = ([(i, *[rng.random() for _ in range(3)]) for i in range(n)] for n in (7, 25))

    def run():
        out = X.tree_shap(spark.createDataFrame(xs, schema), spark.createDataFrame(zs, schema), ["f0", "f1", "f2"], model, "id")
        return {(r["id"], r["feature"], r["class"]): r["phi"] for r in out.collect()}
    whole = run()
    monkeypatch.setattr(X, "BACKGROUND_ROWS", 10)
    monkeypatch.setattr(treewalk, "GROUP_BYTES", 1)
    assert run() == pytest.approx(whole, abs=1e-12)
