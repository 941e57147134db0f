"""Importances of fitted models come from all test rows against all train rows; many masks at a leaf."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import explain as X
from tessera.operators import models as ML
from tessera.plans import q_models as Q


def test_all_rows_are_explained_against_the_whole_train_split(spark, monkeypatch):
    frame = lambda n, seed: spark.range(n).select(
        (F.col("id") % 900).alias("row_id"), *[F.round(F.rand(seed + i), 2).alias(c) for i, c in enumerate(Q.FEATS)])
    tr, te = frame(700, 1).persist(), frame(1300, 50).persist()
    one, two = Q.FEATS[:2]
    model = ML.fit("XGBoost", tr.withColumn("label", (F.col(one) + F.col(two) > 1).cast("double")), Q.FEATS, rounds=2, max_depth=3)
    monkeypatch.setattr(Q, "prepared", lambda *a: (SimpleNamespace(classes=["no", "yes"]), tr, te))
    monkeypatch.setattr(Q, "fitted", lambda *a: (model, None))
    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setattr(X, "EXPLAINED_ROWS", 400)
    monkeypatch.setattr(X, "BACKGROUND_ROWS", 300)
    got = {r["feature"]: r["mean_abs_shap_all_classes"] for r in Q._fitted_importance(spark, "rows", "XGBoost").collect()}
    x, z = (d.select(*Q.FEATS).toPandas().to_numpy(float) for d in (te, tr))
    phi = np.zeros((len(x), len(Q.FEATS), 2))
    for tree in model.walk_trees():
        X.two_sample_walk(tree, x, z, False, phi)
    want = np.abs(phi / len(z)).mean(axis=(0, 2))
    assert want[:2].min() > 0.001
    assert [got[f] for f in Q.FEATS] == pytest.approx(list(want), abs=1e-12)


@pytest.mark.parametrize("features", [1, 4, 9])
def test_sums_over_subsets_equal_those_over_pairs(features):
    rng = np.random.default_rng(features)
    used = np.sort(rng.choice(15, features, replace=False))
    bits = np.int64(1) << np.arange(15, dtype=np.int64)
    masks = lambda n: np.unique((rng.random((n, features)) < 0.4) @ bits[used])
    ux, uz = masks(200), masks(300)
    n = rng.integers(1, 50, len(uz))
    assert np.allclose(X._by_subsets(ux, uz, n, used), X._by_pairs(ux, uz, n, bits[used]), atol=1e-9)
