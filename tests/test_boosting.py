"""Boosting and extra trees: fits do not depend on the layout, folds equal fits of their own, leaves keep their sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as ML
from tessera.operators.boosting import SoftmaxBooster, best_split, fit_bins
from tessera.operators.extratrees import ExtraTrees, _whole

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 9000  # more than two blocks
    a, b = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
    c = np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n))
    y = (a + b / 3 + rng.normal(scale=0.4, size=n) > 1).astype(int) + (np.nan_to_num(c) > 1.2)
    rows = [(i, float(a[i]), float(b[i]), None if np.isnan(c[i]) else float(c[i]), float(y[i]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, fold int").repartition(5).cache()


def test_trees_do_not_depend_on_the_layout(table):
    splits = fit_bins(table, FEATURES)
    models = [SoftmaxBooster(rounds=3, max_depth=4, checkpoint_every=every).fit(t, FEATURES, splits=splits)
              for t, every in ((table, 2), (table.coalesce(1), 20), (table.repartition(7), 1))]
    assert models[0].trees == models[1].trees == models[2].trees
    assert len(models[0].trees) == 3 and all(any(isinstance(v, tuple) for v in t.values()) for r in models[0].trees for t in r)


def test_first_tree_equals_a_plain_search(table):
    """Root split of every class against all (feature, bin) pairs over the rows themselves."""
    b = SoftmaxBooster(rounds=1, max_depth=1, subsample=1.1, colsample=1.1)
    model = b.fit(table, FEATURES)
    rows = table.toPandas()
    for c in range(3):
        g = np.floor((1 / 3 - (rows["label"] == c)) * 2**24 + 0.5) / 2**24
        h = np.full(len(rows), np.floor(2 / 3 * 2 / 3 * 2**24 + 0.5) / 2**24)
        best = (0.0, None)
        for f, name in enumerate(FEATURES):
            for k, edge in enumerate(model.splits[name][1:-1]):
                left = (rows[name] < edge).to_numpy()
                if h[left].sum() < 5 or h[~left].sum() < 5:
                    continue
                gain = 0.5 * (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, k), -0.05 * g[left].sum() / (h[left].sum() + 1), -0.05 * g[~left].sum() / (h[~left].sum() + 1))
        tree = model.trees[0][c]
        assert tree[0] == best[1] and np.allclose([tree[1], tree[2]], best[2:])


def test_sibling_is_parent_less_child():
    """A histogram got by subtraction gives the split of the one that is counted."""
    rng = np.random.default_rng(1)
    parent, child = rng.integers(0, 2**24, (2, 3, 9)), rng.integers(0, 2**20, (2, 3, 9))
    allowed = np.ones(3, bool)
    assert best_split(parent - child, allowed, 1.0, 0.0) == best_split(np.subtract(parent, child), allowed, 1.0, 0.0)
    assert best_split(np.zeros((2, 3, 9), np.int64), allowed, 1.0, 5.0)[0] == -1


def test_folds_equal_fits_without_them(table):
    booster = SoftmaxBooster(rounds=3, max_depth=3)
    models, counts = booster.fit_folds(table, FEATURES, "label", "row_id", "fold", 3)
    splits = models[0].splits
    assert models[0].trees == booster.fit(table, FEATURES, splits=splits).trees
    for f in range(3):
        alone = booster.fit(table.where(F.col("fold") != f), FEATURES, splits=splits)
        assert alone.trees == models[f + 1].trees
        held = ML.predict(alone, table.where(F.col("fold") == f), FEATURES, 3)
        want = {(r["label"], r["prediction"]): r["count"] for r in held.groupBy("label", "prediction").count().collect()}
        assert want == {(r["label"], r["prediction"]): r["n"] for r in counts.where(F.col("fold") == f).collect()}


def test_boosting_learns_and_scores(table):
    model = SoftmaxBooster(rounds=25, max_depth=4, eta=0.2).fit(table, FEATURES)
    out = ML.predict(model, table, FEATURES, 3)
    assert out.where("prediction = label").count() > 0.85 * table.count()
    assert abs(sum(model.feature_importances().values()) - 1) < 1e-9


@pytest.mark.parametrize("local", [None, 500, 3000])
@pytest.mark.parametrize("depth", [None, 3])
def test_extra_trees_keep_rows_and_sizes(table, local, depth):
    model = ExtraTrees(n_trees=6, min_leaf=10, local_rows=local, max_depth=depth).fit(table, FEATURES)
    for t in range(6):
        parts = {r["root"]: model._arrays(r) for r in model.table().where(F.col("tree") == t).collect()}
        assert (0 in parts) == (local is None)
        feature, counts = np.concatenate([p[0] for p in parts.values()]), np.concatenate([p[3] for p in parts.values()])
        assert counts.sum(axis=1).max() == 9000 and counts.sum(axis=1).min() >= 10
        tree = _whole(parts)
        leaf = tree.feature < 0
        assert np.allclose(tree.value[leaf].sum(axis=1), 1)
        x = table.select(*FEATURES).toPandas().to_numpy(float)
        from tessera.operators.treewalk import walk
        share = walk(tree, x, True)
        labels = table.select("label").toPandas()["label"].to_numpy(int)
        # the leaves' shares are those of the rows that reach them
        reached: dict = {}
        for s, y in zip(map(tuple, share), labels):
            reached.setdefault(s, []).append(y)
        if depth is not None:
            for s, ys in reached.items():
                assert np.allclose(np.bincount(ys, minlength=3) / len(ys), s)
    out = model.predict_frame(table, FEATURES).toPandas()
    assert len(out) == 9000 and (out["prediction"] == out["label"]).mean() > (0.75 if depth is None else 0.5)
    assert abs(sum(model.feature_importances().values()) - 1) < 1e-9


def test_extra_trees_do_not_depend_on_the_layout(table):
    shapes = []
    for t in (table, table.repartition(3), table.coalesce(1)):
        model = ExtraTrees(n_trees=3, local_rows=2000).fit(t, FEATURES)
        shapes.append([(w.feature.tolist(), w.threshold.tolist()) for w in model.walk_trees()])
    assert shapes[0] == shapes[1] == shapes[2]


def test_extra_trees_in_groups_of_bytes(table):
    model = ExtraTrees(n_trees=5).fit(table, FEATURES)
    assert [len(r) for r in model.groups(1)] == [1] * 5 and model.groups() == [range(0, 5)]


def test_every_kind_of_model_is_validated_alike(table):
    table = table.fillna(0.0)
    for name, more in (("Decision Tree", {"max_depth": 4}), ("Extra Trees", {"n_trees": 4}), ("XGBoost", {"rounds": 2})):
        model, counts = ML.fit_and_validate(name, table, FEATURES, 3, "fold", 3, **more)
        assert counts.agg(F.sum("n")).first()[0] == 9000
        row = ML.cv_row(counts).first()
        assert 0.3 < row["cv_mean"] <= 1 and row["cv_std"] >= 0
