"""Rows that used to get lost or fail: null classes, repeated ids, depth limits, constant columns, far-off points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.ordering import exact_rank, hash_order
from tessera.functions.quantiles import exact_quantiles
from tessera.operators import metrics as ME
from tessera.operators import profile as P
from tessera.operators import sampling as SM
from tessera.operators.boosting import SoftmaxBooster
from tessera.operators.extratrees import ExtraTrees
from tessera.operators.segments import silhouette_sq
from tessera.operators.smotenc import smotenc


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)], "id long, y string")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    return spark.createDataFrame([(i % 150, int(a[0] + 0.3 * a[1] > 0) + int(a[2] > 1), *map(float, a)) for i, a in enumerate(x)],
                                 "row_id long, label int, a double, b double, c double")


def test_rows_without_a_class_stay(classes):
    split = SM.stratified_split(classes, "y", "id", 0.2)
    assert split.count() == 100 and split.where("y is null and split = 'test'").count() == 4
    assert SM.stratified_folds(classes, "y", "id").count() == 100
    assert SM.proportional_group_sample(classes, "y", "id", 50).count() == 50


def test_ranks_do_not_depend_on_the_prefix(spark):
    df = spark.range(2000).select("id", F.lit("g").alias("g"), hash_order("id", 1).alias("h"))
    one = {r["id"]: r["rank"] for r in exact_rank(df, ["g"], "h", "id").collect()}
    two = {r["id"]: r["rank"] for r in exact_rank(df, ["g"], "h", "id", digits=1).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 2001))


def test_synthetic_ids_are_unique(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[(i > 30) + (i > 45)], float(rng.normal()), float(rng.normal()), float(i % 2)) for i in range(60)]
    out = smotenc(spark.createDataFrame(rows, "id long, y string, p double, q double, c double"), "y", "id", ["p", "q"], ["c"])
    assert out.count() == out.select("id").distinct().count() == 93


@pytest.mark.parametrize("cell_points", [2048, 60])
def test_neighbours_of_skewed_points_equal_brute_force(spark, cell_points):
    from tessera.operators.smotenc import knn_within_class
    rng = np.random.default_rng(5)
    xs = np.exp(rng.normal(size=(600, 3)) * 2)
    xs[:150, :2] = 1.0  # many equal points in the cells' features
    rows = [(i, "ab"[i % 7 == 0], *map(float, x), float(i % 3)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "id long, y string, p double, q double, r double, c double")
    got = {}
    for r in knn_within_class(df, df, "y", "id", ["p", "q", "r"], ["c"], 0.5, 4, ["p", "q"], cell_points).collect():
        got.setdefault(r["q_id"], {})[r["nn_rank"]] = r["b_id"]
    for i, y, p, q, r, c in rows:
        near = sorted(((0.0 + (p - a) ** 2 + (q - b) ** 2 + (r - d) ** 2 + (0.5 if c != e else 0.0)), j)
                      for j, z, a, b, d, e in rows if z == y and j != i)[:4]
        assert [got[i][n] for n in (1, 2, 3, 4)] == [j for _, j in near]


def test_boosted_scores_of_repeated_ids(labelled):
    model = SoftmaxBooster(rounds=2, max_depth=3).fit(labelled.withColumn("u", F.monotonically_increasing_id()), ["a", "b", "c"], id_col="u")
    out = model.predict_frame(labelled, ["a", "b", "c"])
    assert out.count() == 300
    from tessera.operators.boosting import bin_frame
    slow = bin_frame(labelled, ["a", "b", "c"], model.splits)
    slow = slow.withColumn("m", model.margins(slow)).select("a", "m").toPandas().sort_values("a")
    fast = out.select("a", "rawPrediction").toPandas().sort_values("a")
    assert np.allclose(np.stack(slow["m"]), np.stack(fast["rawPrediction"]))


@pytest.mark.parametrize("depth", [1, 2, None])
def test_extra_trees_keep_all_rows(labelled, depth):
    df = labelled.withColumn("u", F.monotonically_increasing_id())
    model = ExtraTrees(n_trees=3, min_leaf=5, max_depth=depth).fit(df, ["a", "b", "c"], id_col="u")
    out = model.predict_frame(df, ["a", "b", "c"]).toPandas()
    assert len(out) == 300
    assert np.allclose(np.stack(out["probability"]).sum(axis=1), 1)
    if depth is None:
        assert (out["prediction"] == out["label"]).mean() > 0.7


def test_saved_trees_score_alike(spark, labelled, tmp_path):
    from tessera.operators.treewalk import load_trees, save_trees, tree_sums
    model = ExtraTrees(n_trees=2, min_leaf=20).fit(labelled.withColumn("u", F.monotonically_increasing_id()), ["a", "b", "c"], id_col="u")
    save_trees(spark, f"file://{tmp_path}/trees", model.walk_trees())
    back = load_trees(spark, f"file://{tmp_path}/trees")
    sums = [np.stack(tree_sums(labelled, ["a", "b", "c"], t, model.n_classes, "s", True).toPandas()["s"]) for t in (model.walk_trees(), back)]
    assert np.array_equal(*sums)


def test_labels_outside_the_list_are_negative(spark):
    rows = [("a", [0.9, 0.1]), ("b", [0.2, 0.8]), ("z", [0.5, 0.5]), (None, [0.1, 0.9])]
    got = {r["cls"]: r for r in ME.ovr_auc(spark.createDataFrame(rows, "label string, probability array<double>"), ["a", "b"]).collect()}
    assert [got[c]["positives"] + got[c]["negatives"] for c in "ab"] == [4, 4]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "x double, k double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df, ["x", "k"]).collect()}
    assert got == {("x", "x"): 1.0, ("x", "k"): None, ("k", "x"): None, ("k", "k"): None}


def test_silhouette_far_from_the_origin_and_of_equal_points(spark):
    rows = [(0, 1e8), (0, 1e8 + 0.1), (1, 1e8 + 1), (1, 1e8 + 1.1)]
    got = [r["silhouette"] for r in silhouette_sq(spark.createDataFrame(rows, "cluster int, x double"), ["x"]).collect()]
    assert all(0.9 < s <= 1 for s in got)
    same = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "cluster int, x double")
    assert [r["silhouette"] for r in silhouette_sq(same, ["x"]).collect()] == [0.0] * 4


def test_quantiles_and_boxes_with_a_null_group(spark):
    rows = [(None if i % 3 == 0 else "g", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    assert got == {None: 13.5, "g": 15.0}
    assert {r["g"]: r["n"] for r in P.box_stats(df, ["x"], "g").collect()} == {None: 10, "g": 20}
    assert [r["value"] for r in exact_quantiles(df, "x", [0.25], max_final=3).collect()] == [7.25]


def test_histogram_has_empty_bins_and_a_number_of_its_own(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    assert [r["count"] for r in P.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert P.histogram(df, "x", None).count() == 1 + math.ceil(math.log2(3))


def _visits(spark, n, cell_points, monkeypatch):
    """Visits of all points of a class, and its cells."""
    from tessera.operators import smotenc as N
    rng = np.random.default_rng(n)
    rows = [(i, "a", *map(float, rng.random(2))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y string, p double, q double")
    seen = []
    real = N.near_cells

    def counted(*args):
        out = real(*args)
        seen.append((out.count(), args[1].select("strip", "cell", "part").distinct().count()))
        return out
    monkeypatch.setattr(N, "near_cells", counted)
    got = N.knn_within_class(df, df, "y", "id", ["p", "q"], [], 0.0, 3, ["p", "q"], cell_points)
    near = {(r["q_id"], r["nn_rank"]): r["b_id"] for r in got.collect()}
    monkeypatch.setattr(N, "near_cells", real)
    x = np.array([r[2:] for r in rows])
    for i in range(0, n, 37):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [near[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(n), d))[:3].tolist()
    return seen[0]


def test_visits_grow_with_the_points_not_with_points_times_cells(spark, monkeypatch):
    from tessera.operators import smotenc as N
    few, cells_few = _visits(spark, 1500, 12, monkeypatch)
    many, cells_many = _visits(spark, 6000, 12, monkeypatch)
    assert cells_many > 3 * cells_few > 100
    assert few < 1500 * cells_few / 10 and many < 6 * few  # points times cells grow 16 fold
    monkeypatch.setattr(N, "SENT_NODES", 0)  # levels that are shuffled
    assert _visits(spark, 1500, 12, monkeypatch)[0] == few


@pytest.mark.parametrize("sent", [0, 1 << 30])
def test_many_categories_have_the_same_codes(spark, tmp_path, monkeypatch, sent):
    from tessera.operators import features as FE
    from tessera.operators import rules as R
    from tessera.plans.spec import TableSpec
    monkeypatch.setattr(FE, "SENT_BYTES", sent)
    values = [f"v{i * 7919 % 3000:04d}" for i in range(3000)] + ["é", "", None, "v0007", "v0007"]
    df = spark.createDataFrame([(i, "ab"[i % 2], v, "x" if i % 3 else "y") for i, v in enumerate(values)], "id long, t string, n string, m string")
    few, many = (FE.fit_categories(df, ["n", "m"], most) for most in (10_000, 100))
    assert isinstance(many["n"], FE.CodeTable) and many["m"] == few["m"] == ["x", "y"] and many["n"].size == len(few["n"])
    a, b = ({r["id"]: r["code"] for r in FE.encode_labels(df, "n", c["n"], "code", unknown=-1.0).collect()} for c in (few, many))
    assert a == b and len(a) == len(values)
    new = spark.createDataFrame([(1, "none such"), (2, None)], "id long, n string")
    assert {r["id"]: r["n"] for r in FE.encode_labels(new, "n", many["n"], unknown=-1.0).collect()} == {1: -1.0, 2: None}
    with pytest.raises(Exception, match="unknown label"):
        FE.encode_labels(new, "n", many["n"], strict=True).collect()
    spec = TableSpec(id_col="id", target="t", nominal=("n", "m"))
    pre = FE.Preprocessor(spec=spec, classes=["a", "b"], nominal=many, means={"n": 0.0, "m": 0.0}, stds={}, fill={})
    pre.save(f"file://{tmp_path}/pre")
    back = FE.Preprocessor.load(f"file://{tmp_path}/pre", spec)
    assert sorted(map(tuple, back.encode(df).collect()), key=str) == sorted(map(tuple, pre.encode(df).collect()), key=str)
    assert R.allowed_values(spec, many, spark).count() == len(few["n"]) + 2
