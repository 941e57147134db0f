"""k-means restarts, AUC ranges, the density expansion and type inference against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kmeans as KM
from tessera.operators import metrics as M
from tessera.operators import profile as P
from tessera.operators.blocks import packed
from tessera.sources import io as IO


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.5, (1500, 2)) for m in ((0, 0), (4, 0), (0, 5), (5, 5))])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double").repartition(4).cache()


def test_restarts_find_the_clusters(points):
    model = KM.kmeans_restarts(points, ["a", "b"], k=4, seeds=6)
    assert model.cost == min(model.costs) and len(model.costs) == 6 and max(model.steps) < 100
    assert sorted(np.round(model.centers).tolist()) == [[0, 0], [0, 5], [4, 0], [5, 5]]
    x = points.select("a", "b").toPandas().to_numpy()
    assert model.cost == pytest.approx(KM.distances(x, model.centers).min(axis=1).sum())
    assert [r["count"] for r in model.assign(points).groupBy("cluster").count().collect()] == pytest.approx([1500] * 4, abs=60)


def test_a_step_is_lloyds_and_restarts_do_not_meet(points):
    x = points.select("a", "b").toPandas().to_numpy()
    rng = np.random.default_rng(2)
    centers = rng.normal(2, 3, (5, 3, 2))
    centers[4, 2] = [1e6, 1e6]  # no row is near
    new, n, cost = KM.step(packed(points, ["a", "b"], F.lit(0), F.col("row_id"), None), 2, centers)
    for r in range(5):
        d = ((x[:, None, :] - centers[r]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert n[r].tolist() == np.bincount(own, minlength=3).tolist() and cost[r] == pytest.approx(d.min(axis=1).sum())
        for c in range(3):
            assert new[r, c] == pytest.approx(x[own == c].mean(axis=0) if (own == c).any() else centers[r, c])


def test_restarts_of_few_equal_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "row_id long, a double, b double")
    model = KM.kmeans_restarts(same, ["a", "b"], k=3, seeds=2)
    assert model.cost == 0 and model.centers.tolist() == [[1.0, 2.0]] * 3


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e-300])
def test_auc_of_scores_close_together(spark, scale):
    rng = np.random.default_rng(7)
    score, label = rng.random(3000).round(3) * scale, rng.integers(0, 2, 3000)
    rows = [(["n", "p"][int(y)], [float(-s), float(s)]) for s, y in zip(score, label)]
    df = spark.createDataFrame(rows, "label string, probability array<double>")
    got = {r["cls"]: r["auc"] for r in M.ovr_auc(df, ["n", "p"]).collect()}
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == {"n": pytest.approx(want), "p": pytest.approx(want)}
    ex = df.select(F.posexplode("probability").alias("code", "score")).groupBy("code", "score").count()
    sizes = [r["count"] for r in M.score_buckets(ex, 64).groupBy("code", "bucket").count().collect()]
    assert len(sizes) >= 110 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_density_of_all_points(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=2000), [40.0, -90.0], rng.exponential(3, 1000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = sorted(map(tuple, P.kde_curve(df, "x", 300).collect()))
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 300)
    want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert [g[0] for g in got] == list(range(300)) and np.allclose([g[1] for g in got], grid)
    assert np.abs(np.array([g[2] for g in got]) - want).max() <= P.kde_error() / (bw * math.sqrt(2 * math.pi)) + 1e-14
    assert P.kde_error() < 1e-11


def test_types_are_found_over_all_rows(spark, tmp_path):
    """A value of another kind widens the type even if it is the last of many."""
    n = 5000
    lines = ["id,whole,real,truth,text,late,empty,huge,padded"]
    for i in range(n):
        late = "x7" if i == n - 1 else str(i)
        lines.append(f"{i},{'' if i % 7 == 0 else -i},{i if i else '1e-3'},{i % 2 == 0},t{i},{late},NA,{10**19 + i}, {i} ")
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    got = IO.read_csv_inferred(spark, f"file://{path}")
    assert dict(got.dtypes) == {"id": "bigint", "whole": "bigint", "real": "double", "truth": "boolean", "text": "string", "late": "string",
                                "empty": "string", "huge": "double", "padded": "bigint"}
    row = got.where("id = 7").first()
    assert tuple(row) == (7, None, 7.0, False, "t7", "7", None, 1e19 + 7, 7)
    assert got.where("whole is null").count() == len(range(0, n, 7)) and got.where("late = 'x7'").count() == 1


def test_types_of_no_rows(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("a,b\n")
    got = IO.read_csv_inferred(spark, f"file://{path}")
    assert got.columns == ["a", "b"] and got.count() == 0
