"""Passes of the booster: all cores share the blocks, gradients are made once a round for the rows of its sample."""

import numpy as np

from tessera.operators import boosting as BO
from tessera.operators.blocks import Block, blocks_of, key_unit, packed, row_key
from pyspark.sql import functions as F

FEATURES = ["a", "b"]


def _rows(spark, n, parts):
    return spark.range(n, numPartitions=parts).selectExpr(
        "id as row_id", "cast(id % 17 as double) as a", "cast(id * 7 % 23 as double) as b", "cast((id % 17 + id * 7 % 23) % 3 as double) as label")


def test_a_single_partition_is_dealt_out_over_the_cores(spark, monkeypatch):
    seen, keep = [], BO.Written.keep
    monkeypatch.setattr(BO.Written, "keep", lambda self, df: seen.append(df.rdd.getNumPartitions()) or keep(self, df))
    BO.SoftmaxBooster(rounds=1, max_depth=2).fit(_rows(spark, 20_000, 1), FEATURES)
    assert seen[0] == min(5, spark.sparkContext.defaultParallelism) > 1


def test_gradients_of_a_round_are_those_of_its_sample(spark):
    rows = _rows(spark, 5_000, 1)
    splits = BO.fit_bins(rows, FEATURES)
    blocks = packed(rows, FEATURES, F.col("label"), row_key(rows, "row_id"), None, 3, [splits[f] for f in FEATURES]).toArrow().to_batches()
    how = BO._Pass(2, max(map(len, splits.values())), 3, 1, 0.8, 12345)
    graded = [r for batch in BO._graded(how, iter(blocks)) for r in batch.to_pylist()]
    found = list(blocks_of(iter(blocks), 2, True))
    assert len(graded) == len(found) > 1
    for r, (_, _, block) in zip(graded, found):
        assert isinstance(block, Block)
        at = np.flatnonzero(key_unit(block.key, 12345) < 0.8)
        assert r["n"] == len(at) < block.n
        g = np.frombuffer(r["g"], np.int32).reshape(3, -1)
        assert (g == np.floor((1 / 3 - (block.y[at] == np.arange(3)[:, None])) * BO.SCALE + 0.5)).all()


def test_rows_stop_at_early_leaves():
    tree = BO._Growing(3)
    tree.feature[[0, 1, 4]], tree.bin[[0, 1, 4]] = [0, 1, 0], [5, 3, 2]
    bins = np.array([[6, 0], [5, 3], [2, 4], [3, 4]], np.uint8)
    assert tree.walk(bins, 3).tolist() == [2, 3, 9, 10] and tree.walk(bins, 1).tolist() == [2, 1, 1, 1]
    assert BO._Growing(3).walk(bins, 3).tolist() == [0] * 4
