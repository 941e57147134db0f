"""k-means with restarts (ML5): all restarts start, assign and add up in the same scans.

Rows are packed blocks (``blocks.py``), the centroids of every restart one array. A step is
one job whatever the number of restarts: each task assigns its rows to the nearest
centroid of each restart and hands on sums, which are added up by place. A restart that no
longer moves is left out of later steps.

Starting centroids are drawn as in k-means++, one scan for the next centroid of all
restarts: a row's lot is -log(u) / d2, with u from its key and d2 the squared distance to
the centroids drawn so far, and the least lot wins, which draws rows in proportion to d2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK_ROWS, PRIME, Written, blocks_of, key_unit, packed, row_key, steady_session
from tessera.session import checkpoint_dir


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids), by differences, so near points lose no digits."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        out[:, j] = ((x - c) ** 2).sum(axis=1)
    return out


def _lots(nf: int, draws: list[int], centers: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least lot of a task for each restart: (restart, lot, x)."""
    best: list[tuple] = [(np.inf, None)] * len(draws)
    for _, _, block in blocks_of(batches, nf, False):
        for r, draw in enumerate(draws):
            u = np.maximum(key_unit(block.key, draw), 0.5 / PRIME)
            weight = distances(block.x, centers[r]).min(axis=1) if centers.shape[1] else np.ones(block.n)
            with np.errstate(divide="ignore"):
                lot = np.where(weight > 0, -np.log(u) / weight, np.inf)
            at = int(np.argmin(lot))
            # where all rows lie on centroids any row will do
            if lot[at] < best[r][0] or best[r][1] is None:
                best[r] = (float(lot[at]), block.x[at].tolist())
    found = [(r, *b) for r, b in enumerate(best) if b[1] is not None]
    if found:
        r, lot, x = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(lot, pa.float64()), pa.array(x, pa.list_(pa.float64()))],
                                         ["restart", "lot", "x"])


def _sums(nf: int, names: list[int], centers: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(restart, pos, value): by centroid its rows' number and sums, then the cost."""
    k = centers.shape[1]
    total = np.zeros((len(names), k * (nf + 1) + 1))
    for _, _, block in blocks_of(batches, nf, False):
        for i in range(len(names)):
            d = distances(block.x, centers[i])
            own = d.argmin(axis=1)  # ties: the lower number
            one = np.column_stack([np.bincount(own, minlength=k),
                                   *(np.bincount(own, block.x[:, f], k) for f in range(nf))])
            total[i, :-1] += one.ravel()
            total[i, -1] += d[np.arange(block.n), own].sum()
    width = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width), pa.int32()), pa.array(np.tile(np.arange(width), len(names)), pa.int32()),
                                      pa.array(total.ravel())], ["restart", "pos", "value"])


def step(blocks: DataFrame, nf: int, centers: np.ndarray, names: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new centroids, rows of each, cost with the old ones) of restarts x centroids x features; one job.

    A centroid without rows stays where it is.
    """
    names = list(range(len(centers))) if names is None else names
    k = centers.shape[1]
    found = blocks.mapInArrow(lambda it: _sums(nf, names, centers, it), "restart int, pos int, value double")
    total = np.zeros((len(names), k * (nf + 1) + 1))
    place = {r: i for i, r in enumerate(names)}
    for row in found.groupBy("restart", "pos").agg(F.sum("value").alias("value")).collect():  # restarts x k x (features + 1)
        total[place[row["restart"]], row["pos"]] = row["value"]
    body = total[:, :-1].reshape(len(names), k, nf + 1)
    n = body[:, :, :1]
    new = np.where(n > 0, body[:, :, 1:] / np.maximum(n, 1.0), centers)
    return new, n[:, :, 0].astype(np.int64), total[:, -1]


class KMeansModel:
    """Centroids of the best restart, its cost, and the costs and steps of all."""

    def __init__(self, features: list[str], centers: np.ndarray, cost: float, costs: list[float], steps: list[int]) -> None:
        self.features, self.centers, self.cost, self.costs, self.steps = list(features), centers, cost, costs, steps

    def assign(self, df: DataFrame, out_col: str = "cluster") -> DataFrame:
        from tessera.operators.segments import assign_clusters
        return assign_clusters(df, self.features, self.centers.tolist(), out_col)


def _draw(seed: int, r: int, j: int) -> int:
    return 1 + int(hashlib.md5(f"{seed}|{r}|{j}".encode()).hexdigest()[:13], 16) % (PRIME - 2)


def kmeans_restarts(df: DataFrame, features: list[str], k: int = 3, seeds: int = 10, base_seed: int = 42,
                    max_iter: int = 300, tol: float = 1e-4, id_col: str = "row_id") -> KMeansModel:
    """ML5: the restart of least cost out of ``seeds``.

    A restart ends when its centroids move by no more than ``tol`` times the features' mean
    variance (squared and added up), or after ``max_iter`` steps. Equal costs: the first.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    nf = len(features)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)]).first()
    if not stats["n"]:
        raise ValueError("k-means needs rows")
    limit = tol * float(np.mean([stats[f"v{i}"] or 0.0 for i in range(nf)]))
    store = Written(spark, "kmeans", steady_session(spark))
    rows = df.coalesce(max(1, -(-stats["n"] // BLOCK_ROWS)))
    blocks = store.keep(packed(rows, features, F.lit(0), row_key(df, id_col), None)).persist()
    centers = np.zeros((seeds, 0, nf))
    for j in range(k):
        draws = [_draw(base_seed, r, j) for r in range(seeds)]
        lots = blocks.mapInArrow(lambda it: _lots(nf, draws, centers, it), "restart int, lot double, x array<double>")
        won = lots.groupBy("restart").agg(F.min(F.struct("lot", "x")).alias("best")).collect()  # one row a restart
        chosen = {r["restart"]: r["best"]["x"] for r in won}
        centers = np.concatenate([centers, np.array([chosen[r] for r in range(seeds)])[:, None, :]], axis=1)
    steps, open_ = [0] * seeds, list(range(seeds))
    for _ in range(max_iter):
        new, _, _ = step(blocks, nf, centers[open_], open_)
        moved = ((new - centers[open_]) ** 2).sum(axis=(1, 2))
        centers[open_] = new
        for r in open_:
            steps[r] += 1
        open_ = [r for r, m in zip(open_, moved) if m > limit]
        if not open_:
            break
    _, _, costs = step(blocks, nf, centers)
    blocks.unpersist()
    store.drop()
    best = int(np.argmin(costs))
    return KMeansModel(features, centers[best], float(costs[best]), costs.tolist(), steps)
