"""Extremely randomised trees (ML4): wide nodes level by level over all executors, the rest where its rows are.

A node of more than ``local_rows`` rows is split by two passes over the packed blocks
(``blocks.py``): least and greatest value of every feature, then class counts left of the
drawn thresholds. Each task hands on one summary for each node, summaries are merged by
node, and no row moves: a row's node is found by walking the few levels grown so far. The
rows of a smaller node go to one task, once, which grows the whole subtree. Trees are grown
in groups, so that the wide nodes of a group are at most ``WIDE_NODES``; that bounds what the
driver sees, whatever the number of rows.

If all rows are few enough for one task from the start, they are sent to every executor
(``local_rows`` bounds them) and each task grows whole trees.

The model is a table of packed subtrees in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK_ROWS, Block, Written, blocks_of, delete_table, packed
from tessera.operators.treewalk import Tree, tree_sums
from tessera.session import checkpoint_dir, workers_import
from tessera.sources.io import scratch_path

#: Bytes of the rows that one task grows a subtree from.
LOCAL_BYTES = 64 << 20
WIDE_NODES = 100_000
PACKED = "tree int, root int, feature binary, threshold binary, below binary, counts binary, gain binary"
_NAMES = [part.split()[0] for part in PACKED.split(", ")]


def _unit(seed: int, *parts: int) -> float:
    h = hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()
    return int(h[:13], 16) / float(16**13)


def _candidates(lo: np.ndarray, hi: np.ndarray, k: int, order: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first k features in ``order`` that are not constant, and a threshold for each."""
    some = order[hi[order] > lo[order]][:k]
    # a draw that rounds up to the greatest value would leave nothing on the right
    return some, np.minimum(lo[some] + unit[some] * (hi[some] - lo[some]), np.nextafter(hi[some], lo[some]))


def _decrease(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted Gini decrease of splits; rows are candidates, columns classes."""
    right = total - left
    n, nl, nr = total.sum(), left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (n - (total * total).sum() / n) - (nl - (left * left).sum(axis=1) / nl) - (nr - (right * right).sum(axis=1) / nr)


def _best(features: np.ndarray, left: np.ndarray, total: np.ndarray, min_leaf: int) -> int:
    """Place of the best candidate, -1 if none leaves ``min_leaf`` rows on both sides; ties: the smaller feature."""
    nl = left.sum(axis=1)
    fits = np.flatnonzero((nl >= min_leaf) & (total.sum() - nl >= min_leaf))
    if not len(fits):
        return -1
    gain = _decrease(left[fits], total)
    return int(fits[np.lexsort((features[fits], -gain))[0]])


def grow(x: np.ndarray, y: np.ndarray, n_classes: int, k: int, min_leaf: int, max_depth: int | None, seed: tuple[int, ...]):
    """A subtree as arrays (feature, threshold, below, counts, gain by feature); the children of a node are below, below + 1."""
    rng = np.random.default_rng(seed)
    nf = x.shape[1]
    feature, threshold, below, counts = [-1], [0.0], [0], [np.bincount(y, minlength=n_classes)]
    gain = np.zeros(nf)
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        total = counts[node].astype(float)
        if len(rows) < 2 * min_leaf or total.max() == len(rows) or depth == max_depth:
            continue
        own = x[rows]
        some, cut = _candidates(np.fmin.reduce(own, axis=0), np.fmax.reduce(own, axis=0), k, rng.permutation(nf), rng.random(nf))
        if not len(some):
            continue
        goes_left = own[:, some] <= cut
        labels = y[rows]
        left = np.stack([np.bincount(labels[goes_left[:, j]], minlength=n_classes) for j in range(len(some))]).astype(float)
        j = _best(some, left, total, min_leaf)
        if j < 0:
            continue
        gain[some[j]] += _decrease(left[j : j + 1], total)[0]
        feature[node], threshold[node], below[node] = int(some[j]), float(cut[j]), len(feature)
        for side, held in ((goes_left[:, j], left[j]), (~goes_left[:, j], total - left[j])):
            todo.append((len(feature), rows[side], depth + 1))
            feature.append(-1)
            threshold.append(0.0)
            below.append(0)
            counts.append(held.astype(np.int64))
    return np.array(feature, np.int32), np.array(threshold), np.array(below, np.int32), np.array(counts, np.float64), gain


def _packed_row(tree: int, root: int, arrays: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), pa.array([root], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], _NAMES)


class _Top:
    """The wide part of a tree; ``local`` are the nodes whose subtrees are grown in one task."""

    def __init__(self, counts: np.ndarray) -> None:
        self.feature, self.threshold, self.below, self.depth = [-1], [0.0], [0], [0]
        self.counts, self.local, self.gain = [counts], [], {}

    def arrays(self, nf: int) -> tuple:
        gain = np.zeros(nf)
        for f, g in self.gain.items():
            gain[f] = g
        return (np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.below, np.int32),
                np.array(self.counts, np.float64), gain)

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray, gain: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.below[node] = feature, threshold, len(self.feature)
        self.gain[feature] = self.gain.get(feature, 0.0) + gain
        for held in (left, self.counts[node] - left):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.below.append(0)
            self.depth.append(self.depth[node] + 1)
            self.counts.append(held)
        return self.below[node], self.below[node] + 1


def _walk(feature: np.ndarray, threshold: np.ndarray, below: np.ndarray, x: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        here = node[rows]
        node[rows] = below[here] + ~(x[rows, feature[here]] <= threshold[here])
    return node


def _slots(tops: list[tuple], wanted: list[tuple[int, int]], block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, rows) of the wanted nodes that the block has rows of; ``wanted`` is sorted by tree."""
    of: dict[int, dict[int, int]] = {}
    for slot, (t, node) in enumerate(wanted):
        of.setdefault(t, {})[node] = slot
    for t, slots in of.items():
        node = _walk(*tops[t][:3], block.x)
        order = np.argsort(node, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(rows) and node[rows[0]] in slots:
                yield slots[node[rows[0]]], rows


def _summaries(kind: str, shared, wanted: list, nf: int, n_classes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task and node: ranges of the features, or class counts left of the candidates' thresholds."""
    tops, cuts = shared.value
    held: dict[int, np.ndarray] = {}
    for _, _, block in blocks_of(batches, nf, False):
        for slot, rows in _slots(tops, wanted, block):
            if kind == "ranges":
                # missing values have no place in a range and go right
                own = block.x[rows]
                new = np.concatenate([np.fmin.reduce(own, axis=0), -np.fmax.reduce(own, axis=0)])
                held[slot] = np.fmin(held[slot], new) if slot in held else new
            else:
                features, threshold = cuts[slot]
                goes_left = block.x[np.ix_(rows, features)] <= threshold
                new = np.concatenate([np.bincount(block.y[rows][goes_left[:, j]], minlength=n_classes) for j in range(len(features))]).astype(float)
                held[slot] = held[slot] + new if slot in held else new
    yield _slot_rows(held)


def _slot_rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                      ["slot", "body"])


def _merge(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = np.frombuffer(body.as_buffer(), np.float64)
            if slot in held:
                new = np.fmin(held[slot], new) if kind == "ranges" else held[slot] + new
            held[slot] = new
    if held:
        yield _slot_rows(held)


def _scatter(shared, nf: int, wanted: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block by the node whose subtree they help to grow."""
    tops, _ = shared.value
    for _, _, block in blocks_of(batches, nf, False):
        found = [(slot, block.y[rows].tobytes(), np.ascontiguousarray(block.x[rows]).tobytes()) for slot, rows in _slots(tops, wanted, block)]
        if found:
            slot, y, x = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(y, pa.binary()), pa.array(x, pa.binary())], ["slot", "y", "x"])


class ExtraTrees:
    """Extra trees without bootstrap: a node looks at ``max_features`` features that are not
    constant in it, draws one threshold for each between their least and greatest value, and takes
    the one with the largest Gini decrease that leaves ``min_leaf`` rows on both sides.
    Pure nodes and nodes of fewer than 2 x ``min_leaf`` rows are leaves.

    Missing values go right. Draws depend on seed, tree and node, not on the order of rows
    or the number of tasks.
    """

    def __init__(self, n_trees=250, min_leaf=10, max_features="sqrt", seed=42, max_depth=None, local_rows: int | None = None):
        self.n_trees, self.min_leaf, self.max_features = n_trees, min_leaf, max_features
        self.seed, self.max_depth, self.local_rows = seed, max_depth, local_rows

    def fit(self, df: DataFrame, features: list[str], label_col: str = "label", id_col: str = "row_id") -> ExtraTreesModel:
        spark = df.sparkSession
        checkpoint_dir(spark)
        workers_import(spark)
        nf = len(features)
        k = max(1, int(math.sqrt(nf))) if self.max_features == "sqrt" else int(self.max_features)
        sizes = {int(r[0]): r["n"] for r in df.groupBy(F.col(label_col).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()}
        n_classes, n = max(sizes) + 1, sum(sizes.values())
        counts = np.array([sizes.get(c, 0) for c in range(n_classes)], float)
        local = self.local_rows or max(2 * self.min_leaf, LOCAL_BYTES // (8 * nf + 2))
        rows = df.coalesce(max(1, -(-n // BLOCK_ROWS)))
        blocks = packed(rows, features, F.col(label_col), F.lit(0), None)
        path = scratch_path(spark, "extra_trees")
        if n <= local:
            self._small(spark, blocks, path, nf, n_classes, k)
        else:
            store = Written(spark, "extra_trees_rows")
            state = store.keep(blocks)
            at_once = max(1, min(self.n_trees, int(WIDE_NODES * local / (4 * n))))
            for first in range(0, self.n_trees, at_once):
                self._group(spark, state, range(first, min(self.n_trees, first + at_once)), counts, local, path, nf, n_classes, k)
            store.drop()
        return ExtraTreesModel(spark, features, path, n_classes, self.n_trees)

    def _small(self, spark, blocks, path, nf, n_classes, k) -> None:
        """All rows fit one task: every task has them and grows whole trees."""
        held = [r.asDict() for r in blocks.collect()]  # at most ``local_rows`` rows
        y = np.concatenate([np.frombuffer(r["y"], np.int16) for r in held])
        x = np.concatenate([np.frombuffer(r["x"], np.float64).reshape(r["n"], nf) for r in held])
        shared = spark.sparkContext.broadcast((x, y))
        seed, min_leaf, depth = self.seed, self.min_leaf, self.max_depth

        def trees(batches):
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    yield _packed_row(t, 0, grow(*shared.value, n_classes, k, min_leaf, depth, (seed, t, 0)))
        tasks = min(self.n_trees, 4 * spark.sparkContext.defaultParallelism)
        spark.range(0, self.n_trees, 1, tasks).mapInArrow(trees, PACKED).write.mode("append").option("compression", "zstd").parquet(path)
        shared.unpersist()

    def _group(self, spark, state, trees: range, counts, local, path, nf, n_classes, k) -> None:
        """The trees of a group: wide levels, then all subtrees in one job."""
        tops = [_Top(counts) for _ in trees]
        wide = [(t, 0) for t in range(len(tops))]

        def job(kind: str, wanted: list, cuts: dict) -> dict[int, np.ndarray]:
            shared = spark.sparkContext.broadcast(([t.arrays(nf) for t in tops], cuts))
            found = state.mapInArrow(lambda it: _summaries(kind, shared, wanted, nf, n_classes, it), "slot int, body binary")
            met = found.repartition("slot").mapInArrow(lambda it: _merge(kind, it), "slot int, body binary")
            out = {r["slot"]: np.frombuffer(r["body"], np.float64) for r in met.collect()}  # at most WIDE_NODES rows
            shared.unpersist()
            return out

        while wide:
            cuts = {}
            for slot, ends in job("ranges", wide, {}).items():
                t, node = wide[slot]
                drawn = np.array([_unit(self.seed, trees[t], node, f, 0) for f in range(nf)])
                unit = np.array([_unit(self.seed, trees[t], node, f, 1) for f in range(nf)])
                cuts[slot] = _candidates(ends[:nf], -ends[nf:], k, np.argsort(drawn), unit)
            found = job("counts", wide, cuts)
            opened = []
            for slot, (t, node) in enumerate(wide):
                features, threshold = cuts[slot]
                left = found[slot].reshape(-1, n_classes) if len(features) else np.zeros((0, n_classes))
                j = _best(features, left, tops[t].counts[node], self.min_leaf) if len(features) else -1
                if j < 0:
                    continue
                gain = float(_decrease(left[j : j + 1], tops[t].counts[node])[0])
                for child in tops[t].split(node, int(features[j]), float(threshold[j]), left[j], gain):
                    n = tops[t].counts[child].sum()
                    if n < 2 * self.min_leaf or tops[t].counts[child].max() == n or tops[t].depth[child] == self.max_depth:
                        continue
                    (opened if n > local else tops[t].local).append((t, child) if n > local else child)
            wide = opened
        rows = [(trees[t], -1, *(bytearray(a.tobytes()) for a in top.arrays(nf))) for t, top in enumerate(tops)]
        spark.createDataFrame(rows, PACKED).write.mode("append").option("compression", "zstd").parquet(path)
        wanted = [(t, node) for t, top in enumerate(tops) for node in sorted(top.local)]
        if not wanted:
            return
        depths = [tops[t].depth[node] for t, node in wanted]
        names = [(trees[t], node) for t, node in wanted]
        shared = spark.sparkContext.broadcast(([t.arrays(nf) for t in tops], {}))
        seed, min_leaf, most = self.seed, self.min_leaf, self.max_depth

        def subtrees(batches):
            def done(slot, ys, xs):
                y, x = np.frombuffer(b"".join(ys), np.int16), np.frombuffer(b"".join(xs), np.float64).reshape(-1, nf)
                rest = None if most is None else most - depths[slot]
                return _packed_row(*names[slot], grow(x, y, n_classes, k, min_leaf, rest, (seed, *names[slot])))
            at, ys, xs = None, [], []
            for batch in batches:
                for slot, y, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if slot != at and at is not None:
                        yield done(at, ys, xs)
                        ys, xs = [], []
                    at = slot
                    ys.append(y.as_py())
                    xs.append(x.as_py())
            if at is not None:
                yield done(at, ys, xs)
        parts = state.mapInArrow(lambda it: _scatter(shared, nf, wanted, it), "slot int, y binary, x binary")
        parts = parts.repartition("slot").sortWithinPartitions("slot").mapInArrow(subtrees, PACKED)
        parts.write.mode("append").option("compression", "zstd").parquet(path)
        shared.unpersist()


class ExtraTreesModel:
    """The table of packed subtrees (``path``): a row with root 0 is a whole tree, one with root -1 the
    wide part of a tree, others hang below its node ``root``."""

    def __init__(self, spark: SparkSession, features: list[str], path: str, n_classes: int, n_trees: int) -> None:
        self.spark, self.features, self.path, self.n_classes, self.n_trees = spark, list(features), path, n_classes, n_trees

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """Deletes the table; the model can't be used any more."""
        delete_table(self.spark, self.path)

    def _arrays(self, r) -> tuple:
        return (np.frombuffer(r["feature"], np.int32), np.frombuffer(r["threshold"]), np.frombuffer(r["below"], np.int32),
                np.frombuffer(r["counts"]).reshape(-1, self.n_classes))

    def walk_trees(self, trees: range | None = None) -> list[Tree]:
        """Whole trees, whose leaves hold class shares; the driver holds the trees asked for."""
        trees = range(self.n_trees) if trees is None else trees
        rows: dict[int, dict[int, tuple]] = {}
        for r in self.table().where(F.col("tree").between(trees.start, trees.stop - 1)).collect():
            rows.setdefault(r["tree"], {})[r["root"]] = self._arrays(r)
        return [_whole(rows[t]) for t in trees]

    def groups(self, limit: int = 64 << 20) -> list[range]:
        """Trees in groups of about ``limit`` bytes."""
        size = F.length("feature") + F.length("threshold") + F.length("below") + F.length("counts")
        sizes = {r["tree"]: r["b"] for r in self.table().groupBy("tree").agg(F.sum(size).alias("b")).collect()}
        out, start, held = [], 0, 0
        for t in range(self.n_trees):
            if t > start and held + sizes[t] > limit:
                out.append(range(start, t))
                start, held = t, 0
            held += sizes[t]
        return [*out, range(start, self.n_trees)]

    def predict_frame(self, df: DataFrame, features: list[str], id_col: str = "row_id") -> DataFrame:
        """probability (mean over trees of the reached leaf's class shares) and prediction of every row, in place.

        Trees travel in groups; the driver holds one group at a time.
        """
        sc = df
        names = [f"__p{i}" for i, _ in enumerate(self.groups())]
        for name, trees in zip(names, self.groups()):
            sc = tree_sums(sc, self.features, self.walk_trees(trees), self.n_classes, name, closed=True)
        total = F.col(names[0])
        for name in names[1:]:
            total = F.zip_with(total, F.col(name), lambda a, b: a + b)
        sc = sc.withColumn("probability", F.transform(total, lambda p: p / F.lit(float(self.n_trees)))).drop(*names)
        pos = F.array_position(F.col("probability"), F.array_max("probability")) - 1
        return sc.withColumn("prediction", pos.cast("double"))

    def feature_importances(self) -> dict[str, float]:
        """Summed Gini decreases, as shares."""
        total = np.zeros(len(self.features))
        for r in self.table().select("gain").toLocalIterator():
            total += np.frombuffer(r["gain"])
        return {f: float(g / total.sum()) if total.sum() else 0.0 for f, g in zip(self.features, total)}

    def tree_model(self):
        """Class shares for tree SHAP."""
        from tessera.operators.explain import TreeModel
        return TreeModel(self.walk_trees(), self.n_classes, 1.0 / self.n_trees)


def _whole(parts: dict[int, tuple]) -> Tree:
    """One tree of its wide part and the subtrees below it."""
    if 0 in parts:
        feature, threshold, below, counts = parts[0]
    else:
        feature, threshold, below, counts = (a.copy() for a in parts[-1])
        for root, (f, t, b, c) in sorted(parts.items()):
            if root < 0:
                continue
            # the subtree's root takes its node's place, the rest is appended
            shift = len(feature) - 1
            feature[root], threshold[root], below[root] = f[0], t[0], b[0] + shift
            feature, threshold = np.concatenate([feature, f[1:]]), np.concatenate([threshold, t[1:]])
            below, counts = np.concatenate([below, b[1:] + shift]), np.concatenate([counts, c[1:]])
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return Tree(feature.astype(np.int32), threshold, below.astype(np.int32), (below + 1).astype(np.int32), share)
