"""Multiclass softmax gradient boosting (ML3) as Spark jobs.

Spark ML's GBT is binary only. ``SoftmaxBooster`` grows the trees of all classes (and of
all cross-validation folds) level by level from mergeable histograms over packed blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import (BLOCK, BLOCK_ROWS, PRIME, Block, Written, blocks_of, key_unit, packed, row_key,
                                      steady_session, with_score)
from tessera.operators.treewalk import Tree, make_tree, tree_sums
from tessera.session import checkpoint_dir


def _py_unit(*parts, seed: str) -> float:
    import hashlib
    h = hashlib.md5("|".join([str(p) for p in parts] + [seed]).encode()).hexdigest()
    return int(h[:13], 16) / float(16 ** 13)


def fit_bins(df: DataFrame, features: list[str], max_bins: int = 64, rel_err: float = 1e-3) -> dict[str, list[float]]:
    """Per feature: sorted distinct split points from approximate quantiles (one job)."""
    probs = [i / max_bins for i in range(1, max_bins)]
    qs = df.approxQuantile(list(features), probs, rel_err)
    out = {}
    for f, q in zip(features, qs):
        pts = sorted({float(v) for v in q if v is not None and not math.isnan(v)})
        out[f] = [-math.inf] + pts + [math.inf]
    return out


def width_bins(df: DataFrame, features: list[str], bins: int = 64) -> dict[str, list[float]]:
    """Per feature: ``bins`` intervals of equal width between its least and greatest value (one aggregate)."""
    ends = df.agg(*[g(F.col(f).cast("double")).alias(f"{n}{i}") for i, f in enumerate(features) for n, g in (("a", F.min), ("b", F.max))]).first()
    out = {}
    for i, f in enumerate(features):
        lo, hi = ends[f"a{i}"], ends[f"b{i}"]
        inner = [] if lo is None else sorted({lo + (hi - lo) * k / bins for k in range(1, bins)})
        out[f] = [-math.inf, *inner, math.inf]
    return out


def bin_frame(df: DataFrame, features: list[str], splits: dict[str, list[float]]) -> DataFrame:
    """Adds ``bins`` array<int>: bucket i covers [s_i, s_{i+1})."""
    b = Bucketizer(splitsArray=[splits[f] for f in features], inputCols=list(features),
                   outputCols=[f"__b_{f}" for f in features], handleInvalid="keep")
    out = b.transform(df)
    return out.withColumn("bins", F.array(*[F.col(f"__b_{f}").cast("int") for f in features])) \
              .drop(*[f"__b_{f}" for f in features])


class SoftmaxBoosterModel:
    """Trees: trees[round][class] = dict node -> (feature, bin) for splits, node -> value for leaves."""

    def __init__(self, features, splits, trees, n_classes, eta):
        self.features, self.splits, self.trees = features, splits, trees
        self.n_classes, self.eta = n_classes, eta

    def _tree_value(self, tree, bins: Column) -> Column:
        # walk depth by depth with literal maps (node -> feature / bin / value)
        splits = {n: v for n, v in tree.items() if isinstance(v, tuple)}
        leaves = {n: v for n, v in tree.items() if not isinstance(v, tuple)}
        if not splits:
            return F.lit(float(leaves.get(0, 0.0)))
        fmap = F.create_map(*[x for n, (f, b) in splits.items() for x in (F.lit(n), F.lit(f))])
        bmap = F.create_map(*[x for n, (f, b) in splits.items() for x in (F.lit(n), F.lit(b))])
        vmap = F.create_map(*[x for n, v in leaves.items() for x in (F.lit(n), F.lit(float(v)))])
        depth = max(int(math.log2(n + 1)) for n in tree) + 1

        # the walk runs inside one higher-order function: the node is a lambda
        # variable, so the expression does not grow with the depth
        def step(nd, _):
            f = fmap[nd]
            go_right = F.element_at(bins, f + 1) > bmap[nd]
            return F.when(f.isNull(), nd).otherwise(2 * nd + 1 + go_right.cast("int"))
        node = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
        return F.coalesce(vmap[node], F.lit(0.0))

    def margins(self, binned: DataFrame) -> Column:
        cols = []
        for c in range(self.n_classes):
            s = F.lit(0.0)
            for rnd in self.trees:
                s = s + self._tree_value(rnd[c], F.col("bins"))
            cols.append(s)
        return F.array(*cols)

    def walk_trees(self) -> list[Tree]:
        """Trees over raw features: bin > b is x >= the split point b + 1."""
        out = []
        for rnd in self.trees:
            for c, tree in enumerate(rnd):
                splits = {n: (v[0], self.splits[self.features[v[0]]][v[1] + 1], 2 * n + 1, 2 * n + 2)
                          for n, v in tree.items() if isinstance(v, tuple)}
                leaves = {n: [float(v) if k == c else 0.0 for k in range(self.n_classes)]
                          for n, v in tree.items() if not isinstance(v, tuple)}
                out.append(make_tree(splits, leaves, self.n_classes))
        return out

    def max_depth(self) -> int:
        return max(int(math.log2(n + 1)) for rnd in self.trees for tr in rnd for n in tr)

    def predict_frame(self, df: DataFrame, features: list[str], id_col: str = "row_id") -> DataFrame:
        """rawPrediction (sum of leaf values), probability and prediction of every row, in place."""
        sc = tree_sums(df, self.features, self.walk_trees(), self.n_classes, "rawPrediction", closed=False)
        mx = F.array_max("rawPrediction")
        ex = F.transform("rawPrediction", lambda v: F.exp(v - mx))
        tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
        sc = sc.withColumn("probability", F.transform(ex, lambda v: v / tot))
        pos = F.array_position(F.col("probability"), F.array_max("probability")) - 1
        return sc.withColumn("prediction", pos.cast("double"))

    def feature_importances(self) -> dict[str, float]:
        """Mean gain of a feature's splits, as shares."""
        gains: dict[str, list[float]] = {f: [] for f in self.features}
        for f, g in getattr(self, "gain_log", []):
            gains[self.features[f]].append(g)
        means = {f: sum(g) / len(g) if g else 0.0 for f, g in gains.items()}
        tot = sum(means.values())
        return {f: (g / tot if tot else 0.0) for f, g in means.items()}

    def tree_model(self):
        """Margins for tree SHAP."""
        from tessera.operators.explain import TreeModel
        return TreeModel(self.walk_trees(), self.n_classes, closed=False, kind="margin")


#: Gradients are summed as whole multiples of 1 / SCALE, so sums are exact and no order of tasks changes a fit.
SCALE = 1 << 24
#: Histograms that one task adds up, about.
MERGE_BYTES = 4 << 20


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE + 0.5)


class _Growing:
    """A tree while it grows, as arrays over node numbers (children of n: 2n + 1, 2n + 2)."""

    def __init__(self, max_depth: int) -> None:
        size = 2 ** (max_depth + 1) - 1
        self.feature, self.bin, self.value = np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)

    def walk(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after at most ``depth`` steps."""
        node = np.zeros(len(bins), np.intp)
        leaf = self.feature < 0
        if leaf[0]:
            return node
        number = np.arange(len(leaf))
        feature, last = np.where(leaf, 0, self.feature).astype(np.intp), self.bin.astype(bins.dtype)
        child = np.where(leaf, [number, number], [2 * number + 1, 2 * number + 2]).T.ravel()  # a leaf leads to itself
        cells, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(depth):
            node = child.take(2 * node + (cells.take(start + feature.take(node)) > last.take(node)))
        return node


@dataclass(frozen=True)
class _Pass:
    """What a pass over the blocks needs: sizes, the round's sample, and the trees so far (one for each fit and class)."""

    nf: int
    n_bins: int
    n_classes: int
    fits: int
    subsample: float
    draw: int


_GRADED = "n int, fold binary, x binary, g binary, h binary"


def _graded(how: _Pass, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that are in the round's sample, with their g and h by fit and class."""
    for _, _, block in blocks_of(batches, how.nf, True):
        at = np.flatnonzero(key_unit(block.key, how.draw) < how.subsample)
        score = block.score.reshape(block.n, how.fits, how.n_classes)[at]
        e = np.exp(score - score.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        h = _fixed(np.maximum(2.0 * p * (1.0 - p), 1e-16))
        p[np.arange(len(at)), :, block.y[at]] -= 1.0
        # whole numbers of at most 2^24, a row for each tree
        g, h = (np.ascontiguousarray(v.reshape(len(at), -1).T, np.int32) for v in (_fixed(p), h))
        fields = (block.fold[at], block.x[at], g, h)
        yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in fields)],
                                         [part.split()[0] for part in _GRADED.split(", ")])


def _histograms(how: _Pass, trees: list[_Growing], depth: int, wanted: dict[int, list[int]],
                batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task and wanted node: the sums of g and h by feature and bin."""
    slots = {}
    for t, nodes in wanted.items():
        slots[t] = np.full(2 ** (depth + 1) - 1, -1, np.int64)
        slots[t][nodes] = np.arange(len(nodes))
    cells = how.nf * how.n_bins
    sums = {t: np.zeros((2, len(nodes) * cells), np.int64) for t, nodes in wanted.items()}
    for batch in batches:
        for n, *raw in zip(*(batch.column(i) for i in range(5))):
            fold, x = np.frombuffer(raw[0].as_buffer(), np.int16), np.frombuffer(raw[1].as_buffer(), np.uint8).reshape(n.as_py(), how.nf)
            g, h = (np.frombuffer(v.as_buffer(), np.int32).reshape(-1, len(x)) for v in raw[2:])
            place = np.arange(how.nf) * how.n_bins + x.astype(np.int64)
            for t, nodes in wanted.items():
                fit = t // how.n_classes
                slot = slots[t].take(trees[t].walk(x, depth))
                at = np.flatnonzero((slot >= 0) & (fold != fit - 1) if fit else slot >= 0)  # fit 0 has all rows, fit m all but fold m - 1
                cell = (place.take(at, axis=0) + (slot[at] * cells)[:, None]).ravel()
                for k, values in enumerate((g, h)):
                    # a block's sums are below 2^53 and so exact
                    sums[t][k] += np.bincount(cell, np.repeat(values[t, at].astype(float), how.nf), len(nodes) * cells).astype(np.int64)
    rows = [(t, node, sums[t][:, i * cells : (i + 1) * cells].tobytes()) for t, nodes in wanted.items() for i, node in enumerate(nodes)]
    yield _node_rows(rows)


_HIST = "tree int, node int, hist binary"
_BEST = _HIST + ", feature int, bin int, gain double, g long, h long, gl long, hl long"


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["tree", "node", "hist"])


def best_split(hist: np.ndarray, allowed: np.ndarray, reg_lambda: float, min_child_weight: float) -> tuple:
    """(feature, bin, gain, g, h, gl, hl) of the best split of a node; feature -1 if none gains.

    ``hist`` is (2, features, bins) of sums; rows in bins up to the split's go left. Of
    equal gains the first feature and bin wins.
    """
    total = hist[:, 0, :].sum(axis=1) if hist.shape[1] else np.zeros(2, np.int64)
    left = np.cumsum(hist, axis=2)
    gl, hl = left[0] / SCALE, left[1] / SCALE
    g, h = total[0] / SCALE, total[1] / SCALE
    gr, hr = (total[0] - left[0]) / SCALE, (total[1] - left[1]) / SCALE
    gain = 0.5 * (gl * gl / (hl + reg_lambda) + gr * gr / (hr + reg_lambda) - g * g / (h + reg_lambda))
    gain = np.where((hl >= min_child_weight) & (hr >= min_child_weight) & allowed[:, None], gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape) if gain.size else (0, 0)
    if not gain.size or not gain[f, b] > 0:
        return -1, 0, 0.0, int(total[0]), int(total[1]), 0, 0
    return int(f), int(b), float(gain[f, b]), int(total[0]), int(total[1]), int(left[0][f, b]), int(left[1][f, b])


def _merged(shape: tuple[int, int], depth: int, last: bool, allowed: np.ndarray, reg_lambda: float, min_child_weight: float,
            batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed histograms and best splits; rows of a node and its parent come to one task.

    The parent's histogram (of the level before) less the child's is its sibling's. Those of
    the last level are nobody's parents and don't go on.
    """
    sums: dict[tuple[int, int], np.ndarray] = {}
    parents: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for tree, node, hist in zip(*(batch.column(i) for i in range(3))):
            key, values = (tree.as_py(), node.as_py()), np.frombuffer(hist.as_buffer(), np.int64)
            if depth and node.as_py() < 2**depth - 1:
                parents[key] = values
            else:
                sums[key] = sums[key] + values if key in sums else values
    for (tree, node), values in parents.items():
        built, other = (2 * node + 1, 2 * node + 2) if (tree, 2 * node + 1) in sums else (2 * node + 2, 2 * node + 1)
        sums[tree, other] = values - sums[tree, built]
    rows = [(tree, node, b"" if last else hist.tobytes(), *best_split(hist.reshape(2, *shape), allowed[tree], reg_lambda, min_child_weight))
            for (tree, node), hist in sorted(sums.items(), key=lambda x: x[0])]
    if rows:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         [part.split()[0] for part in _BEST.split(", ")])


def _scored(how: _Pass, trees: list[_Growing], depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the round's leaf values added to their scores."""
    for batch, i, block in blocks_of(batches, how.nf, True):
        score = block.score.copy()
        for t, tree in enumerate(trees):
            score[:, t] += tree.value[tree.walk(block.x, depth)]
        yield with_score(batch, i, score)


def _held_out(how: _Pass, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (fold, label, predicted) by the fit that has not seen the fold."""
    for _, _, block in blocks_of(batches, how.nf, True):
        at = np.flatnonzero((block.fold >= 0) & (block.fold < how.fits - 1))
        score = block.score.reshape(block.n, how.fits, how.n_classes)[at, block.fold[at] + 1]
        found, n = np.unique(np.column_stack([block.fold[at], block.y[at], score.argmax(axis=1)]), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i].astype(np.int32)) for i in range(3)), pa.array(n.astype(np.int64))],
                                         ["fold", "label", "prediction", "n"])


class SoftmaxBooster:
    """Multiclass softmax boosting: g = p - y, h = max(2p(1-p), 1e-16); split gain
    G_L^2/(H_L+l) + G_R^2/(H_R+l) - G^2/(H+l), halved; children need H >= min_child_weight;
    leaf = -eta G/(H+l); row subsample per round and column subsample per tree by hash.

    Rows are packed blocks (``blocks.py``) with their scores. A level is one job for the
    trees of all classes, and of all folds in a cross-validation: every task sums one
    histogram for each open node over its blocks, histograms are added up by node, and the
    sibling of a node is its parent less the node, so only the child with the smaller H is
    counted. Gradients of the round's sample are made once a round and kept for its levels.
    What the driver sees is one row for each node. After a round the scores are
    updated once and kept on the executors; every ``checkpoint_every`` rounds blocks are
    written to the shared folder, so a lost executor repeats that many rounds at most.
    """

    def __init__(self, rounds=300, max_depth=6, eta=0.05, subsample=0.8, colsample=0.8,
                 min_child_weight=5.0, reg_lambda=1.0, seed=42, max_bins=64, checkpoint_every=20):
        self.rounds, self.max_depth, self.eta = rounds, max_depth, eta
        self.subsample, self.colsample = subsample, colsample
        self.min_child_weight, self.reg_lambda, self.seed = min_child_weight, reg_lambda, seed
        self.max_bins, self.checkpoint_every = min(max_bins, 255), checkpoint_every

    def fit(self, df: DataFrame, features: list[str], label_col: str = "label", id_col: str = "row_id",
            splits: dict[str, list[float]] | None = None) -> SoftmaxBoosterModel:
        """A model of all rows. ``splits`` are split points (``fit_bins``, ``width_bins``) if not quantiles."""
        return self._fit(df, features, label_col, id_col, None, 0, splits)[0][0]

    def fit_folds(self, df: DataFrame, features: list[str], label_col: str, id_col: str, fold_col: str, k: int):
        """(models: of all rows, then without fold 0 to k - 1; counts of fold, label, prediction on the folds left out).

        All k + 1 fits share each pass. Split points come from all rows.
        """
        return self._fit(df, features, label_col, id_col, fold_col, k, None)

    def draw(self, rnd: int) -> int:
        """The multiplier of a round's row sample."""
        return 1 + int(_py_unit(rnd, seed=f"{self.seed}r") * (PRIME - 2))

    def columns(self, rnd: int, c: int, nf: int) -> list[int]:
        """The features that a tree may use."""
        return [f for f in range(nf) if _py_unit(rnd, c, f, seed=f"{self.seed}c") < self.colsample] or [0]

    def _fit(self, df, features, label_col, id_col, fold_col, k, splits):
        spark = df.sparkSession
        checkpoint_dir(spark)
        size = df.agg(F.max(label_col).alias("top"), F.count(F.lit(1)).alias("n")).first()
        n_classes = int(size["top"]) + 1
        splits = splits or fit_bins(df, features, self.max_bins)
        edges = [splits[f] for f in features]
        nf, fits = len(features), k + 1
        n_bins = max((len(e) for e in edges), default=1)  # bins and one for missing values
        # thousands of small jobs with fixed numbers of tasks: a session of their own without re-planning
        store = Written(spark, "boosting", steady_session(spark))
        # a block for every task at least, smaller ones cost more than they do; a few partitions are dealt out evenly over all cores
        parts, cores, now = max(1, -(-size["n"] // BLOCK_ROWS)), spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        if now < 4 * cores:
            parts = min(parts, cores)
            rows = df.repartition(parts)
        else:
            rows = df.coalesce(parts)
            parts = min(parts, now)
        state = store.keep(packed(rows, features, F.col(label_col), row_key(df, id_col), F.col(fold_col) if fold_col else None,
                                  fits * n_classes, edges)).persist()
        models: list[list] = [[] for _ in range(fits)]
        gain_logs: list[list] = [[] for _ in range(fits)]
        older = None
        for rnd in range(self.rounds):
            how = _Pass(nf, n_bins, n_classes, fits, self.subsample, self.draw(rnd))
            allowed = np.zeros((fits * n_classes, nf), bool)
            for c in range(n_classes):
                allowed[c::n_classes, self.columns(rnd, c, nf)] = True
            graded = state.mapInArrow(lambda it, how=how: _graded(how, it), _GRADED).persist()  # once for all levels
            trees = self._grow(graded, parts, how, allowed, gain_logs)
            graded.unpersist()
            if older is not None:
                older.unpersist()  # the newer scores were made from it in the pass before
            for fit in range(fits):
                models[fit].append([_nodes(trees[fit * n_classes + c]) for c in range(n_classes)])
            older, depth = state, self.max_depth
            state = state.mapInArrow(lambda it, how=how, trees=trees: _scored(how, trees, depth, it), BLOCK)
            if (rnd + 1) % self.checkpoint_every == 0:
                state = store.keep(state)
            state = state.persist()
        counts = None
        if k:
            how = _Pass(nf, n_bins, n_classes, fits, self.subsample, 1)
            found = state.mapInArrow(lambda it: _held_out(how, it), "fold int, label int, prediction int, n long")
            counts = found.groupBy("fold", "label", "prediction").agg(F.sum("n").alias("n"))
            counts = spark.createDataFrame(counts.collect(), counts.schema)  # folds x classes x classes
        for frame in (older, state):
            if frame is not None:
                frame.unpersist()
        store.drop()
        out = []
        for trees, log in zip(models, gain_logs):
            out.append(SoftmaxBoosterModel(features, splits, trees, n_classes, self.eta))
            out[-1].gain_log = log
        return out, counts

    def _grow(self, graded: DataFrame, parts: int, how: _Pass, allowed: np.ndarray, gain_logs: list) -> list[_Growing]:
        """The trees of a round, a level a job."""
        trees = [_Growing(self.max_depth) for _ in range(how.fits * how.n_classes)]
        wanted: dict[int, list[int]] = {t: [0] for t in range(len(trees))}
        level = before = None
        for depth in range(self.max_depth):
            found = graded.mapInArrow(lambda it: _histograms(how, trees, depth, wanted, it), _HIST)
            if before is not None:  # of nodes that were split
                found = found.unionByName(before.where("feature >= 0").select("tree", "node", "hist"))
            family = (F.when(F.col("node") >= 2**depth - 1, ((F.col("node") - 1) / 2).cast("int")).otherwise(F.col("node")) if depth
                      else F.lit(0))
            moved = sum(map(len, wanted.values())) * how.nf * how.n_bins * 16 * parts
            tasks = max(1, min(moved // MERGE_BYTES, int(graded.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            met = found.repartition(tasks, "tree", family)
            lam, mcw, shape, last = self.reg_lambda, self.min_child_weight, (how.nf, how.n_bins), depth == self.max_depth - 1
            level = met.mapInArrow(lambda it: _merged(shape, depth, last, allowed, lam, mcw, it), _BEST).persist()
            best = level.drop("hist").collect()  # one row for each open node, at most trees x 2^depth
            if before is not None:
                before.unpersist()
            before, wanted = level, {}
            for r in sorted(best, key=lambda r: (r["tree"], r["node"])):
                t, node, tree = r["tree"], r["node"], trees[r["tree"]]
                tree.value[node] = self._leaf(r["g"], r["h"])
                if r["feature"] < 0:
                    continue
                tree.feature[node], tree.bin[node] = r["feature"], r["bin"]
                gain_logs[t // how.n_classes].append((r["feature"], r["gain"]))
                left, right = (r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"])
                tree.value[2 * node + 1], tree.value[2 * node + 2] = self._leaf(*left), self._leaf(*right)
                wanted.setdefault(t, []).append(2 * node + 1 + (right[1] < left[1]))
            if not wanted:
                break
        if before is not None:
            before.unpersist()
        return trees

    def _leaf(self, g: int, h: int) -> float:
        return -self.eta * (g / SCALE) / (h / SCALE + self.reg_lambda)


def _nodes(tree: _Growing) -> dict:
    """Splits (feature, bin) and leaf values by node number."""
    out, todo = {}, [0]
    while todo:
        n = todo.pop()
        if tree.feature[n] >= 0:
            out[n] = (int(tree.feature[n]), int(tree.bin[n]))
            todo += [2 * n + 1, 2 * n + 2]
        else:
            out[n] = float(tree.value[n])
    return out
