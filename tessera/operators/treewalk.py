"""Scoring of tree ensembles in place: every row walks all trees inside one Arrow batch.

A tree is four arrays over its nodes; a batch of rows moves down all levels at once. The
model travels as a broadcast variable in groups of trees of at most ``GROUP_BYTES``, one
pass for each group, so its size is bounded on every executor whatever it was fitted on.
Rows are never exploded, joined back or told apart by an id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import workers_import

GROUP_BYTES = 64 << 20


NODES = "tree int, node int, feature int, threshold double, left int, right int, value array<double>"


@dataclass
class Tree:
    """Node arrays: a row goes right unless x[feature] < threshold (or <=, with ``closed``); feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # nodes x outputs

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.threshold, self.left, self.right, self.value))


def make_tree(splits: dict[int, tuple[int, float, int, int]], leaves: dict[int, list[float]], outputs: int, root: int = 0) -> Tree:
    """A tree from splits (feature, threshold, left node, right node) and leaf values, by node number."""
    nodes = [root, *sorted((set(splits) | set(leaves)) - {root})]
    at = {n: i for i, n in enumerate(nodes)}
    feature, left, right = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32)
    threshold, value = np.zeros(len(nodes)), np.zeros((len(nodes), outputs))
    for n, (f, t, a, b) in splits.items():
        feature[at[n]], threshold[at[n]], left[at[n]], right[at[n]] = f, t, at[a], at[b]
    for n, v in leaves.items():
        value[at[n]] = v
    return Tree(feature, threshold, left, right, value)


def walk(tree: Tree, x: np.ndarray, closed: bool) -> np.ndarray:
    """Leaf values (rows x outputs); a missing feature goes right."""
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[tree.feature[node[rows]] >= 0]
        here = node[rows]
        v, t = x[rows, tree.feature[here]], tree.threshold[here]
        goes_left = v <= t if closed else v < t
        node[rows] = np.where(goes_left, tree.left[here], tree.right[here])
    return tree.value[node]


def _group_sums(shared, outputs: int, closed: bool):
    @F.pandas_udf("array<double>")
    def sums(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        total = np.zeros((len(x), outputs))
        for tree in shared.value:
            total += walk(tree, x, closed)
        return pd.Series(list(total))
    return sums


def tree_groups(trees: list[Tree]) -> list[list[Tree]]:
    """Trees in groups of at most ``GROUP_BYTES``, or of one larger tree."""
    groups: list[list[Tree]] = [[]]
    room = GROUP_BYTES
    for tree in trees:
        if groups[-1] and tree.size > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(tree)
        room -= tree.size
    return groups


def tree_sums(df: DataFrame, features: list[str], trees: list[Tree], outputs: int, out_col: str, closed: bool) -> DataFrame:
    """``df`` plus ``out_col``: the sum of all trees' leaf values, an array of doubles."""
    spark = df.sparkSession
    workers_import(spark)
    out: Column | None = None
    for group in tree_groups(trees):
        sums = _group_sums(spark.sparkContext.broadcast(group), outputs, closed)(*[F.col(f).cast("double") for f in features])
        out = sums if out is None else F.zip_with(out, sums, lambda a, b: a + b)
    return df.withColumn(out_col, out if out is not None else F.array_repeat(F.lit(0.0), outputs))


def save_trees(spark: SparkSession, path: str, trees: list[Tree]) -> None:
    """One row for each node, in any store that the executors share."""
    rows = [(t, n, int(tree.feature[n]), float(tree.threshold[n]), int(tree.left[n]), int(tree.right[n]), tree.value[n].tolist())
            for t, tree in enumerate(trees) for n in range(len(tree.feature))]
    spark.createDataFrame(rows, NODES).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> list[Tree]:
    """Trees as they were saved; the model comes to the driver, as a fitted one is there."""
    rows: dict[int, list] = {}
    for r in spark.read.parquet(path).orderBy("tree", "node").collect():
        rows.setdefault(r["tree"], []).append(r)
    column = lambda nodes, name, kind: np.array([r[name] for r in nodes], kind)
    return [Tree(column(n, "feature", np.int32), column(n, "threshold", float), column(n, "left", np.int32),
                 column(n, "right", np.int32), column(n, "value", float)) for _, n in sorted(rows.items())]


_ARRAYS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}


def save_packed(spark: SparkSession, path: str, trees: list[Tree]) -> None:
    """One row a tree, its arrays as binary columns, in parts of at most ``GROUP_BYTES``."""
    schema = ", ".join(["tree int", *[f"`{c}` binary" for c in _ARRAYS]])
    first = 0
    for group in tree_groups(trees):
        rows = [(first + i, *(bytearray(np.ascontiguousarray(getattr(t, c), k).tobytes()) for c, k in _ARRAYS.items())) for i, t in enumerate(group)]
        first += len(group)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def load_packed(spark: SparkSession, path: str, outputs: int) -> list[Tree]:
    """Trees as they were saved, in order; the model comes to the driver, as a fitted one is there."""
    rows = sorted(spark.read.parquet(path).toLocalIterator(), key=lambda r: r["tree"])
    out = []
    for r in rows:
        arrays = {c: np.frombuffer(bytes(r[c]), k) for c, k in _ARRAYS.items()}
        out.append(Tree(**(arrays | {"value": arrays["value"].reshape(-1, outputs)})))
    return out
