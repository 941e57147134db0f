"""Interventional tree SHAP by a two-sample tree walk, and explanation tables (SH1-SH14).

For a row x, a background row z and a leaf, let A be the path features that only x
satisfies and B those that only z satisfies; if a path feature fails for both, the leaf
contributes nothing; otherwise each f in A gets +v (|A|-1)!|B|!/(|A|+|B|)! and each f
in B gets -v |A|!(|B|-1)!/(|A|+|B|)!. This equals the interventional Shapley value of
the leaf indicator.

An Arrow batch of rows and the background walk down a tree together. At a node both are
split; whoever leaves a box loses the node's feature. A row that has lost a feature which
all of the background has lost too is dropped, and the other way round, so only nodes
that some pair is consistent with are visited, and what is kept is one path of the walk.
At a leaf, rows and background are grouped by the features that they have lost (a mask of
64 bits). There is no table of rows and leaves, and no limit on leaves.

At a leaf with many different masks the sums over the background come from sums over the
subsets of the leaf's features, so they cost 2^features and not pairs of masks.

Trees travel in groups of bounded size, the background in parts of ``BACKGROUND_ROWS``; rows are
packed into blocks of ``EXPLAINED_ROWS``, and few blocks are shared by several tasks that have
some of the trees each. The work is rows and background rows times nodes. Models have at most
63 features.
"""

from __future__ import annotations

import functools
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.treewalk import Tree, make_tree, tree_groups, tree_sums
from tessera.session import checkpoint_dir, cut_lineage, workers_import

BACKGROUND_ROWS = 100_000
EXPLAINED_ROWS = 16_384
#: Pairs of masks at a leaf that are compared; most features of a leaf whose subsets are added up.
MASK_PAIRS, SUBSET_FEATURES = 1 << 18, 16
_FACT = [float(math.factorial(i)) for i in range(64)]
#: Weights by (|A|, |B|) of a feature in A, in B.
_IN_A = np.array([[_FACT[a - 1] * _FACT[b] / _FACT[a + b] if a and a + b < 64 else 0.0 for b in range(64)] for a in range(64)])
_IN_B = np.array([[_FACT[a] * _FACT[b - 1] / _FACT[a + b] if b and a + b < 64 else 0.0 for b in range(64)] for a in range(64)])


@dataclass
class TreeModel:
    """Trees whose leaf values, times ``weight``, add up to the output.

    ``closed``: x goes left when x <= threshold, else when x < threshold. ``kind``:
    'probability' (tree, forest) or 'margin' (booster).
    """

    trees: list[Tree]
    outputs: int
    weight: float = 1.0
    closed: bool = True
    kind: str = "probability"


def literal_tree(splits: dict[int, tuple], leaves: dict[int, list[float]], n_classes: int) -> TreeModel:
    """A literal tree: splits {node: (feature_index, threshold, left, right)}, leaves {node: values}."""
    return TreeModel([make_tree(splits, leaves, n_classes)], n_classes)


def spark_trees(model, n_classes: int) -> TreeModel:
    """Trees of a fitted Spark DecisionTree / RandomForest classifier.

    The model is written with Spark ML persistence to the shared checkpoint folder and its
    node table read back; the driver holds the model, as it does after the fit.
    """
    spark = SparkSession.getActiveSession()
    path = os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)
    model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    nodes = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.select(F.lit(0).alias("treeID"), "*")
    splits: dict[int, dict] = {}
    leaves: dict[int, dict] = {}
    for r in nodes.select("treeID", "id", "split", "leftChild", "rightChild", "impurityStats").collect():
        t = r["treeID"]
        splits.setdefault(t, {}), leaves.setdefault(t, {})
        if r["leftChild"] < 0:
            st = list(r["impurityStats"]) + [0.0] * (n_classes - len(r["impurityStats"]))
            total = sum(st)
            leaves[t][r["id"]] = [v / total if total else 0.0 for v in st]
        else:
            cut = r["split"]["leftCategoriesOrThreshold"]
            splits[t][r["id"]] = (r["split"]["featureIndex"], float(cut[0]) if cut else 0.0, r["leftChild"], r["rightChild"])
    return TreeModel([make_tree(splits[t], leaves[t], n_classes) for t in sorted(splits)], n_classes, 1.0 / len(splits))


def two_sample_walk(tree: Tree, x: np.ndarray, z: np.ndarray, closed: bool, out: np.ndarray) -> None:
    """Adds the sum over z of the tree's Shapley values of each row of x to ``out`` (rows x features x outputs)."""
    bits = np.int64(1) << np.arange(x.shape[1], dtype=np.int64)
    x, z = np.ascontiguousarray(x.T), np.ascontiguousarray(z.T)
    none = np.zeros(z.shape[1], np.int64)
    stack = [(0, np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64), np.arange(z.shape[1]), none)] if x.shape[1] and z.shape[1] else []
    while stack:
        node, rows, lost_x, back, lost_z = stack.pop()
        f = tree.feature[node]
        if f < 0:
            _leaf(tree.value[node], rows, lost_x, lost_z, bits, out)
            continue
        t = tree.threshold[node]
        left_x, left_z = (x[f][rows] <= t, z[f][back] <= t) if closed else (x[f][rows] < t, z[f][back] < t)
        for child, in_x, in_z in ((tree.left[node], left_x, left_z), (tree.right[node], ~left_x, ~left_z)):
            a, b = np.where(in_x, lost_x, lost_x | bits[f]), np.where(in_z, lost_z, lost_z | bits[f])
            keep = (a & np.bitwise_and.reduce(b)) == 0
            if not keep.any():
                continue
            a, kept = a[keep], rows[keep]
            stay = (b & np.bitwise_and.reduce(a)) == 0
            if stay.any():
                stack.append((child, kept, a, back[stay], b[stay]))


def _leaf(value: np.ndarray, rows: np.ndarray, lost_x: np.ndarray, lost_z: np.ndarray, bits: np.ndarray, out: np.ndarray) -> None:
    if not value.any() or not (lost_x.any() or lost_z.any()):
        return
    ux, of = np.unique(lost_x, return_inverse=True)
    uz, n = np.unique(lost_z, return_counts=True)
    used = np.flatnonzero((np.bitwise_or.reduce(ux) | np.bitwise_or.reduce(uz)) & bits)
    if len(ux) * len(uz) > MASK_PAIRS and len(used) <= SUBSET_FEATURES:
        phi = _by_subsets(ux, uz, n, used)
    else:
        step = max(1, MASK_PAIRS // len(ux))
        phi = sum(_by_pairs(ux, uz[i : i + step], n[i : i + step], bits[used]) for i in range(0, len(uz), step))
    out[rows[:, None], used] += phi[of][:, :, None] * value


def _by_pairs(ux: np.ndarray, uz: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sums over the background masks ``uz`` (``n`` rows each) by mask of x and feature (``bits``) of a leaf."""
    na, nb = np.bitwise_count(uz), np.bitwise_count(ux)
    # by mask of z: its features and a one, times its rows
    seen = np.column_stack([(uz[:, None] & bits) != 0, np.ones(len(uz))]) * n[:, None]
    met = ((ux[:, None] & uz[None, :]) == 0).astype(float)  # pairs without a feature that both have lost
    gain, loss = np.zeros((len(ux), len(bits))), np.zeros(len(ux))
    for a in np.unique(na):
        found = met[:, na == a] @ seen[na == a]
        gain += _IN_A[a, nb][:, None] * found[:, :-1]
        loss += _IN_B[a, nb] * found[:, -1]
    return gain - loss[:, None] * ((ux[:, None] & bits) != 0)


@functools.lru_cache(SUBSET_FEATURES + 1)
def _subset_weights(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by (size of a mask of z, features that x has not lost, as a mask): of A, of A with one more lost, of B."""
    size, left = np.arange(d + 1)[:, None], d - np.bitwise_count(np.arange(1 << d)).astype(np.int64)
    return _IN_A[size, left], _IN_A[size, np.maximum(left - 1, 0)], _IN_B[size, left]


def _by_subsets(ux: np.ndarray, uz: np.ndarray, n: np.ndarray, used: np.ndarray) -> np.ndarray:
    """``_by_pairs`` from the sums of ``n`` over all subsets of the leaf's features, by size of the masks."""
    d = len(used)

    def local(masks: np.ndarray) -> np.ndarray:
        return sum(((masks >> f) & 1) << j for j, f in enumerate(used))
    sums = np.zeros((d + 1, 1 << d))
    sums[np.bitwise_count(uz), local(uz)] = n
    for j in range(d):
        half = sums.reshape(d + 1, -1, 2, 1 << j)
        half[:, :, 1] += half[:, :, 0]
    in_a, in_a_less, in_b = _subset_weights(d)
    with_f, without_f, loss = ((w * sums).sum(axis=0) for w in (in_a, in_a_less, in_b))
    held = ((1 << d) - 1) ^ local(ux)  # background masks that meet a mask of x are subsets of these
    one = 1 << np.arange(d)
    # masks with a feature are all less those without it
    return np.where(held[:, None] & one, with_f[held][:, None] - without_f[held[:, None] & ~one], -loss[held][:, None])


_UNIT = "block long, n int, ids binary, x binary"
_PHI = "block long, n int, ids binary, phi binary"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, features ...) as blocks of ids (an Arrow stream) and features."""
    def block(table: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        ids = table.select([0]).combine_chunks()
        with pa.ipc.new_stream(sink, ids.schema) as writer:
            writer.write_table(ids)
        x = np.column_stack([table.column(1 + f).to_numpy().astype(float) for f in range(table.num_columns - 1)])
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                           pa.array([x.tobytes()], pa.binary())], ["n", "ids", "x"])
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= EXPLAINED_ROWS:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, EXPLAINED_ROWS))
            held = table.slice(EXPLAINED_ROWS).to_batches()
    if sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held))


def _let_go(shared: Broadcast) -> None:
    """A worker that goes through many sent values holds one at a time."""
    if getattr(shared, "_path", None):  # where it is read from again
        vars(shared).pop("_value", None)


def _walked(groups: list[Broadcast], backgrounds: list[Broadcast], slices: int, nf: int, outputs: int, closed: bool,
            batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed Shapley values (rows x features x outputs) of blocks with the number of a share of the trees."""
    for batch in batches:
        for block, n, ids, raw, turn in zip(*(batch.column(i) for i in range(5))):
            x = np.frombuffer(raw.as_buffer(), np.float64).reshape(n.as_py(), nf)
            out = np.zeros((len(x), nf, outputs))
            for trees in groups:
                for back in backgrounds:
                    for tree in trees.value[turn.as_py() :: slices]:
                        two_sample_walk(tree, x, back.value, closed, out)
                    if len(backgrounds) > 1:
                        _let_go(back)
                if len(groups) > 1:
                    _let_go(trees)
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([len(x)], pa.int32()), pa.array([ids.as_py()], pa.binary()),
                                              pa.array([out.tobytes()], pa.binary())], [c.split()[0] for c in _PHI.split(", ")])


def _added_up(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and Shapley values (flat) of the rows of blocks, whose parts come one after the other."""
    at = ids = total = None

    def rows() -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) // width + 1, dtype=np.int32) * width), pa.array(total))
        return pa.RecordBatch.from_arrays([pa.ipc.open_stream(ids).read_all().column(0).combine_chunks(), lists], ["id", "phi"])
    for batch in batches:
        for block, _, names, raw in zip(*(batch.column(i) for i in range(4))):
            phi = np.frombuffer(raw.as_buffer(), np.float64)
            if block.as_py() != at:
                if at is not None:
                    yield rows()
                at, ids, total = block.as_py(), names.as_py(), phi.copy()
            else:
                total += phi
    if at is not None:
        yield rows()


def tree_shap(rows: DataFrame, background: DataFrame, features: list[str], model: TreeModel,
              id_col: str) -> DataFrame:
    """SH1: phi(row, feature, class) for every row, feature and class.

    Output columns: id_col, feature, class (int), phi; 0 for features off all paths. Rows of
    equal id stay rows of their own. The background is sent to the tasks part by part.
    """
    if len(features) > 63:
        raise ValueError("tree SHAP takes at most 63 features")
    spark = rows.sparkSession
    workers_import(spark)
    values = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    nf, nz = len(features), background.count()
    parts = max(1, -(-nz // BACKGROUND_ROWS))
    back = background.select(*values)
    if parts > 1:
        back = cut_lineage(back.select("*", (F.monotonically_increasing_id() % parts).alias("part")))
    else:
        back = back.withColumn("part", F.lit(0))
    blocks = max(1, -(-rows.count() // EXPLAINED_ROWS))
    groups = tree_groups(model.trees)
    slices = min(max(map(len, groups)) or 1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    packed = rows.select(F.col(id_col).alias("id"), *values).repartition(blocks).mapInArrow(_unit_rows, "n int, ids binary, x binary")
    units = cut_lineage(packed.select(F.monotonically_increasing_id().alias("block"), "n", "ids", "x"))
    # the walk is long for each block: blocks are dealt out with shares of the trees
    units = units.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(blocks * slices)
    trees = [spark.sparkContext.broadcast(group) for group in groups]
    sent = [spark.sparkContext.broadcast(back.where(F.col("part") == part).drop("part").toPandas().to_numpy(float)) for part in range(parts)]
    found = units.mapInArrow(lambda it: _walked(trees, sent, slices, nf, model.outputs, model.closed, it), _PHI)
    width = nf * model.outputs
    if slices > 1:
        found = found.repartition(blocks, "block").sortWithinPartitions("block")
    found = found.mapInArrow(lambda it: _added_up(width, it), f"id {rows.schema[id_col].dataType.simpleString()}, phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    scale = model.weight / max(nz, 1)
    place = F.col("place")
    found = found.select("id", F.posexplode("phi").alias("place", "p"))
    return found.select(F.col("id").alias(id_col), F.element_at(names, F.floor(place / model.outputs).cast("int") + 1).alias("feature"),
                        (place % model.outputs).cast("int").alias("class"), (F.col("p") * scale).alias("phi"))


def _outputs(df: DataFrame, features: list[str], model: TreeModel) -> DataFrame:
    return tree_sums(df, features, model.trees, model.outputs, "__out", model.closed)


def base_values(background: DataFrame, features: list[str], model: TreeModel) -> DataFrame:
    """SH2: per class, the mean model output over the background."""
    ex = _outputs(background, features, model).select(F.posexplode("__out").alias("class", "v"))
    return ex.groupBy(F.col("class").cast("int").alias("class")).agg((F.avg("v") * F.lit(float(model.weight))).alias("base"))


def model_output(rows: DataFrame, features: list[str], model: TreeModel, id_col: str) -> DataFrame:
    """f(x) per (row, class): sum over trees of weight * value at the reached leaf."""
    ex = _outputs(rows, features, model).select(id_col, F.posexplode("__out").alias("class", "v"))
    return ex.select(id_col, F.col("class").cast("int").alias("class"), (F.col("v") * F.lit(float(model.weight))).alias("fx"))


# ---------------------------------------------------------------- SH3 / SH4
def predicted_class_values(shap: DataFrame, predictions: DataFrame, id_col: str,
                           pred_col: str = "prediction") -> DataFrame:
    """SH3: keep each row's predicted class."""
    p = predictions.select(id_col, F.col(pred_col).cast("int").alias("class"))
    return shap.join(p, [id_col, "class"])


def importance_table(shap: DataFrame, predictions: DataFrame, id_col: str, features: list[str],
                     classes: list[str], pred_col: str = "prediction") -> DataFrame:
    """SH4: mean |phi| for the predicted class, over all classes, and per class;
    zero for features never used; sorted by the first column (desc, then name)."""
    spark = shap.sparkSession
    n = predictions.count()
    proj = predicted_class_values(shap, predictions, id_col, pred_col)
    pc = proj.groupBy("feature").agg((F.sum(F.abs("phi")) / F.lit(float(n))).alias("mean_abs_shap_predicted_class"))
    per = shap.groupBy("feature").pivot("class", list(range(len(classes)))).agg(
        (F.sum(F.abs("phi")) / F.lit(float(n))))
    cols = {i: f"mean_abs_shap_{c.lower().replace(' ', '_').replace('-', '_')}" for i, c in enumerate(classes)}
    per = per.select("feature", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(cols[i]) for i in cols])
    allc = sum((F.col(c) for c in cols.values()), F.lit(0.0)) / F.lit(float(len(classes)))
    feats = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "pos int, feature string")
    out = feats.join(pc, "feature", "left").join(per, "feature", "left").na.fill(0.0)
    out = out.withColumn("mean_abs_shap_all_classes", allc)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs_shap_predicted_class"), F.asc("feature"))
    return out.withColumn("rank", F.row_number().over(w)).drop("pos")


# ---------------------------------------------------------------- SH5 / SH6 / SH7
def local_contributions(shap_pred: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """SH5: per row: value, phi, |phi|, direction ('supports' if phi >= 0), impact share."""
    w = Window.partitionBy(id_col)
    j = shap_pred.join(values, [id_col, "feature"], "left")
    tot = F.sum(F.abs("phi")).over(w)
    return j.select(id_col, "feature", "value", "phi", F.abs("phi").alias("abs_phi"),
                    F.when(F.col("phi") >= 0, "supports").otherwise("opposes").alias("direction"),
                    F.when(tot == 0, F.lit(0.0)).otherwise(F.abs("phi") / tot).alias("impact_share"))


def top_drivers(local: DataFrame, id_col: str, top: int = 10, per_side: int = 3) -> DataFrame:
    """SH6: the ``top`` strongest drivers per row, then up to ``per_side`` positive and
    negative (zeros in neither); ties -> feature name."""
    w = Window.partitionBy(id_col).orderBy(F.desc("abs_phi"), F.asc("feature"))
    t = local.withColumn("strength_rank", F.row_number().over(w)).where(F.col("strength_rank") <= top)
    side = F.when(F.col("phi") > 0, "positive").when(F.col("phi") < 0, "negative")
    t = t.withColumn("side", side).where(F.col("side").isNotNull())
    w2 = Window.partitionBy(id_col, "side").orderBy(F.desc("abs_phi"), F.asc("feature"))
    return t.withColumn("side_rank", F.row_number().over(w2)).where(F.col("side_rank") <= per_side)


def driver_sentences(drivers: DataFrame, id_col: str, label_col: str = "label", class_col: str = "class_name",
                     integer: bool = False) -> DataFrame:
    """SH7: per driver its label, value (SC4), whether it speaks for or against the predicted
    class, SHAP value (3 decimals) and share of the impact (1 decimal)."""
    from tessera.functions.scalar import fixed, format_value
    txt = F.concat(F.col(label_col), F.lit(" at "), format_value("value", integer),
                   F.when(F.col("phi") >= 0, " speaks for ").otherwise(" speaks against "), F.col(class_col),
                   F.lit(": SHAP "), fixed(F.col("phi"), 3), F.lit(", "),
                   fixed(F.col("impact_share") * 100, 1), F.lit("% of the impact"))
    return drivers.withColumn("sentence", txt)


# ---------------------------------------------------------------- SH8 / SH9 / SH10
def waterfall(shap_pred: DataFrame, base: DataFrame, id_col: str, max_display: int = 10) -> DataFrame:
    """SH8: one row's waterfall: base, the top (max_display-1) contributions by |phi|, the
    rest collapsed into one 'other features' step unless it is a single one; running end value."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("phi")), F.asc("feature"))
    r = shap_pred.withColumn("r", F.row_number().over(w))
    r = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    max_rank = F.when(F.col("n") <= max_display, F.col("n") + 1).otherwise(max_display)
    r = r.withColumn("cut", max_rank)
    keep = r.where(F.col("r") < F.col("cut")).select(id_col, "class", "feature", "phi", "r")
    other = (r.where(F.col("r") >= F.col("cut")).groupBy(id_col, "class")
               .agg(F.sum("phi").alias("phi"), F.count(F.lit(1)).alias("n"))
               .select(id_col, "class", F.format_string("%d other features", F.col("n")).alias("feature"),
                       "phi", F.lit(max_display).alias("r")))
    steps = keep.unionByName(other).join(base, "class")
    ws = Window.partitionBy(id_col).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("end", F.col("base") + F.sum("phi").over(ws))


def top_features(importance: DataFrame, col: str = "mean_abs_shap_predicted_class", k: int = 15) -> DataFrame:
    """SH9/SH13: top-k features of an importance column (desc, then name)."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), F.asc("feature"))
    return importance.select("feature", F.col(col).alias("importance")).withColumn(
        "rank", F.row_number().over(w)).where(F.col("rank") <= k)


def beeswarm(shap_pred: DataFrame, values: DataFrame, importance: DataFrame, id_col: str,
             k: int = 15) -> DataFrame:
    """SH10: (feature, phi, feature value) for the top-k features."""
    top = top_features(importance, k=k).select("feature", "rank")
    return shap_pred.join(F.broadcast(top), "feature").join(values, [id_col, "feature"], "left")


# ---------------------------------------------------------------- SH11-SH14
def compare_importances(tables: dict[str, DataFrame], col: str = "mean_abs_shap_predicted_class",
                        k: int = 15) -> DataFrame:
    """SH11/JN1/AG19: full outer join of per-model importances on feature, nulls -> 0,
    row-wise mean, top-k by the mean."""
    out = None
    for name, t in tables.items():
        s = t.select("feature", F.col(col).alias(name))
        out = s if out is None else out.join(s, "feature", "full")
    out = out.na.fill(0.0, subset=list(tables))
    mean = sum((F.col(n) for n in tables), F.lit(0.0)) / F.lit(float(len(tables)))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("average"), F.asc("feature"))
    return out.withColumn("average", mean).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def importance_views(importance: DataFrame, classes: list[str]) -> list[str]:
    """SH12: available views: all classes first, then classes whose column exists."""
    views = []
    if "mean_abs_shap_all_classes" in importance.columns:
        views.append("mean_abs_shap_all_classes")
    for c in classes:
        n = f"mean_abs_shap_{c.lower().replace(' ', '_').replace('-', '_')}"
        if n in importance.columns:
            views.append(n)
    return views


def importance_by_view(importance: DataFrame, view: str | None, classes: list[str], k: int = 12) -> DataFrame:
    """SH13: numeric-coerced importance of the chosen view (unknown -> default), top k."""
    views = importance_views(importance, classes)
    v = view if view in views else (views[0] if views else None)
    if v is None:
        raise ValueError("no importance view available")
    t = importance.select("feature", F.expr(f"try_cast(`{v}` as double)").alias("importance"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("importance"), F.asc("feature"))
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("view", F.lit(v))


def primary_features(importance: DataFrame | None, known: list[str], fallback: list[str],
                     count: int = 10) -> list[str]:
    """SH14: first ``count`` distinct known features by importance order, else fallback."""
    if importance is not None:
        w = Window.partitionBy("feature").orderBy("rank")
        ranked = (importance.where(F.col("feature").isin(known))
                  .withColumn("r1", F.row_number().over(w)).where(F.col("r1") == 1)
                  .orderBy("rank").limit(count).collect())
        if len(ranked) >= count:
            return [r["feature"] for r in ranked]
    return [f for f in fallback if f in known][:count]
