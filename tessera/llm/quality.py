"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are computed once, in Arrow batches. Shallow trees, grown by
Spark ML over the labelled rows, give candidate rules: every path from a root is a
conjunction of comparisons. A logistic regression with a lasso penalty over the rules
keeps the few that matter, and these are compiled into one Spark column expression, so
scoring is a projection over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder, read, small, stored
from tessera.llm.kernels import ALNUM_WORDS, SPACE_WORDS, hash_words, text_buffer, tidied, word_chunks

TREES, DEPTH, PENALTY, SEED = 16, 4, 5e-4, 17

STATISTICS = ("n_chars", "n_words", "n_lines", "word_length", "upper", "digit", "space", "stop", "comma", "bang", "pipe", "symbol",
              "beyond_ascii", "distinct_words", "distinct_lines", "words_per_line", "top_word", "tokens_per_word", "repeated")

_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "comma", "bang", "pipe", "symbol", "high")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
for _name, _chars in (("stop", ".?:;"), ("comma", ",'\"()-"), ("bang", "!"), ("pipe", "|")):
    _CLASS[[ord(c) for c in _chars]] = _CLASSES.index(_name)
_CLASS[128:] = _CLASSES.index("high")

_LINES = np.ones(256, bool)
_LINES[10] = False


def _distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and how often the most frequent one stands."""
    n = len(counts)
    if not len(h):
        return np.zeros(n), np.zeros(n)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    of = owner[order][new]
    top = np.zeros(n)
    np.maximum.at(top, of, runs)
    return np.bincount(of, minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    data, off = text_buffer(column)
    out = np.zeros((len(off) - 1, len(STATISTICS)))
    for lo, hi, words, n in word_chunks(column, ALNUM_WORDS):
        part = data[off[lo] : off[hi]]
        bounds = off[lo : hi + 1] - off[lo]
        size, k = np.diff(bounds).astype(float), len(_CLASSES)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
        c = np.bincount(owner * k + _CLASS[part], minlength=(hi - lo) * k).reshape(-1, k).astype(float)
        lines, n_lines = hash_words(part, bounds, _LINES)
        _, n_tokens = hash_words(part, bounds, SPACE_WORDS)
        distinct_words, top = _distinct(words, n)
        distinct_lines, _ = _distinct(lines, n_lines)
        owners = np.repeat(np.arange(len(n)), n)
        again = np.bincount(owners[1:][(words[1:] == words[:-1]) & (owners[1:] == owners[:-1])], minlength=len(n))
        some, count, rows = np.maximum(size, 1), np.maximum(n, 1), np.maximum(n_lines, 1)
        col = {name: c[:, i] / some for i, name in enumerate(_CLASSES)}
        out[lo:hi] = np.column_stack([
            size, n, n_lines, (c[:, 0] + c[:, 1] + c[:, 2] + c[:, -1]) / count, col["upper"], col["digit"], col["space"], col["stop"],
            col["comma"], col["bang"], col["pipe"], col["symbol"], col["high"], distinct_words / count, distinct_lines / rows,
            n / rows, top / count, n_tokens / count, again / count])
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = statistics(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(values[:, i]) for i in range(values.shape[1]))],
                                         [*batch.schema.names[1:], *(f"s_{s}" for s in STATISTICS)])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus a column ``s_<statistic>`` for each statistic."""
    new = [f"s_{s}" for s in STATISTICS]
    wide = docs.select(F.col(text_col).cast("string").alias("_text"), *[c for c in docs.columns if c != text_col and c not in new])
    schema = wide.drop("_text").schema
    for c in new:
        schema = schema.add(c, "double")
    return wide.mapInArrow(lambda it: tidied(_rows(it)), schema)


Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", bound), ...


def _paths(node, path: Rule = ()) -> Iterator[Rule]:
    if path:
        yield path
    if node.subtreeDepth() > 0:
        split = node.split()
        i, bound = split.featureIndex(), float(split.threshold())
        yield from _paths(node.leftChild(), (*path, (i, "<=", bound)))
        yield from _paths(node.rightChild(), (*path, (i, ">", bound)))


def _tightest(rule: Rule) -> Rule:
    """One bound for each statistic and side, in order."""
    best: dict[tuple[int, str], float] = {}
    for i, op, bound in rule:
        old = best.get((i, op))
        best[i, op] = bound if old is None else (min if op == "<=" else max)(old, bound)
    return tuple(sorted((i, op, b) for (i, op), b in best.items()))


def compiled(rule: Rule) -> Column:
    out = F.lit(True)
    for i, op, bound in rule:
        c = F.col(f"s_{STATISTICS[i]}")
        out = out & ((c <= bound) if op == "<=" else (c > bound))
    return out.cast("double")


class RuleModel:
    """Weighted rules; ``score`` is a column over the statistics."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float) -> None:
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self) -> Column:
        line = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            line = line + F.lit(weight) * compiled(rule)
        return 1 / (1 + F.exp(-line))

    def __str__(self) -> str:
        return "\n".join(f"{w:+.3f}  " + " and ".join(f"{STATISTICS[i]} {op} {b:.4g}" for i, op, b in r)
                         for r, w in sorted(zip(self.rules, self.weights), key=lambda x: -abs(x[1])))


def fit(rows: DataFrame, label_col: str = "quality") -> RuleModel:
    """Rules from rows with statistics and a 0/1 label; other labels and nulls are left out.

    With fewer than two classes the model has no rules and scores the (smoothed) share of 1.
    """
    rows = rows.select(F.col(label_col).cast("double").alias("label"), *[f"s_{s}" for s in STATISTICS]).filter("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1.0, 0) + 0.5) / (sum(counts.values()) + 1)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    table = stored(rows.withColumn("features", array_to_vector(F.array(*[f"s_{s}" for s in STATISTICS]))))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(2, min(20, min(counts.values()) // 10)),
                                    subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED, cacheNodeIds=False).fit(table)
    rules = sorted({_tightest(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"))})
    applied = table.select("label", array_to_vector(F.array(*[compiled(r) for r in rules])).alias("features"))
    line = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60, tol=1e-5).fit(applied)
    kept = [(r, float(w)) for r, w in zip(rules, line.coefficients.toArray()) if w]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(line.intercept))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose crc32 of the id modulo 3 is not 1; repeated labels count as their least."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    table = stored(with_statistics(docs))
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = fit(table.filter(id_remainder("doc_id", 3) != 1).join(small(one), "doc_id"))
    return table.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
