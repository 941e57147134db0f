"""Models: registry, fit, predict with probabilities, importances, CV (ML1-ML11).

Tree and forest models are Spark ML estimators (distributed, histogram based).
Multiclass boosting and extra trees have no Spark class; they live in
``boosting.py`` and ``extratrees.py`` as jobs over packed blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Callable

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics as M

DEFAULT_MODEL = "XGBoost"


@dataclass
class ModelSpec:
    name: str
    build: Callable[[], object]
    kind: str  # "spark" | "softmax" | "extra"


def _dt():
    return DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=20, seed=42, maxBins=64)


def _rf():
    return RandomForestClassifier(numTrees=150, maxDepth=15, minInstancesPerNode=20,
                                  featureSubsetStrategy="sqrt", seed=42, maxBins=64)


def _boost():
    from tessera.operators.boosting import SoftmaxBooster
    return SoftmaxBooster(rounds=300, max_depth=6, eta=0.05, subsample=0.8, colsample=0.8,
                          min_child_weight=5.0, seed=42)


def _ovr_gbt():
    return OneVsRest(classifier=GBTClassifier(maxIter=300, maxDepth=6, stepSize=0.05,
                                              subsamplingRate=0.8, featureSubsetStrategy="0.8",
                                              seed=42, maxBins=64))


def _extra():
    from tessera.operators.extratrees import ExtraTrees
    return ExtraTrees(n_trees=250, min_leaf=10, max_features="sqrt", seed=42)


CORE_MODELS = {
    "Decision Tree": ModelSpec("Decision Tree", _dt, "spark"),
    "Random Forest": ModelSpec("Random Forest", _rf, "spark"),
    "XGBoost": ModelSpec("XGBoost", _boost, "softmax"),
}
EXTENDED_MODELS = {
    "Extra Trees": ModelSpec("Extra Trees", _extra, "extra"),
    "OvR GBT": ModelSpec("OvR GBT", _ovr_gbt, "spark"),
}


def model_registry(include_extended: bool = False) -> dict[str, ModelSpec]:
    """ML9: the shared registry; extended adds the comparison-only models."""
    reg = dict(CORE_MODELS)
    if include_extended:
        reg.update(EXTENDED_MODELS)
    return reg


def normalise_model_name(name: str | None, include_extended: bool = True) -> str:
    """ML9: unknown / blank names fall back to the default model."""
    reg = model_registry(include_extended)
    if name in reg:
        return name
    if name:
        low = {k.lower().replace(" ", "_"): k for k in reg}
        key = name.strip().lower().replace(" ", "_").replace("-", "_")
        if key in low:
            return low[key]
    return DEFAULT_MODEL


def assemble(df: DataFrame, features: list[str], out_col: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out_col, handleInvalid="keep").transform(df)


def fit(name: str, train: DataFrame, features: list[str], label_col: str = "label",
        max_depth: int | None = None, n_trees: int | None = None, rounds: int | None = None):
    """Fit a registry model on an encoded, imputed frame (parameters overridable)."""
    spec = model_registry(True)[normalise_model_name(name)]
    est = spec.build()
    if spec.kind == "spark":
        if max_depth is not None:
            if isinstance(est, OneVsRest):
                est.getClassifier().setMaxDepth(max_depth)
            else:
                est.setMaxDepth(max_depth)
        if n_trees is not None and hasattr(est, "setNumTrees"):
            est.setNumTrees(n_trees)
        if rounds is not None and isinstance(est, OneVsRest):
            est.getClassifier().setMaxIter(rounds)
        est.setFeaturesCol("features").setLabelCol(label_col)
        return est.fit(assemble(train, features))
    if max_depth is not None:
        est.max_depth = max_depth
    if n_trees is not None and hasattr(est, "n_trees"):
        est.n_trees = n_trees
    if rounds is not None and hasattr(est, "rounds"):
        est.rounds = rounds
    return est.fit(train, features, label_col)


def predict(model, df: DataFrame, features: list[str], n_classes: int) -> DataFrame:
    """ML7: ``prediction`` (double code) and ``probability`` (array<double>, one slot per
    class; classes never seen by the model get 0.0)."""
    from pyspark.ml.classification import OneVsRestModel
    if hasattr(model, "predict_frame"):
        return model.predict_frame(df, features)
    out = model.transform(assemble(df, features))
    if isinstance(model, OneVsRestModel):
        # per-class margins -> sigmoid(2*margin) per class, normalised
        raw = vector_to_array("rawPrediction")
        sig = F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
        out = out.withColumn("__sig", sig)
        tot = F.aggregate("__sig", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform("__sig", lambda s: s / tot)).drop("__sig")
    else:
        out = out.withColumn("probability", vector_to_array("probability"))
    k = F.size("probability")
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(n_classes) - k, F.lit(0)))
    out = out.withColumn("probability", F.concat("probability", pad))
    return out.drop("features", "rawPrediction")


def feature_importances(model, features: list[str], top: int | None = 10) -> DataFrame:
    """ML8: importances (impurity gain for Spark trees, gain for the booster), descending,
    numbered 1..n; ties by feature name."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if hasattr(model, "feature_importances"):
        imp = model.feature_importances()
    else:
        v = model.featureImportances.toArray()
        imp = {f: float(v[i]) for i, f in enumerate(features)}
    df = spark.createDataFrame([(f, float(imp.get(f, 0.0))) for f in features],
                               "feature string, importance double")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), F.asc("feature"))
    df = df.withColumn("rank", F.row_number().over(w))
    return df.where(F.col("rank") <= top) if top else df


def _fold_scores(counts: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Macro F1 and balanced accuracy of each fold from counts (fold, actual, predicted, n)."""
    folds = sorted(r[0] for r in counts.select(fold_col).distinct().collect())
    one = [M.label_metrics(counts.where(F.col(fold_col) == f).drop(fold_col)).select(
        F.lit(f).alias("fold"), F.col("macro_f1").alias("score"), "balanced_accuracy") for f in folds]
    return reduce(DataFrame.unionByName, one)


def fit_and_validate(name: str, data: DataFrame, features: list[str], n_classes: int, fold_col: str = "fold", k: int = 5,
                     label_col: str = "label", id_col: str = "row_id", with_model: bool = True, **overrides):
    """(model of all rows, counts of fold, actual, predicted, n of the rows that each fold's fit has not seen).

    The booster's fits share every pass over the data; other models have one job for each
    fold, some at a time. ``data`` should be stored, it is read by all fits.
    """
    spec = model_registry(True)[normalise_model_name(name)]
    if spec.kind == "softmax":
        est = spec.build()
        for key, value in overrides.items():
            if value is not None and hasattr(est, key):
                setattr(est, key, value)
        models, counts = est.fit_folds(data, features, label_col, id_col, fold_col, k)
        return models[0], counts.select("fold", F.col("label").cast("double").alias("actual"),
                                        F.col("prediction").cast("double").alias("predicted"), "n")

    def one(f: int):
        if f < 0:
            return fit(name, data, features, label_col, **overrides) if with_model else None
        m = fit(name, data.where(F.col(fold_col) != f), features, label_col, **overrides)
        sc = predict(m, data.where(F.col(fold_col) == f), features, n_classes)
        found = [(f, *r) for r in M.confusion_counts(sc, label_col, "prediction").collect()]  # classes x classes
        if hasattr(m, "drop"):
            m.drop()  # a fold's model only scores its fold
        return found
    with ThreadPool(2) as pool:
        done = pool.map(one, range(-1, k))
    rows = [(f, float(a), float(p), n) for part in done[1:] for f, a, p, n in part]
    return done[0], data.sparkSession.createDataFrame(rows, "fold int, actual double, predicted double, n long")


def cv_row(counts: DataFrame) -> DataFrame:
    """Mean and population std over folds, of counts (fold, actual, predicted, n)."""
    return _fold_scores(counts).agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"),
                                    F.avg("balanced_accuracy").alias("cv_bal_mean"),
                                    F.stddev_pop("balanced_accuracy").alias("cv_bal_std"))


def cross_validate(name: str, data: DataFrame, features: list[str], classes: list,
                   fold_col: str = "fold", k: int = 5, label_col: str = "label", id_col: str = "row_id",
                   **overrides) -> DataFrame:
    """ML11: per-fold macro F1 and balanced accuracy, then mean and population std.

    ``data`` carries a stratified ``fold`` column (SM4). Each fold is scored by a fit on
    the other folds; the frame should be stored by the caller.
    """
    return cv_row(fit_and_validate(name, data, features, len(classes), fold_col, k, label_col, id_col, with_model=False, **overrides)[1])


def run_experiments(names: list[str], train: DataFrame, test: DataFrame, features: list[str],
                    classes: list, label_col: str = "label", fold_col: str | None = None, k: int = 5,
                    fitted: dict | None = None, **overrides) -> DataFrame:
    """ML10: fit each model on ``train``, evaluate on ``test``; ranked comparison (ME13).

    With ``fold_col`` every model is also cross-validated over the folds of ``train``.
    ``fitted`` gives (model, fold counts) of models that are already fitted.
    """
    rows = []
    codes = list(range(len(classes))) if isinstance(classes[0], str) else classes
    for n in names:
        if fitted and n in fitted:
            m, counts = fitted[n]
        elif fold_col:
            m, counts = fit_and_validate(n, train, features, len(classes), fold_col, k, label_col, **overrides)
        else:
            m, counts = fit(n, train, features, label_col, **overrides), None
        sc = predict(m, test, features, len(classes))
        rows.append(M.model_metrics(n, sc, codes, label_col, "prediction", "probability",
                                    cv_row(counts) if counts is not None else None))
    return M.compare_models(rows)
