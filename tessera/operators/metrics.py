"""Imbalance-aware evaluation (ME1-ME14).

Label-based metrics all derive from ONE aggregate: ``groupBy(label, prediction)
.count()`` (partial aggregation; output <= C*C rows). Everything after that runs
on class-sized tables. AUC is exact (tie-averaged ranks) and computed from
(class, score) -> (positives, negatives) aggregates, never from row-level sorts of
a whole class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import range_bucket
from tessera.functions.exact import safe_div


def confusion_counts(pred: DataFrame, label_col: str = "label",
                     pred_col: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for observed pairs only."""
    return pred.groupBy(F.col(label_col).alias("actual"),
                        F.col(pred_col).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _class_frame(spark, classes: list, name: str = "cls") -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)],
                                 f"code int, {name} {_spark_type(classes)}")


def _spark_type(values: list) -> str:
    v = values[0]
    if isinstance(v, str):
        return "string"
    if isinstance(v, float):
        return "double"
    return "long"


def confusion_matrix_long(counts: DataFrame, classes: list) -> DataFrame:
    """ME1 (long): every (actual, predicted) pair over the full class list, 0 filled."""
    spark = counts.sparkSession
    t = _spark_type(classes)
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes],
                                 f"actual {t}, predicted {t}")
    return (grid.join(counts, ["actual", "predicted"], "left")
                .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_matrix_wide(counts: DataFrame, classes: list, names: list[str] | None = None) -> DataFrame:
    """ME1 (wide): rows = actual, one column per predicted class (IO4 layout)."""
    names = names or [str(c) for c in classes]
    long = confusion_matrix_long(counts, classes)
    wide = long.groupBy("actual").pivot("predicted", classes).agg(F.sum("n"))
    return wide.select("actual", *[F.col(f"`{c}`").alias(n) for c, n in zip(classes, names)])


def class_stats(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class in truth ∪ prediction: tp, support (true count), predicted count; apart for each value of ``by``."""
    n = F.col("n")
    z = F.lit(0).cast("long")
    rows = F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), n.alias("t"), z.alias("p"),
                 F.when(F.col("actual") == F.col("predicted"), n).otherwise(z).alias("tp")),
        F.struct(F.col("predicted").alias("cls"), z.alias("t"), n.alias("p"), z.alias("tp")),
    ))
    return (counts.select(*by, rows.alias("s")).select(*by, "s.*").groupBy(*by, "cls")
                  .agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"),
                       F.sum("p").alias("predicted")))


def _per_class(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    tp, t, p = F.col("tp"), F.col("support"), F.col("predicted")
    return stats.select(
        *by, "cls", "tp", "support", "predicted",
        safe_div(tp, p).alias("precision"),
        F.when(t > 0, tp / t).alias("recall"),
        safe_div(F.lit(2) * tp, t + p).alias("f1"),
    )


def label_metrics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ME2-ME7 in one row (for each value of ``by``): accuracy, balanced_accuracy, weighted_precision,
    macro_precision, macro_f1, mcc. Macro averages run over classes present in
    truth ∪ prediction; balanced accuracy over classes present in truth."""
    pc = _per_class(class_stats(counts, by), by)
    agg = pc.groupBy(*by).agg(
        F.sum("support").cast("double").alias("N"),
        F.sum("tp").cast("double").alias("C"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("precision") * F.col("support")).alias("__wp"),
        # exact integer sums (decimal avoids long overflow at scale), then double
        F.sum(F.col("support").cast("decimal(38,0)") * F.col("predicted")).cast("double").alias("__tp_dot"),
        F.sum(F.col("predicted").cast("decimal(38,0)") * F.col("predicted")).cast("double").alias("__pp"),
        F.sum(F.col("support").cast("decimal(38,0)") * F.col("support")).cast("double").alias("__tt"),
    )
    N, C = F.col("N"), F.col("C")
    cov_tp = C * N - F.col("__tp_dot")
    cov_pp = N * N - F.col("__pp")
    cov_tt = N * N - F.col("__tt")
    mcc = F.when(cov_pp * cov_tt == 0, F.lit(0.0)).otherwise(cov_tp / F.sqrt(cov_tt * cov_pp))
    return agg.select(
        *by,
        (C / N).alias("accuracy"),
        F.col("balanced_accuracy"),
        (F.col("__wp") / N).alias("weighted_precision"),
        F.col("macro_precision"),
        F.col("macro_f1"),
        mcc.alias("mcc"),
    )


def classification_report(counts: DataFrame, classes: list, names: list[str] | None = None) -> DataFrame:
    """ME8: per-class precision/recall/f1/support over the full class list, then
    'accuracy', 'macro avg' (all listed classes) and 'weighted avg' rows."""
    spark = counts.sparkSession
    names = names or [str(c) for c in classes]
    cls = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(classes, names))],
                                f"pos int, cls {_spark_type(classes)}, label string")
    pc = cls.join(_per_class(class_stats(counts)), "cls", "left").select(
        "pos", "label",
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.coalesce("recall", F.lit(0.0)).alias("recall"),
        F.coalesce("f1", F.lit(0.0)).alias("f1_score"),
        F.coalesce("support", F.lit(0)).cast("double").alias("support"),
        F.coalesce("tp", F.lit(0)).cast("double").alias("tp"),
    )
    k = len(classes)
    tot = pc.agg(F.sum("support").alias("N"), F.sum("tp").alias("C"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                 F.avg("f1_score").alias("mf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    N = F.col("N")
    acc = F.col("C") / N
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit(k).alias("pos"), F.lit("accuracy").alias("label"), acc.alias("precision"),
                 acc.alias("recall"), acc.alias("f1_score"), N.alias("support")),
        F.struct(F.lit(k + 1).alias("pos"), F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), N.alias("support")),
        F.struct(F.lit(k + 2).alias("pos"), F.lit("weighted avg").alias("label"),
                 (F.col("wp") / N).alias("precision"), (F.col("wr") / N).alias("recall"),
                 (F.col("wf") / N).alias("f1_score"), N.alias("support")),
    )).alias("r")).select("r.*")
    return pc.drop("tp").unionByName(summary)


def score_buckets(sc: DataFrame, buckets: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (code, score, ...) with ``bucket``: ranges of the code's scores with about equally many rows."""
    cuts = sc.groupBy(*by, "code").agg(F.array_sort(F.array_distinct(F.percentile_approx(
        "score", [i / buckets for i in range(1, buckets)], 10 * buckets))).alias("cuts"))
    # one row a class
    return sc.join(F.broadcast(cuts), [*by, "code"]).withColumn(
        "bucket", F.coalesce(range_bucket(F.col("score"), F.col("cuts"), buckets), F.lit(0))).drop("cuts")


def ovr_auc(scored: DataFrame, classes: list, label_col: str = "label",
            prob_col: str = "probability", buckets: int = 4096, by: tuple[str, ...] = ()) -> DataFrame:
    """ME9: exact one-vs-rest ROC AUC per class (ties count 1/2).

    AUC_c = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N).
    Rows are first reduced to (class, score) -> pos, neg (partial aggregation).
    The "negatives below" prefix sum is split in two levels so no class is sorted
    in one task: ``buckets`` ranges of about equally many different scores, whose bounds
    are quantiles of each class's scores, give a small per-class histogram (prefix over
    buckets), and only scores inside one bucket are ordered together. So scores may lie
    anywhere, however close together. Null and NaN scores count as the least and greatest.
    Output: cls, positives, negatives, auc (null when a side is empty), for each value of ``by``.
    """
    spark = scored.sparkSession
    code_of = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    # a label outside the list is negative for every class
    y = F.coalesce(F.try_element_at(code_of, F.col(label_col)), F.lit(-1))
    ex = scored.select(*by, y.alias("__y"), F.posexplode(F.col(prob_col)).alias("code", "score"))
    sc = ex.groupBy(*by, "code", "score").agg(
        F.sum((F.col("__y") == F.col("code")).cast("long")).alias("pos"),
        F.sum((F.col("__y") != F.col("code")).cast("long")).alias("neg"))
    sc = score_buckets(sc, buckets, by)
    hist = sc.groupBy(*by, "code", "bucket").agg(F.sum("neg").alias("bneg"))
    w_b = Window.partitionBy(*by, "code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("neg_before", F.coalesce(F.sum("bneg").over(w_b), F.lit(0))).drop("bneg")
    w_in = Window.partitionBy(*by, "code", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sc = sc.join(hist, [*by, "code", "bucket"], "inner").withColumn(
        "neg_below", F.col("neg_before") + F.coalesce(F.sum("neg").over(w_in), F.lit(0)))
    part = sc.groupBy(*by, "code").agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("num"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    cls = _class_frame(spark, classes)
    if by:  # every class for every value, a row each
        cls = part.select(*by).distinct().withColumn("__all", F.explode(F.array(*[F.struct(
            F.lit(i).alias("code"), F.lit(c).alias("cls")) for i, c in enumerate(classes)]))).select(*by, "__all.*")
    out = cls.join(part, [*by, "code"], "left").select(
        *by, "code", "cls", F.coalesce("positives", F.lit(0)).alias("positives"),
        F.coalesce("negatives", F.lit(0)).alias("negatives"), "num")
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 F.col("num") / (F.col("positives").cast("double") * F.col("negatives")))
    return out.select(*by, "code", "cls", "positives", "negatives", auc.alias("auc"))


def weighted_auc(per_class: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ME10: prevalence-weighted mean of the per-class AUCs."""
    return per_class.groupBy(*by).agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives"))
                         .alias("weighted_auc"))


def cv_summary(fold_scores: DataFrame, group_cols: list[str] | None = None,
               score_col: str = "score") -> DataFrame:
    """ME11: mean and population std of fold scores."""
    g = fold_scores.groupBy(*(group_cols or []))
    return g.agg(F.avg(score_col).alias("cv_mean"), F.stddev_pop(score_col).alias("cv_std"))


def model_metrics(model_name: str, scored: DataFrame, classes: list,
                  label_col: str = "label", pred_col: str = "prediction",
                  prob_col: str | None = "probability", cv: DataFrame | None = None) -> DataFrame:
    """ME12: one metrics row per model (scored frame -> 1 row)."""
    counts = confusion_counts(scored, label_col, pred_col)
    row = label_metrics(counts)
    if prob_col:
        row = _join1(row, weighted_auc(ovr_auc(scored, classes, label_col, prob_col)))
    else:
        row = row.withColumn("weighted_auc", F.lit(None).cast("double"))
    if cv is not None:
        row = _join1(row, cv.select("cv_mean", "cv_std"))
    else:
        row = row.withColumn("cv_mean", F.lit(None).cast("double")).withColumn(
            "cv_std", F.lit(None).cast("double"))
    return row.select(F.lit(model_name).alias("model"), "macro_f1", "accuracy",
                      "balanced_accuracy", "mcc", "macro_precision", "weighted_precision",
                      "weighted_auc", "cv_mean", "cv_std")


def models_metrics(scored: DataFrame, classes: list, model_col: str = "model", label_col: str = "label",
                   pred_col: str = "prediction", prob_col: str = "probability") -> DataFrame:
    """ME12 of many models in one pass: ``scored`` has a row for each row and model; one metrics row a model."""
    by = ("model",)
    rows = scored.withColumnRenamed(model_col, "model")
    counts = rows.groupBy("model", F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    auc = weighted_auc(ovr_auc(rows, classes, label_col, prob_col, by=by), by)
    out = label_metrics(counts, by).join(F.broadcast(auc), "model", "left")  # one row a model
    none = F.lit(None).cast("double")
    return out.select("model", "macro_f1", "accuracy", "balanced_accuracy", "mcc", "macro_precision", "weighted_precision",
                      "weighted_auc", none.alias("cv_mean"), none.alias("cv_std"))


def _join1(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row frames (keyed on a constant, not a cross product)."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def compare_models(rows: list[DataFrame] | DataFrame) -> DataFrame:
    """ME13: rank by macro F1, balanced accuracy, weighted AUC (desc; name breaks ties)."""
    df = rows if isinstance(rows, DataFrame) else reduce(DataFrame.unionByName, rows)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("macro_f1"),
                                             F.desc_nulls_last("balanced_accuracy"),
                                             F.desc_nulls_last("weighted_auc"), F.asc("model"))
    return df.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)
