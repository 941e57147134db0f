"""Registered queries: minimum slice (class distribution, split, rule models, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import profile as P
from tessera.operators import sampling as S
from tessera.plans.fixtures import RULE_MODELS, STAGES, rule_scored, rule_scored_sql
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import (LABEL_METRICS_SELECT, OP_CTE, auc_ctes, counts_cte, metric_ctes,
                                   split_ctes)
from tessera.sources.tables import order_profile

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


_OP_CACHE: dict = {}


def op(spark: SparkSession, sf: str) -> DataFrame:
    """order_profile, persisted once per session and folder: most queries read it
    in several passes (histogram + rows, fit + transform)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _OP_CACHE:
        _OP_CACHE[key] = order_profile(spark, sf).persist()
    return _OP_CACHE[key]


def op_split(spark: SparkSession, sf: str) -> DataFrame:
    """order_profile + exact stratified split column, persisted like ``op``."""
    key = (spark.sparkContext.applicationId, sf, "split")
    if key not in _OP_CACHE:
        _OP_CACHE[key] = S.stratified_split(op(spark, sf), ORDER_SPEC.target, ORDER_SPEC.id_col,
                                            0.2, 42).persist()
    return _OP_CACHE[key]


def test_scored(spark: SparkSession, sf: str, model: str) -> DataFrame:
    return rule_scored(op_split(spark, sf).where(F.col("split") == "test"), model)


WITH_SPLIT = f"WITH {OP_CTE},{split_ctes()}"


def scored_sql(model: str) -> str:
    return f"{WITH_SPLIT}, scored AS ({rule_scored_sql(model, '(SELECT * FROM split WHERE split = ' + chr(39) + 'test' + chr(39) + ')')})"


# ------------------------------------------------------------------ AG4
register("ag4_class_distribution", f"""
WITH {OP_CTE}, cls AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(STAGES))}) v(code, class_name)),
c AS (SELECT stage AS class_name, COUNT(*) AS cnt FROM order_profile GROUP BY stage),
j AS (SELECT code, cls.class_name, COALESCE(cnt, 0) AS count FROM cls LEFT JOIN c USING (class_name))
SELECT code, class_name, count,
       CAST(CAST(FLOOR((2000 * count + SUM(count) OVER ()) / (2 * SUM(count) OVER ())) AS DECIMAL(20,0)) / 10 AS DECIMAL(20,1)) AS percent
FROM j""")(lambda spark, sf: P.class_distribution(op(spark, sf), "stage", STAGES))


# ------------------------------------------------------------------ SM1
register("sm1_stratified_split", f"{WITH_SPLIT} SELECT row_id, stage, split FROM split")(
    lambda spark, sf: op_split(spark, sf).select("row_id", "stage", "split"))

register("sm1_split_counts", f"{WITH_SPLIT} SELECT stage, split, COUNT(*) AS n FROM split GROUP BY 1, 2")(
    lambda spark, sf: op_split(spark, sf).groupBy("stage", "split").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ ME1
def _me1(spark, sf):
    return M.confusion_matrix_long(M.confusion_counts(test_scored(spark, sf, "price_rule")), STAGES)


register("me1_confusion_matrix", scored_sql("price_rule") + f""",
{counts_cte()},
cls AS (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in STAGES)}) v(c)),
grid AS (SELECT a.c AS actual, p.c AS predicted FROM cls a CROSS JOIN cls p)
SELECT actual, predicted, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN counts USING (actual, predicted)""")(_me1)


def _me1_wide(spark, sf):
    return M.confusion_matrix_wide(M.confusion_counts(test_scored(spark, sf, "price_rule")), STAGES)


register("me1_confusion_wide", scored_sql("price_rule") + f""",
{counts_cte()}
SELECT a.actual, {", ".join(f"CAST(COALESCE(SUM(CASE WHEN predicted = '{c}' THEN n END), 0) AS BIGINT) AS {c}" for c in STAGES)}
FROM (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in STAGES)}) v(actual)) a LEFT JOIN counts USING (actual)
GROUP BY a.actual""")(_me1_wide)


# ------------------------------------------------------------------ ME2-ME7 per model
for _m in RULE_MODELS:
    register(f"me2_7_label_metrics_{_m}", scored_sql(_m) + "," + metric_ctes() + LABEL_METRICS_SELECT)(
        (lambda m: lambda spark, sf: M.label_metrics(M.confusion_counts(test_scored(spark, sf, m))))(_m))


# ------------------------------------------------------------------ ME8
def _me8(spark, sf):
    return M.classification_report(M.confusion_counts(test_scored(spark, sf, "price_rule")), STAGES)


register("me8_classification_report", scored_sql("price_rule") + "," + metric_ctes() + f""",
cls AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(STAGES))}) v(pos, cls)),
r AS (SELECT pos, cls.cls AS label, COALESCE(precision, 0.0) AS precision, COALESCE(recall, 0.0) AS recall,
             COALESCE(f1, 0.0) AS f1_score, CAST(COALESCE(support, 0) AS DOUBLE) AS support,
             CAST(COALESCE(tp, 0) AS DOUBLE) AS tp
      FROM cls LEFT JOIN pc USING (cls)),
t AS (SELECT SUM(support) AS N, SUM(tp) AS C, AVG(precision) AS mp, AVG(recall) AS mr, AVG(f1_score) AS mf,
             SUM(precision * support) AS wp, SUM(recall * support) AS wr, SUM(f1_score * support) AS wf FROM r)
SELECT pos, label, precision, recall, f1_score, support FROM r
UNION ALL SELECT {len(STAGES)}, 'accuracy', C / N, C / N, C / N, N FROM t
UNION ALL SELECT {len(STAGES) + 1}, 'macro avg', mp, mr, mf, N FROM t
UNION ALL SELECT {len(STAGES) + 2}, 'weighted avg', wp / N, wr / N, wf / N, N FROM t""")(_me8)


# ------------------------------------------------------------------ ME9 / ME10
for _m in ("price_rule", "centre_rule"):
    register(f"me9_ovr_auc_{_m}", scored_sql(_m) + "," + auc_ctes("scored", STAGES) +
             " SELECT code, cls, positives, negatives, auc FROM auc")(
        (lambda m: lambda spark, sf: M.ovr_auc(test_scored(spark, sf, m), STAGES))(_m))
    register(f"me10_weighted_auc_{_m}", scored_sql(_m) + "," + auc_ctes("scored", STAGES) +
             " SELECT SUM(auc * positives) / SUM(positives) AS weighted_auc FROM auc")(
        (lambda m: lambda spark, sf: M.weighted_auc(M.ovr_auc(test_scored(spark, sf, m), STAGES)))(_m))


# ------------------------------------------------------------------ ME12 / ME13
def _metric_row_sql(m: str) -> str:
    body = scored_sql(m) + "," + metric_ctes() + "," + auc_ctes("scored", STAGES)
    return (body + f""",
lm AS ({LABEL_METRICS_SELECT}),
wa AS (SELECT SUM(auc * positives) / SUM(positives) AS weighted_auc FROM auc)
SELECT '{m}' AS model, macro_f1, accuracy, balanced_accuracy, mcc, macro_precision, weighted_precision,
       weighted_auc, CAST(NULL AS DOUBLE) AS cv_mean, CAST(NULL AS DOUBLE) AS cv_std
FROM lm CROSS JOIN wa""")


def _me12(model):
    return lambda spark, sf: M.model_metrics(model, test_scored(spark, sf, model), STAGES)


for _m in RULE_MODELS:
    register(f"me12_model_metrics_{_m}", _metric_row_sql(_m))(_me12(_m))


def _me13(spark, sf):
    """One scan: a row for each order and rule model."""
    rows = op_split(spark, sf).where(F.col("split") == "test")
    each = []
    for m in RULE_MODELS:
        rows = rule_scored(rows, m).withColumn(f"of_{m}", F.struct(F.lit(m).alias("model"), "label", "prediction", "probability"))
        each.append(F.col(f"of_{m}"))
    return M.compare_models(M.models_metrics(rows.select(F.explode(F.array(*each)).alias("s")).select("s.*"), STAGES))


def _me13_sql() -> str:
    parts = []
    for m in RULE_MODELS:
        parts.append("(" + _metric_row_sql(m) + ")")
    u = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return (f"SELECT *, ROW_NUMBER() OVER (ORDER BY macro_f1 DESC NULLS LAST, balanced_accuracy DESC NULLS LAST, "
            f"weighted_auc DESC NULLS LAST, model) AS rank, "
            f"ROW_NUMBER() OVER (ORDER BY macro_f1 DESC NULLS LAST, balanced_accuracy DESC NULLS LAST, "
            f"weighted_auc DESC NULLS LAST, model) = 1 AS is_best FROM ({u}) x")


register("me13_compare_models", _me13_sql())(_me13)


# ------------------------------------------------------------------ ME11
def _me11(spark, sf):
    folds = S.stratified_folds(rule_scored(op(spark, sf), "centre_rule"), "stage", "row_id", 5, 42)
    scores = folds.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("score"))
    return M.cv_summary(scores)


register("me11_cv_summary", f"""WITH {OP_CTE}, scored AS ({rule_scored_sql("centre_rule", "order_profile")}),
f AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY stage ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42')), row_id) - 1) % 5 AS fold FROM scored),
s AS (SELECT fold, AVG(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS score FROM f GROUP BY fold)
SELECT AVG(score) AS cv_mean, STDDEV_POP(score) AS cv_std FROM s""")(_me11)
