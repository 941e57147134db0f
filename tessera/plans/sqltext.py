"""Shared SQL text for the DuckDB oracles (the Spark side never parses these)."""

from tessera.sources.tables import ORDER_PROFILE_SQL

OP_CTE = f"order_profile AS ({ORDER_PROFILE_SQL})"


def split_ctes(test_size: float = 0.2, seed: int = 42, src: str = "order_profile",
               target: str = "stage", id_col: str = "row_id") -> str:
    """CTEs ending in ``split``: src columns + split ('train'|'test')."""
    return f"""
cnt AS (SELECT {target}, COUNT(*) AS n FROM {src} GROUP BY {target}),
tot AS (SELECT SUM(n) AS nn, CAST(CEIL({test_size} * SUM(n)) AS BIGINT) AS ntest FROM cnt),
q1 AS (SELECT {target}, n, ((nn - ntest) * n) // nn AS fl, ((nn - ntest) * n) % nn AS rem,
              nn - ntest AS ntrain FROM cnt CROSS JOIN tot),
q2 AS (SELECT {target}, n, fl, ntrain - SUM(fl) OVER () AS lft,
              ROW_NUMBER() OVER (ORDER BY rem DESC, {target}) AS rr FROM q1),
quota AS (SELECT {target}, n - fl - CASE WHEN rr <= lft THEN 1 ELSE 0 END AS test_quota FROM q2),
ranked AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY {target}
                  ORDER BY md5(concat_ws('|', CAST({id_col} AS VARCHAR), '{seed}')), {id_col}) AS rk
           FROM {src} s),
split AS (SELECT ranked.* EXCLUDE (rk),
                 CASE WHEN rk <= test_quota THEN 'test' ELSE 'train' END AS split
          FROM ranked JOIN quota USING ({target}))"""


def counts_cte(scored: str = "scored") -> str:
    return f"counts AS (SELECT label AS actual, prediction AS predicted, COUNT(*) AS n FROM {scored} GROUP BY 1, 2)"


def metric_ctes(scored: str = "scored") -> str:
    """CTEs ``counts``, ``stats``, ``pc`` (per-class precision/recall/f1) over ``scored``."""
    return f"""
counts AS (SELECT label AS actual, prediction AS predicted, COUNT(*) AS n FROM {scored} GROUP BY 1, 2),
stats AS (SELECT cls, SUM(tp) AS tp, SUM(t) AS support, SUM(p) AS predicted FROM (
            SELECT actual AS cls, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n AS t, 0 AS p FROM counts
            UNION ALL SELECT predicted, 0, 0, n FROM counts) u GROUP BY cls),
pc AS (SELECT cls, tp, support, predicted,
              CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
              CASE WHEN support + predicted = 0 THEN 0.0
                   ELSE CAST(2 * tp AS DOUBLE) / CAST(support + predicted AS DOUBLE) END AS f1
       FROM stats)"""


LABEL_METRICS_SELECT = """
SELECT C / N AS accuracy, balanced_accuracy, wp / N AS weighted_precision, macro_precision, macro_f1,
       CASE WHEN (N * N - pp) * (N * N - tt) = 0 THEN 0.0
            ELSE (C * N - tpd) / sqrt((N * N - tt) * (N * N - pp)) END AS mcc
FROM (SELECT CAST(SUM(support) AS DOUBLE) AS N, CAST(SUM(tp) AS DOUBLE) AS C,
             AVG(recall) AS balanced_accuracy, AVG(precision) AS macro_precision, AVG(f1) AS macro_f1,
             SUM(precision * support) AS wp,
             CAST(SUM(CAST(support AS HUGEINT) * predicted) AS DOUBLE) AS tpd,
             CAST(SUM(CAST(predicted AS HUGEINT) * predicted) AS DOUBLE) AS pp,
             CAST(SUM(CAST(support AS HUGEINT) * support) AS DOUBLE) AS tt
      FROM pc) a"""


def auc_ctes(scored: str, classes: list[str]) -> str:
    """CTE ``auc`` (code, cls, positives, negatives, auc) by tie-averaged ranks."""
    cls_values = ", ".join(f"({i}, '{c}')" for i, c in enumerate(classes))
    return f"""
cls AS (SELECT * FROM (VALUES {cls_values}) v(code, cls)),
ex AS (SELECT label, generate_subscripts(probability, 1) - 1 AS code, UNNEST(probability) AS score
       FROM {scored}),
exl AS (SELECT ex.code, ex.score, CASE WHEN ex.label = cls.cls THEN 1 ELSE 0 END AS y
        FROM ex JOIN cls ON cls.code = ex.code),
rk AS (SELECT code, y, RANK() OVER (PARTITION BY code ORDER BY score) AS r0,
              COUNT(*) OVER (PARTITION BY code, score) AS tie FROM exl),
agg AS (SELECT code, SUM(y) AS positives, SUM(1 - y) AS negatives,
               SUM(CASE WHEN y = 1 THEN r0 + (tie - 1) / 2.0 ELSE 0 END) AS rsum FROM rk GROUP BY code),
auc AS (SELECT cls.code, cls.cls, COALESCE(positives, 0) AS positives, COALESCE(negatives, 0) AS negatives,
               CASE WHEN positives > 0 AND negatives > 0
                    THEN (rsum - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * negatives) END AS auc
        FROM cls LEFT JOIN agg ON agg.code = cls.code)"""
