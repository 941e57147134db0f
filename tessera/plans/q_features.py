"""Registered queries: sampling (SM2-SM4) and feature encoding (FE1-FE8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import sampling as SM
from tessera.operators.smotenc import balance_guard
from tessera.plans.q_core import op, op_split
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE, split_ctes

QUERIES: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


S = ORDER_SPEC
W = f"WITH {OP_CTE}"
WS = f"WITH {OP_CTE},{split_ctes()}"
H = "md5(concat_ws('|', CAST(row_id AS VARCHAR), '{seed}'))"

# SM2 -----------------------------------------------------------------------
reg("sm2_sample_rows", f"{W} SELECT row_id, stage FROM order_profile ORDER BY {H.format(seed=42)}, row_id LIMIT 500")(
    lambda spark, sf: SM.sample_rows(op(spark, sf), 500, "row_id", 42).select("row_id", "stage"))

# SM3 -----------------------------------------------------------------------
reg("sm3_group_sample", f"""{W}, c AS (SELECT stage, COUNT(*) AS n FROM order_profile GROUP BY stage),
q AS (SELECT stage, LEAST(n, GREATEST(1, CAST(round_even(n * (CAST(12000 AS DOUBLE) / SUM(n) OVER ()), 0) AS BIGINT))) AS quota,
             SUM(n) OVER () > 12000 AS over_ FROM c),
r AS (SELECT o.row_id, o.stage, ROW_NUMBER() OVER (PARTITION BY o.stage ORDER BY {H.format(seed=42)}, row_id) AS rk
      FROM order_profile o),
k AS (SELECT r.row_id, r.stage, q.over_ AS sampled FROM r JOIN q USING (stage) WHERE NOT q.over_ OR rk <= quota)
SELECT row_id, stage, sampled FROM k ORDER BY {H.format(seed=43)}, row_id LIMIT 12000""")(
    lambda spark, sf: SM.proportional_group_sample(op(spark, sf).select("row_id", "stage"), "stage", "row_id",
                                                   12000, 42))

# SM4 -----------------------------------------------------------------------
reg("sm4_stratified_folds", f"""{W} SELECT row_id, stage,
CAST((ROW_NUMBER() OVER (PARTITION BY stage ORDER BY {H.format(seed=42)}, row_id) - 1) % 5 AS INTEGER) AS fold FROM order_profile""")(
    lambda spark, sf: SM.stratified_folds(op(spark, sf).select("row_id", "stage"), "stage", "row_id", 5, 42))

reg("sm4_fold_counts", f"""{W}, f AS (SELECT stage, (ROW_NUMBER() OVER (PARTITION BY stage ORDER BY {H.format(seed=42)}, row_id) - 1) % 5 AS fold
FROM order_profile) SELECT stage, CAST(fold AS INTEGER) AS fold, COUNT(*) AS n FROM f GROUP BY 1, 2""")(
    lambda spark, sf: SM.stratified_folds(op(spark, sf), "stage", "row_id", 5, 42)
    .groupBy("stage", "fold").agg(F.count(F.lit(1)).alias("n")))


# FE1 / FE2 -----------------------------------------------------------------
def _fit(spark, sf):
    tr = op_split(spark, sf).where(F.col("split") == "train")
    return FE.fit_preprocessor(tr, S)


def _fe1(spark, sf):
    pre = _fit(spark, sf)
    df = FE.encode_labels(op(spark, sf).select("row_id", "stage"), "stage", pre.classes, "label", strict=True)
    return FE.decode_labels(df, "label", pre.classes, "decoded")


reg("fe1_fe2_target_codes", f"""{WS}, cls AS (SELECT stage, CAST(DENSE_RANK() OVER (ORDER BY stage) - 1 AS DOUBLE) AS label
FROM (SELECT DISTINCT stage FROM split WHERE split = 'train') d)
SELECT o.row_id, o.stage, cls.label, cls.stage AS decoded FROM order_profile o JOIN cls USING (stage)""")(_fe1)


# FE3 / FE4 -----------------------------------------------------------------
def _enc_sql_cols():
    parts = []
    for c, lv in S.ordinal:
        whens = " ".join(f"WHEN {c} = '{v}' THEN {float(i)}" for i, v in enumerate(lv))
        parts.append(f"CASE WHEN {c} IS NULL THEN NULL {whens} ELSE -1.0 END AS {c}")
    for c in S.nominal:
        parts.append(f"(SELECT CAST(COUNT(DISTINCT t.{c}) AS DOUBLE) FROM split t WHERE t.split = 'train' AND t.{c} < o.{c}) AS {c}")
    return ", ".join(parts)


def _fe34(spark, sf):
    pre = _fit(spark, sf)
    cols = ["row_id", *S.ordinal_cols, *S.nominal]
    return pre.encode(op(spark, sf).select(*cols), strict=True, label=False)


reg("fe3_fe4_categorical_codes", f"""{WS} SELECT o.row_id, {_enc_sql_cols()} FROM order_profile o""")(_fe34)


# FE5 -----------------------------------------------------------------------
def _encoded_sql(src: str) -> str:
    cols = [f"CAST({c} AS DOUBLE) AS {c}" for c in S.numeric + S.binary]
    return f"SELECT o.row_id, o.stage, {', '.join(cols)}, {_enc_sql_cols()} FROM {src} o"


def _fe5(spark, sf):
    pre = _fit(spark, sf)
    enc = pre.encode(op(spark, sf).select("row_id", *S.features), strict=True, label=False)
    return pre.scale(enc)


_stats = ", ".join(f"AVG({c}) AS m_{c}, COALESCE(STDDEV_POP({c}), 0) AS s_{c}" for c in S.features)
_scaled = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in S.features)
reg("fe5_standardised", f"""{WS}, enc AS ({_encoded_sql('order_profile')}),
tr AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'train'),
st AS (SELECT {_stats} FROM tr)
SELECT row_id, {_scaled} FROM enc CROSS JOIN st""")(_fe5)


# FE7 -----------------------------------------------------------------------
def _fe7(spark, sf):
    pre = _fit(spark, sf)
    rows = [(c, float(pre.fill[c])) for c in S.features]
    return spark.createDataFrame(rows, "column_name string, fill_value double")


_fill_union = " UNION ALL ".join(
    (f"SELECT '{c}' AS column_name, AVG({c}) AS fill_value FROM tr" if c in S.numeric else
     f"SELECT '{c}', (SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)")
    for c in S.features)
reg("fe7_fill_values", f"""{WS}, enc AS ({_encoded_sql('order_profile')}),
tr AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'train')
{_fill_union}""")(_fe7)


# FE8 -----------------------------------------------------------------------
def _fe8(spark, sf):
    pre = _fit(spark, sf)
    raw = op_split(spark, sf).where(F.col("split") == "test").select("row_id", *S.features)
    out = FE.scoring_features(raw, pre)
    return out.select("row_id", F.concat_ws(",", "missing_columns").alias("missing_columns"),
                      *S.features, *[c + "_scaled" for c in S.features])


_fill_cols = ", ".join(
    (f"AVG({c}) AS f_{c}" if c in S.numeric else
     f"(SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS f_{c}")
    for c in S.features)
_missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in S.features) + ")"
_imputed = ", ".join(f"COALESCE({c}, f_{c}) AS {c}" for c in S.features)
_scaled2 = ", ".join(f"(COALESCE({c}, f_{c}) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}_scaled"
                     for c in S.features)
reg("fe8_scoring_features", f"""{WS}, enc AS ({_encoded_sql('order_profile')}),
tr AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'train'),
st AS (SELECT {_stats} FROM tr), fl AS (SELECT {_fill_cols} FROM tr),
te AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'test')
SELECT row_id, {_missing} AS missing_columns, {_imputed}, {_scaled2} FROM te CROSS JOIN st CROSS JOIN fl""")(_fe8)


# SM5 / JN5 -------------------------------------------------------------------
def balanced_train(spark, sf):
    """Encoded, imputed train split oversampled with SMOTE-NC."""
    from tessera.operators.smotenc import smotenc
    tr = op_split(spark, sf).where(F.col("split") == "train")
    pre = FE.fit_preprocessor(tr, S)
    enc = pre.impute(pre.encode(tr.select("row_id", "stage", *S.features), strict=True, label=False),
                     missing_col=None)
    return smotenc(enc, "stage", "row_id", list(S.numeric), list(S.categorical), k_max=5, seed=42)


def _sm5_sql() -> str:
    cont, cat = list(S.numeric), list(S.categorical)
    imputed = ", ".join(f"COALESCE({c}, (SELECT AVG({c}) FROM tr0)) AS {c}" for c in S.features)
    d2 = None
    for c in cont:
        t = f"((a.{c} - b.{c}) * (a.{c} - b.{c}))"
        d2 = t if d2 is None else f"({d2} + {t})"
    for c in cat:
        t = f"(CASE WHEN a.{c} <> b.{c} THEN (SELECT med2 FROM md) ELSE 0.0 END)"
        d2 = f"({d2} + {t})"
    hx = "CAST('0x' || substr(md5(concat_ws('|', stage, CAST(j AS VARCHAR), '{s}')), 1, {n}) AS BIGINT)"
    modes = ", ".join(
        f"(SELECT {c} FROM nn n2 WHERE n2.q_id = p.q_id AND n2.stage = p.stage GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}"
        for c in cat)
    return f"""{WS}, enc AS ({_encoded_sql('order_profile')}),
tr0 AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'train'),
tr AS (SELECT row_id, stage, {imputed} FROM tr0),
ccnt AS (SELECT stage, COUNT(*) AS n FROM tr GROUP BY stage),
prm AS (SELECT MAX(n) AS nmax, LEAST(5, MIN(n) - 1) AS kk, arg_min(stage, n * 1000000 + 0) AS smallest FROM ccnt),
sm AS (SELECT stage FROM ccnt ORDER BY n, stage LIMIT 1),
sds AS ({" UNION ALL ".join(f"SELECT STDDEV_POP({c}) AS sd FROM tr WHERE stage = (SELECT stage FROM sm)" for c in cont)}),
md AS (SELECT quantile_cont(COALESCE(sd, 0.0), 0.5) * quantile_cont(COALESCE(sd, 0.0), 0.5) AS med2 FROM sds),
rk AS (SELECT tr.*, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42')), row_id) AS rank FROM tr),
bases AS (SELECT stage, COALESCE(SUM((SELECT nmax FROM prm) - n) OVER (ORDER BY n, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ccnt),
gen AS (SELECT stage, n, UNNEST(generate_series(0, (SELECT nmax FROM prm) - n - 1)) AS j FROM ccnt WHERE n < (SELECT nmax FROM prm)),
gen2 AS (SELECT stage, j, ({hx.format(s='42s', n=15)} % n) + 1 AS rank,
                ({hx.format(s='42n', n=15)} % (SELECT kk FROM prm)) + 1 AS nn_rank,
                CAST({hx.format(s='42u', n=13)} AS DOUBLE) / {float(16 ** 13)!r} AS u FROM gen),
seeds AS (SELECT g.stage, g.j, g.nn_rank, g.u, r.row_id AS q_id, {", ".join(f"r.{c}" for c in cont)} FROM gen2 g JOIN rk r USING (stage, rank)),
qd AS (SELECT DISTINCT stage, q_id FROM seeds),
pairs AS (SELECT q.stage, q.q_id, b.row_id AS b_id, {d2} AS d2, {", ".join(f"b.{c}" for c in S.features)}
          FROM qd q JOIN tr a ON a.row_id = q.q_id AND a.stage = q.stage JOIN tr b ON b.stage = q.stage AND b.row_id <> q.q_id),
nn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stage, q_id ORDER BY d2, b_id) AS nn_rank FROM pairs) x
       WHERE nn_rank <= (SELECT kk FROM prm)),
p AS (SELECT DISTINCT stage, q_id FROM nn),
mo AS (SELECT p.stage, p.q_id, {modes} FROM p),
syn AS (SELECT s.stage, CAST(-(bases.base + s.j + 1) AS BIGINT) AS row_id, {", ".join(f"s.{c} + s.u * (n.{c} - s.{c}) AS {c}" for c in cont)},
               {", ".join(f"CAST(mo.{c} AS DOUBLE) AS {c}" for c in cat)}, true AS synthetic
        FROM seeds s JOIN bases ON bases.stage = s.stage JOIN nn n ON n.stage = s.stage AND n.q_id = s.q_id AND n.nn_rank = s.nn_rank
        JOIN mo ON mo.stage = s.stage AND mo.q_id = s.q_id)
SELECT stage, row_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in S.features)}, false AS synthetic FROM tr
UNION ALL SELECT stage, row_id, {", ".join(S.features)}, synthetic FROM syn"""


reg("sm5_jn5_smotenc", _sm5_sql())(balanced_train)

reg("sm5_class_counts", _sm5_sql().replace("UNION ALL SELECT stage, row_id,", "UNION ALL SELECT stage, row_id,")
    .rsplit("SELECT stage, row_id, ", 2)[0] + f"""SELECT stage, synthetic, COUNT(*) AS n FROM (
SELECT stage, false AS synthetic FROM tr UNION ALL SELECT stage, synthetic FROM syn) u GROUP BY 1, 2""")(
    lambda spark, sf: balanced_train(spark, sf).groupBy("stage", "synthetic").agg(F.count(F.lit(1)).alias("n")))


# AG18 -------------------------------------------------------------------------
reg("ag18_min_class_count_guard", f"""{WS} SELECT MIN(n) AS min_class_count, MIN(n) >= 2 AS balancing_possible
FROM (SELECT stage, COUNT(*) AS n FROM split WHERE split = 'train' GROUP BY stage) c""")(
    lambda spark, sf: spark.createDataFrame(
        [balance_guard(op_split(spark, sf).where(F.col("split") == "train"), "stage")],
        "min_class_count long, balancing_possible boolean"))
