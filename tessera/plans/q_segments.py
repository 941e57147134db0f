"""Registered queries: segmentation (ML6, AG16, AG17, WN1, WN2, SG1-SG3, SG5, SG7, ME14)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantiles
from tessera.operators import kmeans as KM
from tessera.operators import segments as SG
from tessera.operators.blocks import packed
from tessera.plans.order_rules import ORDER_RULES, ORDER_SEGMENT_COLORS, ORDER_SEGMENT_LABELS, ORDER_SEGMENTS
from tessera.plans.q_core import op_split
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE, split_ctes
from tessera.sources.tables import read_table

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
PROF = [c for c, _ in S.profile]
Z = [f"z_{c}" for c in PROF]
K = 3


def clustered(spark, sf):
    """Train split scaled on its own population stats, 1 Lloyd step from the 3
    lowest row ids; returns (train assigned, test assigned, centroids, stats)."""
    sp = op_split(spark, sf).select("row_id", "split", *PROF).cache()
    tr = sp.where(F.col("split") == "train")
    st = tr.agg(*[F.avg(c).alias(f"m_{c}") for c in PROF],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in PROF]).first()

    def zf(df):
        return df.select("row_id", *PROF, *[((F.col(c) - F.lit(float(st[f"m_{c}"]))) /
                                               F.lit(float(st[f"s_{c}"] or 1.0))).alias(f"z_{c}") for c in PROF])
    ztr = zf(tr)
    init = SG.first_rows_as_centroids(ztr, Z, "row_id", K)
    cents, a_tr = SG.lloyd(ztr, Z, init, steps=1)
    a_te = SG.assign_clusters(zf(sp.where(F.col("split") == "test")), Z, cents)
    return a_tr, a_te, cents


def _argmin_sql(cent: str) -> str:
    ds = []
    for j in range(K):
        terms = [f"((z_{c} - (SELECT z_{c} FROM {cent} WHERE cl = {j})) * (z_{c} - (SELECT z_{c} FROM {cent} WHERE cl = {j})))"
                 for c in PROF]
        d = terms[0]
        for t in terms[1:]:
            d = f"({d} + {t})"
        ds.append(d)
    conds = []
    for j in range(K - 1):
        cond = " AND ".join(f"d{j} <= d{i}" for i in range(j + 1, K))
        conds.append(f"WHEN {cond} THEN {j}")
    case = f"CASE {' '.join(conds)} ELSE {K - 1} END"
    return ", ".join(f"{d} AS d{j}" for j, d in enumerate(ds)), case


_d_init, _case = _argmin_sql("init")
_d_c1, _ = _argmin_sql("c1")
_stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in PROF)
_zcols = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS z_{c}" for c in PROF)
_zlist = ", ".join(Z)
CLUSTER_SQL = f"""WITH {OP_CTE},{split_ctes()},
tr0 AS (SELECT row_id, {", ".join(PROF)} FROM split WHERE split = 'train'),
te0 AS (SELECT row_id, {", ".join(PROF)} FROM split WHERE split = 'test'),
st AS (SELECT {_stats} FROM tr0),
ztr AS (SELECT row_id, {", ".join(PROF)}, {_zcols} FROM tr0 CROSS JOIN st),
zte AS (SELECT row_id, {", ".join(PROF)}, {_zcols} FROM te0 CROSS JOIN st),
init AS (SELECT ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS cl, {_zlist} FROM (SELECT * FROM ztr ORDER BY row_id LIMIT {K}) f),
a0d AS (SELECT ztr.*, {_d_init} FROM ztr),
a0 AS (SELECT *, {_case} AS cluster FROM a0d),
c1n AS (SELECT cluster AS cl, {", ".join(f"AVG(z_{c}) AS z_{c}" for c in PROF)} FROM a0 GROUP BY cluster),
c1 AS (SELECT i.cl, {", ".join(f"COALESCE(n.z_{c}, i.z_{c}) AS z_{c}" for c in PROF)} FROM init i LEFT JOIN c1n n USING (cl)),
a1d AS (SELECT ztr.*, {_d_c1} FROM ztr),
assigned AS (SELECT row_id, {", ".join(PROF)}, {_zlist}, {_case} AS cluster FROM a1d),
t1d AS (SELECT zte.*, {_d_c1} FROM zte),
assigned_test AS (SELECT row_id, {", ".join(PROF)}, {_zlist}, {_case} AS cluster FROM t1d),
prof AS (SELECT cluster, {", ".join(f"round_even(AVG({c}) * 100.0, 0) / 100.0 AS {c}" for c in PROF)},
                COUNT(*) AS cluster_size FROM assigned GROUP BY cluster)"""


def profiles(spark, sf):
    a_tr, _, _ = clustered(spark, sf)
    return SG.cluster_profiles(a_tr, PROF)


reg("ml6_kmeans_assign", CLUSTER_SQL + " SELECT row_id, cluster FROM assigned")(
    lambda spark, sf: clustered(spark, sf)[0].select("row_id", "cluster"))

_cent_unp = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, AVG(z_{c}) AS value FROM assigned GROUP BY cluster"
                               for c in PROF)
reg("ml6_centroids", CLUSTER_SQL + " " + _cent_unp)(
    lambda spark, sf: clustered(spark, sf)[0].groupBy("cluster").agg(*[F.avg(f"z_{c}").alias(c) for c in PROF])
    .unpivot("cluster", PROF, "feature", "value"))

reg("sg7_assign_new_rows", CLUSTER_SQL + " SELECT row_id, cluster FROM assigned_test")(
    lambda spark, sf: clustered(spark, sf)[1].select("row_id", "cluster"))

reg("ag16_cluster_profiles", CLUSTER_SQL + " SELECT * FROM prof")(profiles)

reg("ag17_cluster_shares", CLUSTER_SQL + """ SELECT cluster, COUNT(*) AS cluster_size,
CAST(CAST(FLOOR((2000 * COUNT(*) + SUM(COUNT(*)) OVER ()) / (2 * SUM(COUNT(*)) OVER ())) AS DECIMAL(20,0)) / 10 AS DECIMAL(20,1)) AS percent
FROM assigned GROUP BY cluster""")(lambda spark, sf: SG.cluster_shares(clustered(spark, sf)[0]))

_h_ranks = ", ".join(f"DENSE_RANK() OVER (ORDER BY {c} {'DESC' if hib else 'ASC'}) AS h_{c}" for c, hib in S.profile)
reg("wn1_dense_ranks", CLUSTER_SQL + f" SELECT cluster, {_h_ranks} FROM prof")(
    lambda spark, sf: SG.dense_ranks(profiles(spark, sf), list(S.profile), "cluster", "h_")
    .select("cluster", *[f"h_{c}" for c in PROF]))

_hsum = " + ".join(f"h_{c}" for c in PROF)
_risk = PROF[-2:]
SEG_SQL = CLUSTER_SQL + f""",
r1 AS (SELECT cluster, {_h_ranks} FROM prof),
r1s AS (SELECT cluster, {_hsum} AS health_rank_sum FROM r1),
b1 AS (SELECT cluster FROM r1s ORDER BY health_rank_sum, cluster LIMIT 1),
rest AS (SELECT * FROM prof WHERE cluster NOT IN (SELECT cluster FROM b1)),
r2 AS (SELECT cluster, {" + ".join(f"DENSE_RANK() OVER (ORDER BY {c} DESC)" for c in _risk)} AS risk_rank_sum FROM rest),
b2 AS (SELECT cluster FROM r2 ORDER BY risk_rank_sum, cluster LIMIT 1),
keys AS (SELECT r1s.cluster, CASE WHEN r1s.cluster IN (SELECT cluster FROM b1) THEN '{ORDER_SEGMENTS[0]}'
                  WHEN r1s.cluster IN (SELECT cluster FROM b2) THEN '{ORDER_SEGMENTS[1]}' ELSE '{ORDER_SEGMENTS[2]}' END AS segment_key,
                r1s.health_rank_sum, COALESCE(r2.risk_rank_sum, 0) AS risk_rank_sum
         FROM r1s LEFT JOIN r2 USING (cluster))"""


def keys(spark, sf):
    return SG.segment_keys(profiles(spark, sf), list(S.profile), ORDER_SEGMENTS)


def display(spark, sf):
    return SG.segment_display(keys(spark, sf), ORDER_SEGMENT_LABELS, ORDER_SEGMENT_COLORS)


reg("wn2_sg1_segment_keys", SEG_SQL + " SELECT * FROM keys")(keys)

_names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_SEGMENT_LABELS.items())
_colors = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_SEGMENT_COLORS.items())
DISPLAY_SQL = SEG_SQL + f""",
disp AS (SELECT cluster, segment_key, COALESCE(CASE segment_key {_names} END, 'Cluster ' || CAST(cluster AS VARCHAR)) AS cluster_name,
                COALESCE(CASE segment_key {_colors} END, '{ORDER_SEGMENT_COLORS['unknown']}') AS color FROM keys)"""
reg("sg2_segment_display", DISPLAY_SQL + " SELECT * FROM disp")(
    lambda spark, sf: display(spark, sf))

reg("sg3_segment_sizes", DISPLAY_SQL + """ SELECT p.cluster, p.cluster_size,
CAST(CAST(FLOOR((2000 * p.cluster_size + SUM(p.cluster_size) OVER ()) / (2 * SUM(p.cluster_size) OVER ())) AS DECIMAL(20,0)) / 10 AS DECIMAL(20,1)) AS percent,
d.cluster_name FROM prof p JOIN disp d USING (cluster)""")(
    lambda spark, sf: SG.cluster_shares(clustered(spark, sf)[0]).join(
        display(spark, sf).select("cluster", "cluster_name"), "cluster"))


def _positions(spark, sf):
    a_tr, _, _ = clustered(spark, sf)
    prof = SG.cluster_profiles(a_tr, PROF)
    med = exact_quantiles(a_tr.unpivot("row_id", PROF, "feature", "v"), "v", [0.5], ["feature"]) \
        .select("feature", F.col("value").alias("baseline"))
    long = prof.unpivot(["cluster", "cluster_size"], PROF, "feature", "value")
    j = long.join(med, "feature")
    return j.select("cluster", "feature", "value", "baseline",
                    SG.describe_position(F.col("value"), F.col("baseline")).alias("position"))


_prof_long = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, {c} AS value FROM prof" for c in PROF)
_med = " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS baseline FROM assigned" for c in PROF)
reg("sg5_positions", CLUSTER_SQL + f""", pl AS ({_prof_long}), md AS ({_med})
SELECT cluster, feature, value, baseline,
  CASE WHEN value IS NULL OR baseline IS NULL OR isnan(value) OR isnan(baseline) THEN 'relative position not available'
       WHEN abs(value - baseline) <= 1e-8 + 1e-5 * abs(baseline) THEN 'around the training median'
       WHEN value > baseline THEN 'above the training median' ELSE 'below the training median' END AS position
FROM pl JOIN md USING (feature)""")(_positions)


# ME14 ----------------------------------------------------------------------
def _emb(spark, sf):
    e = read_table(spark, sf, "embeddings")
    n = e.select(F.max(F.size("embedding"))).first()[0]
    return e.select("vec_id", F.col("label").alias("cluster"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]), \
        [f"e{i}" for i in range(n)]


def _me14(spark, sf):
    e, feats = _emb(spark, sf)
    s = SG.silhouette_sq(e, feats, "cluster")
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("mean_silhouette"))


reg("me14_silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb,
             list_sum(list_transform(generate_series(1, len(a.v)), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, la, lb, AVG(d) AS md FROM p GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, la, MAX(CASE WHEN la = lb THEN md END) AS a, MIN(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY 1, 2),
sz AS (SELECT label, COUNT(*) AS n FROM e GROUP BY label),
s AS (SELECT e.vec_id, e.label, CASE WHEN sz.n <= 1 THEN 0.0 ELSE (ab.b - ab.a) / GREATEST(ab.a, ab.b) END AS silhouette
      FROM e JOIN sz USING (label) LEFT JOIN ab ON ab.vec_id = e.vec_id)
SELECT label AS cluster, COUNT(*) AS n, AVG(silhouette) AS mean_silhouette FROM s GROUP BY label""")(_me14)


# SG6 ------------------------------------------------------------------------
MEANING_INTRO = "Orders of this kind were grouped by their five main figures."
MEANING_SIZE = "The group has {n} orders of the training part."
MEANING_LABELS = [("acct_bal", "Mean balance:", "", 2), ("disc_sum", "Mean discounts:", "", 2), ("tax_sum", "Mean taxes:", "", 2),
                  ("total_price", "Mean total:", "", 2), ("price_max", "Mean dearest line:", "", 2)]


def _sg6(spark, sf):
    a_tr, _, _ = clustered(spark, sf)
    q = exact_quantiles(a_tr.unpivot("row_id", PROF, "feature", "v"), "v", [0.5], ["feature"]).collect()
    med = {r["feature"]: float(r["value"]) for r in q}
    m = SG.cluster_meaning(SG.cluster_profiles(a_tr, PROF), keys(spark, sf), med, MEANING_LABELS,
                           ORDER_RULES.segment_summaries, ORDER_RULES.segment_summary_default,
                           MEANING_INTRO, MEANING_SIZE)
    return m.select("cluster", "summary", F.array_join("details", " | ").alias("details"))


def _sg6_sql():
    summ = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_RULES.segment_summaries.items())
    pos = ("CASE WHEN {v} IS NULL OR {b} IS NULL OR isnan({v}) OR isnan({b}) THEN 'relative position not available' "
           "WHEN abs({v} - {b}) <= 1e-8 + 1e-5 * abs({b}) THEN 'around the training median' "
           "WHEN {v} > {b} THEN 'above the training median' ELSE 'below the training median' END")
    parts = [f"'{MEANING_INTRO}'",
             "'" + MEANING_SIZE.split("{n}")[0] + "' || format('{:,}', p.cluster_size) || '" + MEANING_SIZE.split("{n}")[1] + "'"]
    for c, prefix, unit, d in MEANING_LABELS:
        b = f"(SELECT quantile_cont({c}, 0.5) FROM assigned)"
        parts.append(f"'{prefix} ' || printf('%.{d}f', p.{c}) || '{unit}, which is ' || {pos.format(v='p.' + c, b=b)} "
                     f"|| ' compared with the training median of ' || printf('%.{d}f', {b}) || '.'")
    return (SEG_SQL + f" SELECT p.cluster, COALESCE(CASE k.segment_key {summ} END, '{ORDER_RULES.segment_summary_default}') AS summary, "
            f"array_to_string([{', '.join(parts)}], ' | ') AS details FROM prof p LEFT JOIN keys k USING (cluster)")


reg("sg6_cluster_meaning", _sg6_sql())(_sg6)


# ML5: one step of ten restarts at once ----------------------------------------
RESTARTS = 10


def _kmeans_step(spark, sf):
    """Ten restarts from the first 30 rows, three each: centroids after a step, rows of each and the cost before."""
    ztr = clustered(spark, sf)[0].select("row_id", *Z)
    rows = np.array(SG.first_rows_as_centroids(ztr, Z, "row_id", RESTARTS * K))
    blocks = packed(ztr, Z, F.lit(0), F.col("row_id"), None)
    new, n, cost = KM.step(blocks, len(Z), rows.reshape(RESTARTS, K, len(Z)))
    out = [(r, c, f, float(new[r, c, i]), int(n[r, c]), float(cost[r])) for r in range(RESTARTS) for c in range(K) for i, f in enumerate(PROF)]
    return spark.createDataFrame(out, "restart int, cluster int, feature string, value double, n long, cost double")


_step_d = " + ".join(f"(ztr.z_{c} - s.z_{c}) * (ztr.z_{c} - s.z_{c})" for c in PROF)
_step_out = " UNION ALL ".join(
    f"SELECT restart, cl AS cluster, '{c}' AS feature, COALESCE(a_{c}, z_{c}) AS value, COALESCE(n, 0) AS n, cost FROM both_" for c in PROF)
reg("ml5_kmeans_step", CLUSTER_SQL + f""",
starts AS (SELECT CAST((rn - 1) // {K} AS INTEGER) AS restart, CAST((rn - 1) % {K} AS INTEGER) AS cl, {", ".join(Z)} FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY row_id) AS rn FROM ztr) f WHERE rn <= {RESTARTS * K}),
dist AS (SELECT ztr.*, restart, cl, {_step_d} AS d FROM ztr CROSS JOIN starts s),
near AS (SELECT * FROM dist QUALIFY ROW_NUMBER() OVER (PARTITION BY restart, row_id ORDER BY d, cl) = 1),
mean AS (SELECT restart, cl, COUNT(*) AS n, {", ".join(f"AVG(z_{c}) AS a_{c}" for c in PROF)} FROM near GROUP BY restart, cl),
costs AS (SELECT restart, SUM(d) AS cost FROM near GROUP BY restart),
both_ AS (SELECT s.*, mean.* EXCLUDE (restart, cl), cost FROM starts s LEFT JOIN mean USING (restart, cl) JOIN costs USING (restart))
{_step_out}""")(_kmeans_step)


# FE9: two columns, whose components have a closed form ------------------------
PCA_COLS = ["disc_sum", "tax_sum"]


def _pca(spark, sf):
    """Loadings and explained share of both components of two columns of the train split."""
    tr = op_split(spark, sf).where(F.col("split") == "train")
    comps, ratio, _ = SG.fit_pca(tr, PCA_COLS, 2)
    rows = [(i, float(c[0]), float(c[1]), float(r)) for i, (c, r) in enumerate(zip(comps, ratio))]
    return spark.createDataFrame(rows, "component int, loading_a double, loading_b double, explained double")


reg("fe9_pca_two_columns", f"""WITH {OP_CTE},{split_ctes()},
m AS (SELECT var_samp({PCA_COLS[0]}) AS a, covar_samp({PCA_COLS[0]}, {PCA_COLS[1]}) AS b, var_samp({PCA_COLS[1]}) AS c
      FROM split WHERE split = 'train'),
e AS (SELECT 0 AS component, a, b, c, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l FROM m
      UNION ALL SELECT 1, a, b, c, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 FROM m),
v AS (SELECT component, b / sqrt(b * b + (l - a) * (l - a)) AS x, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS y, l / (a + c) AS explained FROM e)
SELECT component, CASE WHEN greatest(abs(x), abs(y)) = abs(x) THEN sign(x) ELSE sign(y) END * x AS loading_a,
       CASE WHEN greatest(abs(x), abs(y)) = abs(x) THEN sign(x) ELSE sign(y) END * y AS loading_b, explained FROM v""")(_pca)
