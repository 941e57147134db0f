"""Registered queries: tree SHAP on a literal 3-split tree over order_profile (SH1-SH14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.ordering import hash_order
from tessera.operators import explain as X
from tessera.operators.treewalk import tree_sums
from tessera.plans.fixtures import STAGES
from tessera.plans.q_core import op
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE

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
FEATS = list(S.numeric)  # total_price, price_sum, price_max, disc_sum, tax_sum, part_size_max, acct_bal
TF = {"total_price": FEATS.index("total_price"), "price_sum": FEATS.index("price_sum"),
      "acct_bal": FEATS.index("acct_bal")}
# The literal trees: fixed splits; leaf values from a rule (fractional parts of
# multiples of sqrt(2)) so that no SHAP value sits on a decimal rounding tie.


def _leaf_values(tree: int, leaf: int, n: int = 5) -> list[float]:
    import math
    return [round((math.sqrt(2.0) * (97 * tree + 11 * leaf + c + 1)) % 1.0, 12) for c in range(n)]


TREES = {
    "tree_a": ({0: (TF["price_sum"], 150000.0, 1, 2), 1: (TF["acct_bal"], 2500.0, 3, 4),
                2: (TF["total_price"], 200000.0, 5, 6)},
               {n: _leaf_values(0, n) for n in (3, 4, 5, 6)}),
    "tree_b": ({0: (TF["total_price"], 180000.0, 1, 2), 1: (TF["price_sum"], 90000.0, 3, 4),
                2: (TF["acct_bal"], 0.0, 5, 6)},
               {n: _leaf_values(1, n) for n in (3, 4, 5, 6)}),
    "tree_c": ({0: (TF["acct_bal"], 5000.0, 1, 2), 1: (TF["price_sum"], 200000.0, 3, 4),
                2: (TF["price_sum"], 60000.0, 5, 6)},
               {n: _leaf_values(2, n) for n in (3, 4, 5, 6)}),
}
N_EVAL, N_BG = 1000, 500


def model(name="tree_a"):
    sp, lv = TREES[name]
    return X.literal_tree(sp, lv, len(STAGES))


def rows_and_background(spark, sf):
    d = op(spark, sf).select("row_id", *FEATS)
    ev = d.withColumn("__h", hash_order("row_id", 7)).orderBy("__h", "row_id").limit(N_EVAL).drop("__h")
    bg = d.withColumn("__h", hash_order("row_id", 42)).orderBy("__h", "row_id").limit(N_BG).drop("__h")
    return ev, bg


def shap(spark, sf, name="tree_a"):
    ev, bg = rows_and_background(spark, sf)
    return X.tree_shap(ev, bg, FEATS, model(name), "row_id")


def predictions(spark, sf, name="tree_a"):
    ev, _ = rows_and_background(spark, sf)
    fx = X.model_output(ev, FEATS, model(name), "row_id")
    from pyspark.sql import Window
    w = Window.partitionBy("row_id").orderBy(F.desc("fx"), F.asc("class"))
    return fx.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).select(
        "row_id", F.col("class").alias("prediction"))


# ---------------------------------------------------------------- oracle text
def _f_sql(name, cls, side=None):
    """Tree output for a class; ``side`` names the relation each feature is read from."""
    sp, lv = TREES[name]

    def node(n):
        if n in lv:
            return repr(lv[n][cls])
        f, t, l, r = sp[n]
        return f"(CASE WHEN {side(FEATS[f]) + '.' if side else ''}{FEATS[f]} <= {t!r} THEN {node(l)} ELSE {node(r)} END)"
    return node(0)


def shap_sql(name="tree_a") -> str:
    """Shapley sums over all subsets of the tree's features, one pass over (row, background row)."""
    used = sorted({FEATS[f] for f, _, _, _ in TREES[name][0].values()})
    n = len(used)
    import math
    wts = {s: math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)}

    def mixed(mask):
        return lambda f: "x" if mask >> used.index(f) & 1 else "z"
    values = ", ".join(f"{_f_sql(name, c, mixed(m))} AS f{m}_{c}" for m in range(2 ** n) for c in range(len(STAGES)))
    sums, terms = [], []
    for i, f in enumerate(used):
        for c in range(len(STAGES)):
            e = " + ".join(f"{wts[bin(m).count('1')]!r} * (f{m | 1 << i}_{c} - f{m}_{c})" for m in range(2 ** n) if not m >> i & 1)
            sums.append(f"SUM({e}) / {N_BG}.0 AS p{i}_{c}")
            terms.append(f"SELECT row_id, '{f}' AS feature, {c} AS class, p{i}_{c} AS phi FROM sums")
    terms += [f"SELECT row_id, '{f}', {c}, 0.0 FROM x" for f in FEATS if f not in used for c in range(len(STAGES))]
    return f"""WITH {OP_CTE},
x AS (SELECT row_id, {", ".join(FEATS)} FROM order_profile ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '7')), row_id LIMIT {N_EVAL}),
z AS (SELECT row_id, {", ".join(FEATS)} FROM order_profile ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42')), row_id LIMIT {N_BG}),
fv AS (SELECT x.row_id, {values} FROM x CROSS JOIN z),
sums AS (SELECT row_id, {", ".join(sums)} FROM fv GROUP BY row_id),
phi AS ({" UNION ALL ".join(terms)})"""


def _shap_q(name):
    def q(spark, sf):
        return shap(spark, sf, name)
    return q


for _t in TREES:
    reg(f"sh1_tree_shap_{_t}", shap_sql(_t) + " SELECT row_id, feature, CAST(class AS INTEGER) AS class, phi FROM phi")(_shap_q(_t))


# SH2 ----------------------------------------------------------------------
def _sh2(spark, sf):
    _, bg = rows_and_background(spark, sf)
    return X.base_values(bg, FEATS, model("tree_a"))


reg("sh2_base_values", f"""WITH {OP_CTE},
z AS (SELECT row_id, {", ".join(FEATS)} FROM order_profile ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42')), row_id LIMIT {N_BG})
""" + " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS class, AVG({_f_sql('tree_a', c)}) AS base FROM z" for c in range(len(STAGES))))(_sh2)

# SH3 ----------------------------------------------------------------------
def pred_sql(name="tree_a"):
    return ", pr0 AS (" + " UNION ALL ".join(
        f"SELECT row_id, {c} AS c, {_f_sql(name, c)} AS f FROM x" for c in range(len(STAGES))) + \
        "), pred AS (SELECT row_id, CAST(c AS INTEGER) AS prediction FROM (SELECT row_id, c, ROW_NUMBER() OVER " \
        "(PARTITION BY row_id ORDER BY f DESC, c) AS r FROM pr0) q WHERE r = 1)"


_pred_sql = pred_sql()
reg("sh3_predicted_class_values", shap_sql() + _pred_sql +
    " SELECT p.row_id, p.feature, CAST(p.class AS INTEGER) AS class, p.phi FROM phi p JOIN pred ON pred.row_id = p.row_id AND pred.prediction = p.class")(
    lambda spark, sf: X.predicted_class_values(shap(spark, sf), predictions(spark, sf), "row_id"))


# SH4 ----------------------------------------------------------------------
def _imp(spark, sf, name="tree_a"):
    return X.importance_table(shap(spark, sf, name), predictions(spark, sf, name), "row_id", FEATS, STAGES)


def _imp_sql(name="tree_a"):
    cls_cols = ", ".join(
        f"COALESCE(SUM(CASE WHEN class = {i} THEN abs(phi) END) / {N_EVAL}.0, 0.0) AS mean_abs_shap_{c}"
        for i, c in enumerate(STAGES))
    allc = "(" + " + ".join([f"mean_abs_shap_{c}" for c in STAGES]) + f") / {len(STAGES)}.0"
    allc = "(" + "(" * (len(STAGES)) + "0.0 + " + " + ".join(f"mean_abs_shap_{c})" for c in STAGES) + f") / {float(len(STAGES))!r}"
    feats = ", ".join(f"('{f}')" for f in FEATS)
    return (shap_sql(name) + pred_sql(name) + f""",
fl AS (SELECT * FROM (VALUES {feats}) v(feature)),
pc AS (SELECT p.feature, SUM(abs(p.phi)) / {N_EVAL}.0 AS mean_abs_shap_predicted_class FROM phi p
       JOIN pred ON pred.row_id = p.row_id AND pred.prediction = p.class GROUP BY p.feature),
per AS (SELECT feature, {cls_cols} FROM phi GROUP BY feature),
imp0 AS (SELECT fl.feature, COALESCE(pc.mean_abs_shap_predicted_class, 0.0) AS mean_abs_shap_predicted_class,
                {", ".join(f"COALESCE(per.mean_abs_shap_{c}, 0.0) AS mean_abs_shap_{c}" for c in STAGES)}
         FROM fl LEFT JOIN pc USING (feature) LEFT JOIN per USING (feature)),
imp AS (SELECT *, {allc} AS mean_abs_shap_all_classes,
               ROW_NUMBER() OVER (ORDER BY mean_abs_shap_predicted_class DESC, feature) AS rank FROM imp0)""")


reg("sh4_importance_table", _imp_sql() + " SELECT * FROM imp")(_imp)


# SH5 / SH6 ---------------------------------------------------------------
def _values_long(spark, sf):
    ev, _ = rows_and_background(spark, sf)
    return ev.unpivot("row_id", FEATS, "feature", "value")


def _local(spark, sf):
    sp = X.predicted_class_values(shap(spark, sf), predictions(spark, sf), "row_id")
    return X.local_contributions(sp, _values_long(spark, sf), "row_id")


_vals = " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, {f} AS value FROM x" for f in FEATS)
LOCAL_SQL = shap_sql() + _pred_sql + f""", vals AS ({_vals}),
sp AS (SELECT p.row_id, p.feature, p.class, p.phi FROM phi p JOIN pred ON pred.row_id = p.row_id AND pred.prediction = p.class),
loc AS (SELECT sp.row_id, sp.feature, vals.value, sp.phi, abs(sp.phi) AS abs_phi,
               CASE WHEN sp.phi >= 0 THEN 'supports' ELSE 'opposes' END AS direction,
               CASE WHEN SUM(abs(sp.phi)) OVER (PARTITION BY sp.row_id) = 0 THEN 0.0
                    ELSE abs(sp.phi) / SUM(abs(sp.phi)) OVER (PARTITION BY sp.row_id) END AS impact_share
        FROM sp LEFT JOIN vals USING (row_id, feature))"""
reg("sh5_local_contributions", LOCAL_SQL + " SELECT * FROM loc")(_local)

reg("sh6_top_drivers", LOCAL_SQL + """,
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY abs_phi DESC, feature) AS strength_rank FROM loc),
t2 AS (SELECT *, CASE WHEN phi > 0 THEN 'positive' WHEN phi < 0 THEN 'negative' END AS side FROM t WHERE strength_rank <= 10)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id, side ORDER BY abs_phi DESC, feature) AS side_rank
               FROM t2 WHERE side IS NOT NULL) q WHERE side_rank <= 3""")(
    lambda spark, sf: X.top_drivers(_local(spark, sf), "row_id"))


# SH7 -----------------------------------------------------------------------
def _sh7(spark, sf):
    from tessera.functions.scalar import feature_label
    d = X.top_drivers(_local(spark, sf), "row_id").withColumn("label", feature_label(F.col("feature")))
    names = F.array(*[F.lit(c) for c in STAGES])
    d = d.join(predictions(spark, sf).select("row_id", F.element_at(names, F.col("prediction") + 1).alias("class_name")), "row_id")
    return X.driver_sentences(d, "row_id").select("row_id", "feature", "side", "side_rank", "sentence")


reg("sh7_driver_sentences", LOCAL_SQL + """,
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY abs_phi DESC, feature) AS strength_rank FROM loc),
t2 AS (SELECT *, CASE WHEN phi > 0 THEN 'positive' WHEN phi < 0 THEN 'negative' END AS side FROM t WHERE strength_rank <= 10),
t3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id, side ORDER BY abs_phi DESC, feature) AS side_rank FROM t2 WHERE side IS NOT NULL)
SELECT row_id, feature, side, side_rank,
  printf('%s at %s speaks %s %s: SHAP %.3f, %.1f%% of the impact',
         (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(substr(s, i - 1, 1), '^[A-Za-z]$') THEN upper(substr(s, i, 1)) ELSE lower(substr(s, i, 1)) END, '' ORDER BY i)
          FROM (SELECT replace(feature, '_', ' ') AS s) q, generate_series(1, length(q.s)) g(i)),
         CASE WHEN value IS NULL THEN 'Imputed' ELSE printf('%.2f', value) END, CASE WHEN phi >= 0 THEN 'for' ELSE 'against' END,
         [""" + ", ".join(f"'{c}'" for c in STAGES) + """][prediction + 1], phi, impact_share * 100) AS sentence
FROM t3 JOIN pred USING (row_id) WHERE side_rank <= 3""")(_sh7)


# SH8 -----------------------------------------------------------------------
def _sh8(spark, sf):
    sp = X.predicted_class_values(shap(spark, sf), predictions(spark, sf), "row_id")
    base = X.base_values(rows_and_background(spark, sf)[1], FEATS, model())
    return X.waterfall(sp, base, "row_id", max_display=3).select("row_id", "class", "feature", "phi", "r", "base", "end")


_base_sql = " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS class, AVG({_f_sql('tree_a', c)}) AS base FROM z"
                               for c in range(len(STAGES)))
reg("sh8_waterfall", shap_sql() + _pred_sql + f""", bs AS ({_base_sql}),
sp AS (SELECT p.row_id, p.feature, p.class, p.phi FROM phi p JOIN pred ON pred.row_id = p.row_id AND pred.prediction = p.class),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS r FROM sp),
-- seven features, so the last five are collapsed
steps AS (SELECT row_id, class, feature, phi, r FROM r WHERE r < 3
          UNION ALL SELECT row_id, class, printf('%d other features', COUNT(*)), SUM(phi), 3 FROM r WHERE r >= 3 GROUP BY row_id, class)
SELECT s.row_id, CAST(s.class AS INTEGER) AS class, s.feature, s.phi, s.r, bs.base,
       bs.base + SUM(s.phi) OVER (PARTITION BY s.row_id ORDER BY s.r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "end"
FROM steps s JOIN bs USING (class)""")(_sh8)

# SH9 / SH13 ------------------------------------------------------------------
reg("sh9_bar_top_features", _imp_sql() + """ SELECT feature, mean_abs_shap_predicted_class AS importance,
ROW_NUMBER() OVER (ORDER BY mean_abs_shap_predicted_class DESC, feature) AS rank FROM imp QUALIFY rank <= 15""")(
    lambda spark, sf: X.top_features(_imp(spark, sf), k=15))

reg("sh13_importance_by_view", _imp_sql() + """ SELECT feature, TRY_CAST(mean_abs_shap_large AS DOUBLE) AS importance,
ROW_NUMBER() OVER (ORDER BY TRY_CAST(mean_abs_shap_large AS DOUBLE) DESC NULLS LAST, feature) AS rank,
'mean_abs_shap_large' AS view FROM imp QUALIFY rank <= 12""")(
    lambda spark, sf: X.importance_by_view(_imp(spark, sf), "mean_abs_shap_large", STAGES, 12))


# SH10 --------------------------------------------------------------------
def _sh10(spark, sf):
    sp = X.predicted_class_values(shap(spark, sf), predictions(spark, sf), "row_id")
    return X.beeswarm(sp, _values_long(spark, sf), _imp(spark, sf), "row_id", k=15).select(
        "row_id", "feature", "phi", "value", "rank")


reg("sh10_beeswarm", _imp_sql() + _pred_sql.replace("pr0 AS", "pr1 AS").replace("FROM pr0", "FROM pr1").replace(", pred AS", ", pred2 AS") + f""",
vals AS ({_vals}),
top AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY mean_abs_shap_predicted_class DESC, feature) AS rank FROM imp QUALIFY rank <= 15),
sp AS (SELECT p.row_id, p.feature, p.phi FROM phi p JOIN pred ON pred.row_id = p.row_id AND pred.prediction = p.class)
SELECT sp.row_id, sp.feature, sp.phi, vals.value, top.rank FROM sp JOIN top USING (feature) LEFT JOIN vals USING (row_id, feature)""")(_sh10)


# SH11 / JN1 / AG19 -------------------------------------------------------------
def _sh11(spark, sf):
    tabs = {n: _imp(spark, sf, n) for n in TREES}
    return X.compare_importances(tabs, k=15)


def _sh11_sql():
    parts = []
    for n in TREES:
        body = _imp_sql(n)
        parts.append(f"SELECT feature, mean_abs_shap_predicted_class AS {n} FROM ({body} SELECT * FROM imp) q_{n}")
    j = f"({parts[0]}) a FULL OUTER JOIN ({parts[1]}) b USING (feature) FULL OUTER JOIN ({parts[2]}) c USING (feature)"
    names = list(TREES)
    avg = "0.0"
    for n in names:
        avg = f"({avg} + COALESCE({n}, 0.0))"
    avg = f"{avg} / {float(len(names))!r}"
    return (f"SELECT feature, {', '.join(f'COALESCE({n}, 0.0) AS {n}' for n in names)}, {avg} AS average, "
            f"ROW_NUMBER() OVER (ORDER BY {avg} DESC, feature) AS rank FROM {j} QUALIFY rank <= 15")


reg("sh11_jn1_ag19_model_comparison", _sh11_sql())(_sh11)


# SH12 ------------------------------------------------------------------------
def _sh12(spark, sf):
    views = X.importance_views(_imp(spark, sf), [*STAGES, "no such class"])
    return spark.createDataFrame(list(enumerate(views)), "position int, view string")


_views = ", ".join(f"({i}, '{v}')" for i, v in enumerate(["mean_abs_shap_all_classes", *(f"mean_abs_shap_{c}" for c in STAGES)]))
reg("sh12_importance_views", f"WITH {OP_CTE} SELECT * FROM (VALUES {_views}) v(position, view) WHERE (SELECT COUNT(*) FROM order_profile) > 0")(_sh12)


# SH14 ----------------------------------------------------------------------
def _sh14(spark, sf):
    imp = _imp(spark, sf)
    feats = X.primary_features(imp, FEATS, ["acct_bal", "price_sum", "total_price"], count=5)
    return imp.where(F.col("feature").isin(feats)).select("feature", "rank")


def _sh14_fallback(spark, sf):
    feats = X.primary_features(_imp(spark, sf), FEATS, ["acct_bal", "not_a_feature", "price_sum", "total_price"], count=10)
    return spark.createDataFrame(list(enumerate(feats, 1)), "position int, feature string")


reg("sh14_primary_features_fallback", f"WITH {OP_CTE} SELECT * FROM (VALUES (1, 'acct_bal'), (2, 'price_sum'), (3, 'total_price')) v(position, feature) "
    "WHERE (SELECT COUNT(*) FROM order_profile) > 0")(_sh14_fallback)
reg("sh14_primary_features", _imp_sql() + " SELECT feature, rank FROM imp WHERE rank <= 5")(_sh14)


# WN5: top drivers by |phi|, re-sorted by signed value ---------------------------------
def _wn5(spark, sf):
    from pyspark.sql import Window
    loc = _local(spark, sf)
    w = Window.partitionBy("row_id").orderBy(F.desc("abs_phi"), F.asc("feature"))
    top = loc.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 5)
    w2 = Window.partitionBy("row_id").orderBy(F.asc("phi"), F.asc("feature"))
    return top.select("row_id", "feature", "phi", F.row_number().over(w2).alias("signed_order"))


reg("wn5_resorted_top_k", LOCAL_SQL + """,
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY abs_phi DESC, feature) AS r FROM loc)
SELECT row_id, feature, phi, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY phi, feature) AS signed_order
FROM t WHERE r <= 5""")(_wn5)


# ML7: class scores and prediction of a literal tree, every order --------------------
def _ml7(spark, sf):
    d = op(spark, sf).select("row_id", *FEATS)
    fx = tree_sums(d, FEATS, model("tree_b").trees, len(STAGES), "fx", closed=True)
    pos = F.array_position("fx", F.array_max("fx"))
    names = F.array(*[F.lit(c) for c in STAGES])
    return fx.select("row_id", F.element_at(names, pos.cast("int")).alias("prediction"),
                     *[F.element_at("fx", i + 1).alias(f"f_{c}") for i, c in enumerate(STAGES)])


_fx = ", ".join(f"CAST({_f_sql('tree_b', i)} AS DOUBLE) AS f_{c}" for i, c in enumerate(STAGES))
_all = ", ".join(f"f_{c}" for c in STAGES)
_stage_names = "[" + ", ".join(f"'{c}'" for c in STAGES) + "]"
reg("ml7_literal_tree", f"""WITH {OP_CTE}, s AS (SELECT row_id, {_fx} FROM order_profile)
SELECT row_id, {_stage_names}[list_position([{_all}], greatest({_all}))] AS prediction, {_all} FROM s""")(_ml7)
