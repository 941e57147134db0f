"""Registered queries: profiling / EDA (AG1-AG15, AG20-AG23)."""

from __future__ import annotations

from tessera.operators import profile as P
from tessera.plans.q_core import op
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE
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
STR_COLS = list(S.string_cols)
NUM_COLS = list(S.numeric)
ALL_COLS = ["row_id", S.target, *S.leakage, *S.features]
W = f"WITH {OP_CTE}"


def _union(cols, tmpl):
    return " UNION ALL ".join(tmpl.format(c=c) for c in cols)


# AG1 / AG2 -----------------------------------------------------------------
_vc = _union(STR_COLS, "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM order_profile")
reg("ag1_value_counts", f"""{W}, kv AS ({_vc}), c AS (SELECT column_name, value, COUNT(*) AS count FROM kv GROUP BY 1, 2)
SELECT column_name, value, count, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM c""")(
    lambda spark, sf: P.value_counts(op(spark, sf), STR_COLS))

reg("ag2_value_shares", f"""{W}, kv AS ({_vc}), c AS (SELECT column_name, value, COUNT(*) AS count FROM kv GROUP BY 1, 2)
SELECT column_name, value, count, count / SUM(count) OVER (PARTITION BY column_name) AS share,
       ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM c""")(
    lambda spark, sf: P.value_counts(op(spark, sf), STR_COLS, normalize=True))

# AG3 -----------------------------------------------------------------------
reg("ag3_conditional_distribution", f"""{W}, c AS (SELECT segment, stage, COUNT(*) AS count FROM order_profile GROUP BY 1, 2)
SELECT segment, stage, count, count / SUM(count) OVER (PARTITION BY segment) AS share FROM c""")(
    lambda spark, sf: P.conditional_distribution(op(spark, sf), "segment", "stage"))

# AG5 -----------------------------------------------------------------------
_nv = _union(NUM_COLS, "SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM order_profile")
reg("ag5_numeric_summary", f"""{W}, kv AS ({_nv})
SELECT column_name, COUNT(value) AS count, AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       MAX(value) AS max FROM kv GROUP BY column_name""")(
    lambda spark, sf: P.numeric_summary(op(spark, sf), NUM_COLS))

# AG6-AG9 -------------------------------------------------------------------
_num_all = set(NUM_COLS) | set(S.binary) | {"row_id", "line_count", "qty_sum"}


def _chk(c):
    if c in _num_all:
        return (f"SELECT '{c}' AS column_name, SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_count, "
                f"COALESCE(SUM(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END), 0) AS nan_count, "
                f"SUM(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS zero_count, "
                f"SUM(CASE WHEN {c} < 50 THEN 1 ELSE 0 END) AS below_count FROM order_profile")
    return (f"SELECT '{c}' AS column_name, SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_count, "
            f"0 AS nan_count, CAST(NULL AS BIGINT) AS zero_count, CAST(NULL AS BIGINT) AS below_count FROM order_profile")


reg("ag6_9_column_checks", f"{W} " + " UNION ALL ".join(_chk(c) for c in ALL_COLS))(
    lambda spark, sf: P.column_checks(op(spark, sf), ALL_COLS, 50.0))

# AG10 ----------------------------------------------------------------------
_types = [("row_id", "bigint"), ("stage", "string"), ("line_count", "bigint"), ("qty_sum", "double"),
          ("total_price", "double"), ("price_sum", "double"), ("price_max", "double"), ("disc_sum", "double"),
          ("tax_sum", "double"), ("part_size_max", "double"), ("acct_bal", "double"), ("has_return", "int"),
          ("has_open", "int"), ("neg_balance", "int"), ("priority", "string"), ("balance_band", "string"),
          ("status", "string"), ("segment", "string"), ("region", "string")]
reg("ag10_shape_and_types", f"{W} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS non_null, COUNT(*) AS rows FROM order_profile"
    for i, (c, t) in enumerate(_types)))(lambda spark, sf: P.shape_and_types(op(spark, sf)))

# AG11 ----------------------------------------------------------------------
reg("ag11_duplicate_rows", """
WITH g AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)
SELECT l_orderkey, l_linenumber, copies, UNNEST(generate_series(2, copies)) AS copy_no FROM g""")(
    lambda spark, sf: P.duplicate_rows(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")))

reg("ag11_duplicate_whole_rows", """
WITH g AS (SELECT event_type, user_id % 7 AS visitor, CAST(floor(value / 50) AS BIGINT) AS band, COUNT(*) AS copies FROM events GROUP BY ALL HAVING COUNT(*) > 1)
SELECT event_type, visitor, band, copies, UNNEST(generate_series(2, copies)) AS copy_no FROM g""")(
    lambda spark, sf: P.duplicate_rows(read_table(spark, sf, "events").selectExpr(
        "event_type", "user_id % 7 AS visitor", "CAST(floor(value / 50) AS BIGINT) AS band")))

# every column, and the table joined to a copy of a third of its rows, so that some rows do repeat
_line_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]
reg("ag11_duplicate_line_rows", f"""
WITH t AS (SELECT {", ".join(_line_cols)} FROM lineitem UNION ALL SELECT {", ".join(_line_cols)} FROM lineitem WHERE l_orderkey % 3 = 0),
g AS (SELECT *, COUNT(*) AS copies FROM t GROUP BY ALL HAVING COUNT(*) > 1)
SELECT *, UNNEST(generate_series(2, copies)) AS copy_no FROM g""")(
    lambda spark, sf: P.duplicate_rows((lambda t: t.unionByName(t.where("l_orderkey % 3 = 0")))(
        read_table(spark, sf, "lineitem").select(*_line_cols))))

# AG12 ----------------------------------------------------------------------
_corr_cols = NUM_COLS + list(S.binary)
_pairs = [(a, b) for i, a in enumerate(_corr_cols) for b in _corr_cols[i:]]
_corr_sql = " UNION ALL ".join(
    (f"SELECT '{a}' AS col_a, '{b}' AS col_b, {'1.0' if a == b else f'corr({a}, {b})'} AS corr"
     + ("" if a == b else " FROM order_profile")
     + ("" if a == b else f" UNION ALL SELECT '{b}', '{a}', corr({a}, {b}) FROM order_profile"))
    for a, b in _pairs)
reg("ag12_correlation_matrix", f"{W} {_corr_sql}")(
    lambda spark, sf: P.correlation_matrix(op(spark, sf), _corr_cols))

# AG13 / AG14 / AG15 ----------------------------------------------------------
reg("ag13_column_means", f"{W}, kv AS ({_nv}) SELECT column_name, AVG(value) AS mean FROM kv GROUP BY column_name")(
    lambda spark, sf: P.column_means(op(spark, sf), NUM_COLS))

_mode_cols = list(S.binary) + ["part_size_max"]
_mv = _union(_mode_cols, "SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM order_profile")
reg("ag14_column_modes", f"""{W}, kv AS ({_mv}), c AS (SELECT column_name, value, COUNT(*) AS n FROM kv WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT column_name, value, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM c)
SELECT column_name, value AS mode FROM r WHERE rn = 1""")(
    lambda spark, sf: P.column_modes(op(spark, sf), _mode_cols))

reg("ag15_column_medians", f"{W}, kv AS ({_nv}) SELECT column_name, quantile_cont(value, 0.5) AS median FROM kv WHERE value IS NOT NULL GROUP BY column_name")(
    lambda spark, sf: P.column_medians(op(spark, sf), NUM_COLS))

# AG20 ----------------------------------------------------------------------
reg("ag20_integer_only", f"""{W}, kv AS ({_nv}), r AS (
SELECT column_name, bool_and(abs(value - round_even(value, 0)) <= 1e-8 + 1e-5 * abs(round_even(value, 0))) AS integer_only
FROM kv WHERE value IS NOT NULL GROUP BY column_name)
SELECT column_name, integer_only, CASE WHEN integer_only THEN 1.0 ELSE 0.1 END AS step FROM r""")(
    lambda spark, sf: P.integer_only(op(spark, sf), NUM_COLS))

# AG21 ----------------------------------------------------------------------
_bv = _union(NUM_COLS, "SELECT stage AS grp, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM order_profile")
reg("ag21_box_stats", f"""{W}, kv AS (SELECT * FROM ({_bv}) u WHERE value IS NOT NULL),
q AS (SELECT column_name, grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM kv GROUP BY 1, 2),
q2 AS (SELECT *, q3 - q1 AS iqr FROM q),
a AS (SELECT kv.column_name, kv.grp, COUNT(*) AS n,
             MIN(CASE WHEN value >= q1 - 1.5 * iqr AND value <= q3 + 1.5 * iqr THEN value END) AS whisker_lo,
             MAX(CASE WHEN value >= q1 - 1.5 * iqr AND value <= q3 + 1.5 * iqr THEN value END) AS whisker_hi,
             SUM(CASE WHEN value >= q1 - 1.5 * iqr AND value <= q3 + 1.5 * iqr THEN 0 ELSE 1 END) AS outliers
      FROM kv JOIN q2 USING (column_name, grp) GROUP BY 1, 2)
SELECT q2.column_name, q2.grp AS stage, q1, median, q3, iqr, n, whisker_lo, whisker_hi, outliers FROM q2 JOIN a USING (column_name, grp)""")(
    lambda spark, sf: P.box_stats(op(spark, sf), NUM_COLS, "stage"))

# AG22 / AG23 ---------------------------------------------------------------
reg("ag22_histogram", f"""{W}, b AS (SELECT CAST(price_sum AS DOUBLE) AS x FROM order_profile WHERE price_sum IS NOT NULL),
r AS (SELECT MIN(x) AS mn, MAX(x) AS mx FROM b),
w AS (SELECT mn, CASE WHEN mx > mn THEN (mx - mn) / 30 ELSE 1.0 END AS w FROM r),
h AS (SELECT CAST(LEAST(FLOOR((x - mn) / w), 29) AS INTEGER) AS bin, COUNT(*) AS count FROM b CROSS JOIN w GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, mn + i * w AS lo, mn + (i + 1) * w AS hi, CAST(COALESCE(count, 0) AS BIGINT) AS count
FROM range(30) AS t(i) CROSS JOIN w LEFT JOIN h ON bin = i""")(
    lambda spark, sf: P.histogram(op(spark, sf), "price_sum", 30))

reg("ag22_histogram_strings", f"""{W} SELECT 'segment' AS column_name, segment AS value, COUNT(*) AS count,
ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, segment) AS rank FROM order_profile GROUP BY segment""")(
    lambda spark, sf: P.value_counts(op(spark, sf), ["segment"]))

# every point against every grid point
reg("ag23_kde_curve", f"""{W}, b AS (SELECT CAST(part_size_max AS DOUBLE) AS x FROM order_profile WHERE part_size_max IS NOT NULL),
p AS (SELECT n, mn, mx, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM (
  SELECT COUNT(*) AS n, MIN(x) AS mn, MAX(x) AS mx, STDDEV_SAMP(x) AS sd FROM b) st),
e AS (SELECT gi, (mn - 3.0 * bw) + gi * ((mx - mn + 2 * 3.0 * bw) / 199) AS gx, x, bw, n
      FROM b CROSS JOIN p CROSS JOIN (SELECT CAST(UNNEST(generate_series(0, 199)) AS INTEGER) AS gi) g)
SELECT gi, gx, SUM(exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (ANY_VALUE(n) * ANY_VALUE(bw) * sqrt(2 * pi())) AS density
FROM e GROUP BY gi, gx""")(
    lambda spark, sf: P.kde_curve(op(spark, sf), "part_size_max", 200, 3.0))
