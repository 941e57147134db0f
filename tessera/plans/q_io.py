"""Registered queries: IO (IO1-IO4, IO7), projections/reshaping (PR1-PR16), joins (JN2-JN4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import features as FE
from tessera.operators import metrics as M
from tessera.operators import profile as P
from tessera.plans.fixtures import STAGES, rule_scored_sql
from tessera.plans.q_core import op, op_split, test_scored
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE, split_ctes
from tessera.sources import io as IO
from tessera.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}
S = ORDER_SPEC
W = f"WITH {OP_CTE}"
WS = f"WITH {OP_CTE},{split_ctes()}"


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


ALL = ["row_id", "stage", *S.leakage, *S.features]

# IO1 / IO3: CSV round trip with explicit schema ----------------------------
@reg("io1_io3_csv_roundtrip", f"{W} SELECT {', '.join(ALL)} FROM order_profile")
def _io1(spark, sf):
    d = op(spark, sf).select(*ALL)
    path = IO.write_csv(d, IO.scratch_path(spark, "order_profile_csv"))
    return IO.read_csv(spark, path, d.schema)


# IO1: the same file with its types found ------------------------------------
_INTEGERS = ("line_count", "has_return", "has_open", "neg_balance")


@reg("io1_inferred_types", f"{W} SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c in _INTEGERS else c for c in ALL)} FROM order_profile")
def _io1_types(spark, sf):
    path = IO.write_csv(op(spark, sf).select(*ALL), IO.scratch_path(spark, "order_profile_csv"))
    return IO.read_csv_inferred(spark, path)


# IO2: split written partitioned by split, read back pruned ------------------
@reg("io2_parquet_split_load", f"{WS} SELECT row_id, stage, acct_bal FROM split WHERE split = 'test'")
def _io2(spark, sf):
    path = IO.write_parquet(op_split(spark, sf).select("row_id", "stage", "acct_bal", "split"),
                            IO.scratch_path(spark, "split"), ["split"])
    return spark.read.parquet(path).where(F.col("split") == "test").select("row_id", "stage", "acct_bal")


# IO4: labelled confusion matrix sink -----------------------------------------
@reg("io4_confusion_matrix_csv", WS + ", scored AS (" + rule_scored_sql("price_rule", "(SELECT * FROM split WHERE split = 'test')")
     + "), counts AS (SELECT label AS actual, prediction AS predicted, COUNT(*) AS n FROM scored GROUP BY 1, 2) "
     + "SELECT a.actual, " + ", ".join(f"CAST(COALESCE(SUM(CASE WHEN predicted = '{c}' THEN n END), 0) AS BIGINT) AS {c}" for c in STAGES)
     + " FROM (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in STAGES) + ") v(actual)) a LEFT JOIN counts USING (actual) GROUP BY a.actual")
def _io4(spark, sf):
    wide = M.confusion_matrix_wide(M.confusion_counts(test_scored(spark, sf, "price_rule")), STAGES)
    path = IO.write_csv(wide, IO.scratch_path(spark, "confusion"))
    return IO.read_csv(spark, path, wide.schema)


# IO7: load-or-build cluster profiles ----------------------------------------
def _io7(spark, sf):
    from tessera.plans.q_segments import profiles
    path = IO.scratch_path(spark, "cluster_profiles")
    IO.load_or_build(spark, path, lambda: profiles(spark, sf))  # builds + writes
    return IO.load_or_build(spark, path, lambda: profiles(spark, sf))  # reads


def _io7_sql():
    from tessera.plans.q_segments import CLUSTER_SQL
    return CLUSTER_SQL + " SELECT * FROM prof"


reg("io7_load_or_build_profiles", _io7_sql())(_io7)

# PR1-PR5 ----------------------------------------------------------------------
reg("pr1_drop_leakage", f"{W} SELECT * EXCLUDE (line_count, qty_sum) FROM order_profile")(
    lambda spark, sf: op(spark, sf).drop(*S.leakage, "not_a_column"))
reg("pr2_select_features", f"{W} SELECT {', '.join(S.features)} FROM order_profile")(
    lambda spark, sf: op(spark, sf).select(*S.features))


def _numeric_cols(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


reg("pr3_select_numeric", f"{W} SELECT row_id, line_count, qty_sum, total_price, price_sum, price_max, disc_sum, tax_sum, "
    "part_size_max, acct_bal, has_return, has_open, neg_balance FROM order_profile")(
    lambda spark, sf: op(spark, sf).select(*_numeric_cols(op(spark, sf))))
reg("pr4_drop_string_columns", f"{W} SELECT * EXCLUDE (stage, priority, balance_band, status, segment, region) FROM order_profile")(
    lambda spark, sf: op(spark, sf).drop(*S.string_cols))
reg("pr5_cast_double", f"{W} SELECT row_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in S.numeric + S.binary) + " FROM order_profile")(
    lambda spark, sf: op(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in S.numeric + S.binary]))

# PR6 / PR7 / PR8 / PR9 / PR10 ------------------------------------------------------
reg("pr6_coerce_numeric", f"{W} SELECT row_id, TRY_CAST(substr(priority, 1, 1) AS DOUBLE) AS priority_num, "
    "COALESCE(TRY_CAST(status AS DOUBLE), 0.0) AS status_num FROM order_profile")(
    lambda spark, sf: op(spark, sf).select(
        "row_id", F.expr("try_cast(substr(priority, 1, 1) as double)").alias("priority_num"),
        F.coalesce(F.expr("try_cast(status as double)"), F.lit(0.0)).alias("status_num")))
reg("pr7_two_way_label", f"{W} SELECT row_id, CASE WHEN has_return = 1 THEN 'returned' ELSE 'clean' END AS flag FROM order_profile")(
    lambda spark, sf: op(spark, sf).select("row_id", F.when(F.col("has_return") == 1, "returned").otherwise("clean").alias("flag")))
reg("pr8_filter", f"{W} SELECT row_id, stage, price_sum FROM order_profile WHERE stage = 'bulk' AND price_sum > 400000")(
    lambda spark, sf: op(spark, sf).where((F.col("stage") == "bulk") & (F.col("price_sum") > 400000)).select("row_id", "stage", "price_sum"))
reg("pr9_rename", f"{W} SELECT row_id AS order_key, stage AS target FROM order_profile")(
    lambda spark, sf: op(spark, sf).select("row_id", "stage").withColumnRenamed("row_id", "order_key").withColumnRenamed("stage", "target"))

# Display names for two segments; others fall back to 'Segment <name>'.
SEG_NAMES = {"BUILDING": "Construction", "MACHINERY": "Industrial"}
reg("pr10_label_with_default", f"{W} SELECT row_id, COALESCE(CASE segment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEG_NAMES.items())
    + " END, 'Segment ' || segment) AS segment_name FROM order_profile")(
    lambda spark, sf: op(spark, sf).select("row_id", F.coalesce(
        F.create_map(*[x for k, v in SEG_NAMES.items() for x in (F.lit(k), F.lit(v))])[F.col("segment")],
        F.concat(F.lit("Segment "), F.col("segment"))).alias("segment_name")))

# PR11 / PR12 / PR13 / PR14 / PR15 / PR16 ----------------------------------------------
reg("pr11_wide_to_long", f"{W} " + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM order_profile" for c in S.numeric))(
    lambda spark, sf: op(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in S.numeric])
    .unpivot("row_id", list(S.numeric), "feature", "value"))


def _pr12(spark, sf):
    summ = P.numeric_summary(op(spark, sf), list(S.numeric))
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    long = summ.select("column_name", *[F.col(s).cast("double").alias(s) for s in stats]).unpivot(
        "column_name", stats, "stat", "value")
    return long.groupBy("stat").pivot("column_name", list(S.numeric)).agg(F.first("value"))


_nv = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM order_profile" for c in S.numeric)
_st = " UNION ALL ".join(f"SELECT '{s}' AS stat, column_name, CAST({e} AS DOUBLE) AS value FROM kv GROUP BY column_name"
                         for s, e in [("count", "COUNT(value)"), ("mean", "AVG(value)"), ("std", "STDDEV_SAMP(value)"),
                                      ("min", "MIN(value)"), ("q25", "quantile_cont(value, 0.25)"),
                                      ("q50", "quantile_cont(value, 0.5)"), ("q75", "quantile_cont(value, 0.75)"),
                                      ("max", "MAX(value)")])
reg("pr12_transpose_summary", f"{W}, kv AS ({_nv}), l AS ({_st}) SELECT stat, "
    + ", ".join(f"MAX(CASE WHEN column_name = '{c}' THEN value END) AS {c}" for c in S.numeric) + " FROM l GROUP BY stat")(_pr12)


def _pr13(spark, sf):
    sc = test_scored(spark, sf, "price_rule")
    return P.class_distribution(sc.select(F.col("prediction")), "prediction", STAGES)


reg("pr13_reindex_fill", WS + ", scored AS (" + rule_scored_sql("price_rule", "(SELECT * FROM split WHERE split = 'test')")
    + "), cls AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(STAGES)) + ") v(code, class_name)), "
    "c AS (SELECT prediction AS class_name, COUNT(*) AS cnt FROM scored GROUP BY 1), "
    "j AS (SELECT code, cls.class_name, COALESCE(cnt, 0) AS count FROM cls LEFT JOIN c USING (class_name)) "
    "SELECT code, class_name, count, CAST(CAST(FLOOR((2000 * count + SUM(count) OVER ()) / (2 * SUM(count) OVER ())) "
    "AS DECIMAL(20,0)) / 10 AS DECIMAL(20,1)) AS percent FROM j")(_pr13)

reg("pr14_distinct_first_position", f"{W} SELECT segment, MIN(row_id) AS first_position FROM order_profile GROUP BY segment")(
    lambda spark, sf: op(spark, sf).groupBy("segment").agg(F.min("row_id").alias("first_position")))
reg("pr15_set_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda spark, sf: read_table(spark, sf, "orders").select("o_orderkey").join(
        read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"))

WANTED = ["acct_bal", "price_sum", "not_present", "tax_sum"]


def _pr16(spark, sf):
    d = op(spark, sf)
    keep = [c for c in WANTED if c in d.columns]
    if not keep:
        raise ValueError("none of the requested columns are available")
    return d.select("row_id", *keep)


reg("pr16_available_columns", f"{W} SELECT row_id, acct_bal, price_sum, tax_sum FROM order_profile")(_pr16)


# JN2 / JN3 / JN4 ------------------------------------------------------------------
def _jn2(spark, sf):
    from tessera.plans.q_segments import clustered
    a_tr, _, _ = clustered(spark, sf)
    return op(spark, sf).select("row_id", "stage").join(a_tr.select("row_id", "cluster"), "row_id")


def _jn2_sql():
    from tessera.plans.q_segments import CLUSTER_SQL
    return CLUSTER_SQL + " SELECT o.row_id, o.stage, a.cluster FROM order_profile o JOIN assigned a USING (row_id)"


reg("jn2_attach_clusters", _jn2_sql())(_jn2)


def _jn3(spark, sf):
    d = op(spark, sf)
    cats = FE.fit_categories(d, ["segment"])["segment"]
    lookup = spark.createDataFrame([(c, float(i)) for i, c in enumerate(cats)], "segment string, segment_code double")
    # the lookup has one row per distinct category
    return d.select("row_id", "segment").join(F.broadcast(lookup), "segment", "left").select(
        "row_id", "segment", F.coalesce("segment_code", F.lit(-1.0)).alias("segment_code"))


reg("jn3_category_code_lookup", f"{W}, c AS (SELECT segment, CAST(ROW_NUMBER() OVER (ORDER BY segment) - 1 AS DOUBLE) AS segment_code "
    "FROM (SELECT DISTINCT segment FROM order_profile WHERE segment IS NOT NULL) d) "
    "SELECT row_id, segment, COALESCE(segment_code, -1.0) AS segment_code FROM order_profile LEFT JOIN c USING (segment)")(_jn3)

reg("jn4_union_by_name", f"{WS} SELECT row_id, stage, split FROM split WHERE split = 'test' UNION ALL "
    "SELECT row_id, stage, split FROM split WHERE split = 'train' AND stage = 'bulk'")(
    lambda spark, sf: op_split(spark, sf).where(F.col("split") == "test").select("row_id", "stage", "split").unionByName(
        op_split(spark, sf).where((F.col("split") == "train") & (F.col("stage") == "bulk")).select("stage", "row_id", "split")))
