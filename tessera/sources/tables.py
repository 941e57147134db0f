"""Table sources: driver parquet tables and the ``order_profile`` relation."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; later projections/filters are pruned/pushed into the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def _dec(c: str):
    return F.col(c).cast("decimal(18,2)")


#: Lines whose orders one task adds up: a bound of its memory, whatever the size of the table and its files.
TASK_LINES = 1_000_000


def line_tasks(spark: SparkSession, lines: DataFrame) -> int | None:
    """Tasks for a million lines each; None where the session's number of partitions has no fewer."""
    tasks = math.ceil(lines.count() / TASK_LINES)  # from the files' footers
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregates (one shuffle on l_orderkey).

    Lines are dealt out by order before they are added up: the lines of an order are few and
    stand anywhere, so a task of the scan would hold nearly a sum for each of its lines.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # part grows with the data: let the planner choose (sort-merge beyond the
    # auto-broadcast threshold, AQE converts to broadcast when measured small).
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    tasks = line_tasks(spark, li)
    dealt = j.repartition(tasks, "l_orderkey") if tasks else j.repartition("l_orderkey")
    return dealt.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(_dec("l_quantity")).alias("qty_sum"),
        F.sum(_dec("l_extendedprice")).alias("price_sum"),
        F.max(_dec("l_extendedprice")).alias("price_max"),
        F.sum(_dec("l_discount")).alias("disc_sum"),
        F.sum(_dec("l_tax")).alias("tax_sum"),
        F.max("p_size").alias("part_size_max"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_return"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("has_open"),
    )


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with an imbalanced 5-class ``stage`` target (FIXTURES.md §4)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    cdim = (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
                .join(region, nation.n_regionkey == region.r_regionkey)
                .select("c_custkey", "c_acctbal", "c_mktsegment", "r_name"))
    lines = order_lines(spark, sf_dir)
    # lines is already hash-partitioned on l_orderkey by its aggregation, so the
    # orders/lines join only shuffles orders.
    ol = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    tasks = line_tasks(spark, read_table(spark, sf_dir, "lineitem"))
    if tasks:  # the join to customers is bounded likewise
        ol = ol.repartition(tasks, "o_custkey")
    j = ol.join(cdim, ol.o_custkey == cdim.c_custkey, "inner")
    lc = F.col("line_count")
    qs = F.col("qty_sum")
    bal = F.col("c_acctbal")
    stage = (F.when(lc.isNull(), "empty").when(lc >= 9, "bulk")
             .when(qs < 30, "small").when(qs < 80, "mid").otherwise("large"))
    band = (F.when(bal < 0, "Low").when(bal < 2500, "Lower-Middle")
            .when(bal < 5000, "Middle").when(bal < 7500, "Upper-Middle").otherwise("High"))
    dz = F.lit(0).cast("decimal(28,2)")
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        stage.alias("stage"),
        F.coalesce(lc, F.lit(0).cast("long")).alias("line_count"),
        F.coalesce(qs, dz).cast("double").alias("qty_sum"),
        F.col("o_totalprice").alias("total_price"),
        F.coalesce(F.col("price_sum"), dz).cast("double").alias("price_sum"),
        F.coalesce(F.col("price_max"), F.lit(0).cast("decimal(18,2)")).cast("double").alias("price_max"),
        F.coalesce(F.col("disc_sum"), dz).cast("double").alias("disc_sum"),
        F.coalesce(F.col("tax_sum"), dz).cast("double").alias("tax_sum"),
        F.col("part_size_max").cast("double").alias("part_size_max"),
        bal.alias("acct_bal"),
        F.coalesce(F.col("has_return"), F.lit(0)).alias("has_return"),
        F.coalesce(F.col("has_open"), F.lit(0)).alias("has_open"),
        F.when(bal < 0, 1).otherwise(0).alias("neg_balance"),
        F.col("o_orderpriority").alias("priority"),
        band.alias("balance_band"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
    )


# DuckDB/ANSI text of the same relation, used by the SQL oracles.
ORDER_PROFILE_SQL = """
WITH lines AS (
  SELECT l_orderkey,
         COUNT(*) AS line_count,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty_sum,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS price_sum,
         MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS price_max,
         SUM(CAST(l_discount AS DECIMAL(18,2))) AS disc_sum,
         SUM(CAST(l_tax AS DECIMAL(18,2))) AS tax_sum,
         MAX(p_size) AS part_size_max,
         MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return,
         MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS has_open
  FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY l_orderkey)
SELECT o_orderkey AS row_id,
       CASE WHEN line_count IS NULL THEN 'empty'
            WHEN line_count >= 9 THEN 'bulk'
            WHEN qty_sum < 30 THEN 'small'
            WHEN qty_sum < 80 THEN 'mid'
            ELSE 'large' END AS stage,
       COALESCE(line_count, 0) AS line_count,
       CAST(COALESCE(qty_sum, 0) AS DOUBLE) AS qty_sum,
       o_totalprice AS total_price,
       CAST(COALESCE(price_sum, 0) AS DOUBLE) AS price_sum,
       CAST(COALESCE(price_max, 0) AS DOUBLE) AS price_max,
       CAST(COALESCE(disc_sum, 0) AS DOUBLE) AS disc_sum,
       CAST(COALESCE(tax_sum, 0) AS DOUBLE) AS tax_sum,
       CAST(part_size_max AS DOUBLE) AS part_size_max,
       c_acctbal AS acct_bal,
       COALESCE(has_return, 0) AS has_return,
       COALESCE(has_open, 0) AS has_open,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS neg_balance,
       o_orderpriority AS priority,
       CASE WHEN c_acctbal < 0 THEN 'Low' WHEN c_acctbal < 2500 THEN 'Lower-Middle'
            WHEN c_acctbal < 5000 THEN 'Middle' WHEN c_acctbal < 7500 THEN 'Upper-Middle'
            ELSE 'High' END AS balance_band,
       o_orderstatus AS status,
       c_mktsegment AS segment,
       r_name AS region
FROM orders
JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
LEFT JOIN lines ON l_orderkey = o_orderkey
"""
