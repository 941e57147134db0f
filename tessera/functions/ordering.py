"""Deterministic hash order and exact per-group ranks without one-task groups.

Sampling operators in the reference draw with a seeded generator. Here every row
gets a reproducible position ``md5(concat_ws('|', id, seed))`` with the id as tie
break; "the first q rows of a group in hash order" is then exact and identical in
Spark and in SQL.

``exact_rank`` never puts a whole group into one task: a prefix of the order column
splits each group into buckets, a small histogram gives each bucket its offset inside
the group, and only rows of one (group, bucket) are sorted together. The prefix is as
long as the data need: its length is found from counts (``prefix_length``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str | Column, seed: int | str) -> Column:
    """Hex md5 of ``id|seed``; lexicographic order = sampling order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def hash_unit(id_col: str | Column, seed: int | str, start: int = 1) -> Column:
    """Uniform value in [0, 1) from 13 hex digits (52 bits) of the md5."""
    h = hash_order(id_col, seed)
    digits = F.conv(F.substring(h, start, 13), 16, 10).cast("double")
    return digits / F.lit(float(16 ** 13))


BUCKET_ROWS = 200_000


def prefix_length(df: DataFrame, group_cols: list[str], order_col: str, rows: int = BUCKET_ROWS, start: int = 3,
                  most: int = 32) -> int:
    """Least prefix of the order column whose largest (group, prefix) bucket has at most ``rows`` rows.

    One aggregate for each length that is tried; a bucket of one repeated value can't be
    split and ends the search.
    """
    length = start
    while length < most:
        c = F.col(order_col)
        largest = (df.groupBy(*group_cols, F.substring(c, 1, length).alias("__p"))
                   .agg(F.count(F.lit(1)).alias("n"), (F.min(c) < F.max(c)).alias("more"))
                   .where("more").agg(F.max("n")).first()[0])
        if (largest or 0) <= rows:
            break
        length += max(1, math.ceil(math.log(largest / rows, 16)))
    return min(length, most)


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the key columns come from ``a``."""
    other = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(other[f"__r_{k}"]) for k in keys])
    return a.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def exact_rank(df: DataFrame, group_cols: list[str], order_col: str, id_col: str,
               rank_col: str = "rank", digits: int | None = None, with_counts: bool = False):
    """1-based rank of each row within ``group_cols`` ordered by (order_col, id_col).

    ``order_col`` must be a string (``hash_order`` spreads evenly). Rows with a null group
    form a group of their own. Cost: an aggregate for the prefix length unless ``digits``
    gives it, one histogram aggregate and one shuffle of the rows on (group, bucket).
    """
    b = "__bucket"
    digits = digits or prefix_length(df, group_cols, order_col)
    with_b = df.withColumn(b, F.substring(F.col(order_col), 1, digits))
    hist = with_b.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = (Window.partitionBy(*group_cols).orderBy(b)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = hist.select(*group_cols, b,
                          F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    joined = null_safe(with_b, offsets, [*group_cols, b])
    w_loc = Window.partitionBy(*group_cols, b).orderBy(F.col(order_col), F.col(id_col))
    ranked = (joined.withColumn(rank_col, F.col("__off") + F.row_number().over(w_loc))
                    .drop(b, "__off"))
    if with_counts:
        # group sizes from the same histogram (the exchange is reused in one plan)
        return ranked, hist.groupBy(*group_cols).agg(F.sum("__n").alias("n"))
    return ranked


def exact_rank_global(df: DataFrame, order_col: str, id_col: str,
                      rank_col: str = "rank", digits: int | None = None) -> DataFrame:
    """Global variant of ``exact_rank`` (one implicit group)."""
    g = "__g"
    return exact_rank(df.withColumn(g, F.lit(0)), [g], order_col, id_col,
                      rank_col, digits).drop(g)


def range_bucket(value: Column, cuts: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` (an array of at most ``most``) are below ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda a, k: F.when(
        F.coalesce(F.get(cuts, a + k - 1) < value, F.lit(False)), a + k).otherwise(a))
