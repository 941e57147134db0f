"""Sampling, splitting and resampling (SM1-SM4; SMOTENC lives in smotenc.py).

All draws are hash-ordered (``functions.ordering``): reproducible across runs,
partitionings and engines, and exact in size (unlike Bernoulli ``sampleBy``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import exact_rank, exact_rank_global, hash_order, null_safe, prefix_length


def _group_quotas_train_first(counts: DataFrame, key: str, test_size: float) -> DataFrame:
    """Per-group test quota for a stratified split of ``sum(n)`` rows.

    n_test = ceil(test_size * N). The train side is allocated first:
    floor(n_train * n_g / N) per group, the leftover rows go to the largest
    remainders (ties -> group key ascending). Test quota = n_g - train quota.
    All integer arithmetic; the input is one row per group.
    """
    w_all = Window.partitionBy(F.lit(1))  # group table only: one row per class
    c = (counts.withColumn("__N", F.sum("n").over(w_all))
               .withColumn("__ntest", F.ceil(F.lit(float(test_size)) * F.col("__N")).cast("long"))
               .withColumn("__ntrain", F.col("__N") - F.col("__ntest"))
               .withColumn("__prod", F.col("__ntrain") * F.col("n"))
               .withColumn("__floor", F.floor(F.col("__prod") / F.col("__N")).cast("long"))
               .withColumn("__rem", F.col("__prod") - F.col("__floor") * F.col("__N")))
    c = c.withColumn("__left", F.col("__ntrain") - F.sum("__floor").over(w_all))
    w_rem = Window.partitionBy(F.lit(1)).orderBy(F.desc("__rem"), F.asc(key))
    c = c.withColumn("__extra", (F.row_number().over(w_rem) <= F.col("__left")).cast("long"))
    return c.select(key, "n", (F.col("n") - F.col("__floor") - F.col("__extra")).alias("test_quota"))


def stratified_split(df: DataFrame, target: str, id_col: str, test_size: float = 0.2,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """SM1: exact stratified train/test split; adds ``split`` = 'train' | 'test'.

    Per class the first test_quota rows in hash order go to test. Class proportions
    are preserved to within one row; no class is ever sorted in one task. Rows without a
    class are a class of their own, so every row comes out.

    Only the last row that goes to test is looked for in each class: counts by prefix of the
    hash say which prefix has it, and only rows of that prefix (ids and hashes) are sorted.
    The split is then a comparison with one row a class; the rows themselves are not shuffled.
    """
    hashed = df.withColumn("__h", hash_order(id_col, seed))
    narrow = hashed.select(target, F.col(id_col).alias("__id"), "__h")
    digits = prefix_length(narrow, [target], "__h")
    hist = narrow.groupBy(target, F.substring("__h", 1, digits).alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    quotas = _group_quotas_train_first(hist.groupBy(target).agg(F.sum("n").alias("n")), target, test_size).select(target, "test_quota")
    before = Window.partitionBy(target).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    places = hist.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    need = F.col("test_quota") - F.col("__before")
    spot = null_safe(places, quotas, [target]).where((need > 0) & (need <= F.col("n"))).select(target, "__b", need.alias("__need"))
    near = null_safe(narrow.withColumn("__b", F.substring("__h", 1, digits)), F.broadcast(spot), [target, "__b"])  # a row a class
    order = Window.partitionBy(target).orderBy("__h", "__id")
    cut = near.withColumn("__r", F.row_number().over(order)).where("__r = __need").select(
        target, F.struct("__h", "__id").alias("__cut"))
    out = null_safe(hashed, F.broadcast(cut), [target], "left")
    test = F.struct(F.col("__h"), F.col(id_col).alias("__id")) <= F.col("__cut")
    return out.withColumn(split_col, F.when(test, "test").otherwise("train")).drop("__h", "__cut")


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """SM2: n rows in hash order; the whole frame when n <= 0 or n >= rows.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (per-partition top-n,
    then a merge of n per partition): no full sort, no single-task group.
    """
    if n is None or n <= 0:
        return df
    h = hash_order(id_col, seed)
    return df.withColumn("__h", h).orderBy("__h", id_col).limit(n).drop("__h")


def proportional_group_sample(df: DataFrame, group_col: str, id_col: str,
                              max_points: int, seed: int = 42,
                              flag_col: str = "sampled") -> DataFrame:
    """SM3: proportional per-group sample capped at ``max_points`` rows.

    If rows <= max_points, all rows are kept and ``sampled`` is false. Otherwise per
    group quota = min(n_g, max(1, round(n_g * max_points / N))) in hash order; if
    the union still exceeds the cap, the first max_points in a second hash order
    are kept. ``round`` is half-to-even, like Python's.
    """
    counts = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy(F.lit(1))
    q = counts.withColumn("__N", F.sum("n").over(w_all))
    ratio = F.lit(float(max_points)) / F.col("__N")
    q = q.withColumn("quota", F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.col("n") * ratio, 0).cast("long"))))
    q = q.withColumn("__over", F.col("__N") > F.lit(max_points))
    ranked = exact_rank(df.withColumn("__h", hash_order(id_col, seed)), [group_col], "__h", id_col,
                        rank_col="__rank")
    j = null_safe(ranked, q.select(group_col, "quota", "__over"), [group_col])
    keep = j.where((~F.col("__over")) | (F.col("__rank") <= F.col("quota")))
    keep = keep.withColumn(flag_col, F.col("__over")).drop("__h", "__rank", "quota", "__over")
    # second pass: global cap in a second hash order (seed+1)
    ranked2 = exact_rank_global(keep.withColumn("__h2", hash_order(id_col, seed + 1)), "__h2",
                                id_col, rank_col="__r2")
    return ranked2.where(F.col("__r2") <= F.lit(max_points)).drop("__h2", "__r2")


def stratified_folds(df: DataFrame, target: str, id_col: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """SM4: stratified k-fold assignment: fold = (rank - 1) % k within class, hash order."""
    ranked = exact_rank(df.withColumn("__h", hash_order(id_col, seed)), [target], "__h", id_col,
                        rank_col="__rank")
    return ranked.withColumn(fold_col, ((F.col("__rank") - 1) % k).cast("int")).drop("__h", "__rank")
