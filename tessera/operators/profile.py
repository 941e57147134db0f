"""Aggregation, profiling and EDA operators (AG1-AG23).

Each function is a DataFrame -> DataFrame transform. Multi-column profiles are
computed in one pass: columns are unpivoted into (column, value) rows (a narrow
``stack``) and aggregated together, so a 31-column profile is one scan and one
small shuffle, not 31 jobs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exact import isclose, pct_1dp
from tessera.functions.ordering import exact_rank, null_safe
from tessera.functions.quantiles import exact_quantiles


def _long(df: DataFrame, cols: list[str], as_type: str = "string") -> DataFrame:
    """(column, value) rows for the given columns; one narrow projection."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(as_type).alias("value"))
        for c in cols]))
    return df.select(stacked.alias("kv")).select("kv.column_name", "kv.value")


# ---------------------------------------------------------------- AG1 / AG2
def value_counts(df: DataFrame, cols: list[str], normalize: bool = False) -> DataFrame:
    """AG1/AG2: per column, count (and share) of each value; one pass for all columns.

    Output: column_name, value, count[, share], rank (1 = most frequent; ties -> value,
    nulls last). The rank never sorts a whole column in one task: values with a
    higher count are counted from a (column, count) histogram, and ties inside one
    count are ranked with prefix-bucketed exact ranks.
    """
    counts = _long(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    out = counts
    if normalize:
        out = out.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("column_name")))
    # values with a strictly higher count (distinct counts per column are few)
    cc = counts.groupBy("column_name", "count").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    cc = cc.select("column_name", "count", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("__above"))
    # tie order by value, nulls last: order key = '1'+value, or '2' for null
    key = F.when(F.col("value").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("value")))
    ranked = exact_rank(out.withColumn("__k", key), ["column_name", "count"], "__k", "__k", "__r")
    return (ranked.join(cc, ["column_name", "count"])
                  .withColumn("rank", F.col("__above") + F.col("__r")).drop("__k", "__r", "__above"))


# ---------------------------------------------------------------- AG3
def conditional_distribution(df: DataFrame, by: str, target: str) -> DataFrame:
    """AG3: share of each target value inside each category of ``by``."""
    c = df.groupBy(by, target).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(by)))


# ---------------------------------------------------------------- AG4
def class_distribution(df: DataFrame, target: str, classes: list[str]) -> DataFrame:
    """AG4: every class in code order with count and one-decimal percent; absent -> 0."""
    spark = df.sparkSession
    cls = spark.createDataFrame([(i, c) for i, c in enumerate(classes)],
                                "code int, class_name string")
    counts = df.groupBy(F.col(target).alias("class_name")).agg(F.count(F.lit(1)).alias("count"))
    j = cls.join(counts, "class_name", "left")
    w = Window.partitionBy(F.lit(1))  # over the class table only (|classes| rows)
    j = j.withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))
    j = j.withColumn("total", F.sum("count").over(w))
    return j.select("code", "class_name", "count",
                    pct_1dp(F.col("count"), F.col("total")).alias("percent"))


# ---------------------------------------------------------------- AG5
def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG5: count, mean, sample std, min, quartiles (linear), max per column.

    Moments come from one aggregate over the unpivoted columns; quartiles from
    ``exact_quantiles`` (exact, no single-task group).
    """
    lf = _long(df, cols, "double")
    mom = lf.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(lf, "value", [0.25, 0.5, 0.75], ["column_name"])
    qw = q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q75"))
    return mom.join(qw, "column_name", "left").select("column_name", "count", "mean", "std", "min",
                                                  "q25", "q50", "q75", "max")


# ---------------------------------------------------------------- AG6-AG9
def column_checks(df: DataFrame, cols: list[str], threshold: float = 50.0) -> DataFrame:
    """AG6-AG9: per column null, NaN, zero and below-threshold counts (one scan).

    NaN / zero / below counts apply to numeric columns; others report 0 / null.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [
            F.sum(x.isNull().cast("long")).alias(f"{c}__null"),
            (F.sum(F.isnan(x).cast("long")) if c in numeric else F.lit(0).cast("long")).alias(f"{c}__nan"),
            (F.sum((x == 0).cast("long")) if c in numeric else F.lit(None).cast("long")).alias(f"{c}__zero"),
            (F.sum((x < threshold).cast("long")) if c in numeric else F.lit(None).cast("long")).alias(f"{c}__below"),
        ]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(F.col(f"{c}__null"), F.lit(0)).alias("null_count"),
                 F.coalesce(F.col(f"{c}__nan"), F.lit(0)).alias("nan_count"),
                 F.col(f"{c}__zero").alias("zero_count"),
                 F.col(f"{c}__below").alias("below_count"))
        for c in cols]))
    return wide.select(rows.alias("r")).select("r.*")


# ---------------------------------------------------------------- AG10
def shape_and_types(df: DataFrame) -> DataFrame:
    """AG10: one row per column: position, name, type, non-null count, total rows."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(f.name)).alias(f"__nn{i}")
                                                  for i, f in enumerate(df.schema.fields)]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.col(f"__nn{i}").alias("non_null"), F.col("__rows").alias("rows"))
        for i, f in enumerate(df.schema.fields)]))
    return wide.select(rows.alias("r")).select("r.*")


# ---------------------------------------------------------------- AG11
def duplicate_rows(df: DataFrame, cols: list[str] | None = None,
                   chunk: int = 100_000) -> DataFrame:
    """AG11: second and later copies of identical rows (over ``cols``).

    Identical rows are counted with a partial aggregation, so a hot duplicate
    collapses map-side. The copies-1 extra rows are regenerated in two levels
    (chunks of ``chunk`` rows, repartitioned, then expanded) so no single task
    builds one huge array. Output: the row columns, ``copies`` and ``copy_no`` >= 2.
    """
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    n_chunks = F.floor((F.col("copies") - 2) / chunk).cast("int")
    chunks = g.select(*cols, "copies",
                      F.explode(F.sequence(F.lit(0), n_chunks)).alias("__chunk"))
    chunks = chunks.repartition(F.xxhash64(*cols, "__chunk"))
    lo = F.col("__chunk") * chunk + 2
    hi = F.least(lo + chunk - 1, F.col("copies")).cast("long")
    return chunks.select(*cols, "copies",
                         F.explode(F.sequence(lo.cast("long"), hi)).alias("copy_no"))


# ---------------------------------------------------------------- AG12
def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG12: Pearson correlation of every column pair (pairwise-complete), long form.

    One aggregate with three moments per unordered pair; mirrored afterwards. A constant
    column has no correlation: null, with itself too.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        if a == b:
            return F.when(spread > 0, F.lit(1.0))
        return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))
    wide = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = []
    for i, (a, b) in enumerate(pairs):
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"c{i}").alias("corr")))
    return wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")


# ---------------------------------------------------------------- AG13-AG15
def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG13: mean per column (long form)."""
    return _long(df, cols, "double").groupBy("column_name").agg(F.avg("value").alias("mean"))


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG14: most frequent value per column; ties -> smallest value.

    Counts per (column, value) with partial aggregation, then a top-1 per column
    (a hot value collapses map-side; no group is held in one task).
    """
    lf = _long(df, cols, "double").where(F.col("value").isNotNull())
    c = lf.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("column_name").agg(
        F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG15: exact median per column."""
    q = exact_quantiles(_long(df, cols, "double"), "value", [0.5], ["column_name"])
    return q.select("column_name", F.col("value").alias("median"))


# ---------------------------------------------------------------- AG20
def integer_only(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG20: does the column hold only (close to) integers -> input step 1 else 0.1."""
    lf = _long(df, cols, "double").where(F.col("value").isNotNull())
    r = lf.groupBy("column_name").agg(
        F.bool_and(isclose(F.col("value"), F.rint("value"))).alias("integer_only"))
    return r.withColumn("step", F.when(F.col("integer_only"), F.lit(1.0)).otherwise(F.lit(0.1)))


# ---------------------------------------------------------------- AG21
def box_stats(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """AG21: per (column, class): quartiles, 1.5*IQR whiskers (most extreme data
    points inside the fences), outlier count, n."""
    lf = df.select(F.col(by).alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv")
    ).select("grp", "kv.column_name", "kv.value").where(F.col("value").isNotNull())
    q = exact_quantiles(lf, "value", [0.25, 0.5, 0.75], ["column_name", "grp"])
    qw = q.groupBy("column_name", "grp").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    qw = qw.withColumn("iqr", F.col("q3") - F.col("q1"))
    fence_lo = F.col("q1") - 1.5 * F.col("iqr")
    fence_hi = F.col("q3") + 1.5 * F.col("iqr")
    # stats table is (columns x classes) rows: broadcast-sized by construction
    j = null_safe(lf, F.broadcast(qw), ["column_name", "grp"])
    inside = (F.col("value") >= fence_lo) & (F.col("value") <= fence_hi)
    agg = j.groupBy("column_name", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("outliers"))
    return null_safe(qw, agg, ["column_name", "grp"]).withColumnRenamed("grp", by)


# ---------------------------------------------------------------- AG22 / AG23
def histogram(df: DataFrame, col: str, bins: int | None = 30) -> DataFrame:
    """AG22 (numeric): equal-width bins over [min, max]; the max falls in the last bin.

    Output: bin, lo, hi, count; empty bins have count 0. Strings use ``value_counts``;
    binary columns use bins=2; ``bins=None`` chooses Sturges' number, 1 + ceil(log2 n). The
    one-row range is read first and inlined as literals.
    """
    x = F.col(col).cast("double")
    base = df.select(x.alias("x")).where(F.col("x").isNotNull())
    r = base.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n")).first()
    if r["mn"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    bins = bins or 1 + (r["n"] - 1).bit_length()
    mn, mx = float(r["mn"]), float(r["mx"])
    w = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(mn)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    h = base.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = every.join(h, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    return h.select("bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("hi"), "count")


#: Terms of a cell's expansion, half a cell in units of sqrt(2) bandwidths, and how many bandwidths a kernel reaches.
KDE_TERMS, KDE_HALF, KDE_REACH = 16, 0.25, 8.0


def kde_error(terms: int = KDE_TERMS, half: float = KDE_HALF, reach: float = KDE_REACH) -> float:
    """Bound on the error of a point's kernel, whose greatest value is 1: the expansion's rest and what is out of reach."""
    a = half * math.sqrt(2.0)
    rest = sum(1.09 * a**n / math.sqrt(math.factorial(n)) for n in range(terms, terms + 60))
    return rest + math.exp(-0.5 * (reach - 2 * a) ** 2)


def kde_curve(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """AG23: Gaussian KDE (Scott bandwidth) on ``grid`` points, over all points of the column.

    bw = std_sample * n^(-1/5); grid spans [min - cut*bw, max + cut*bw]; density(g) =
    sum over points of phi((g - x)/bw) / (n * bw).

    Points are summed up in cells a fraction of a bandwidth wide: a cell keeps
    ``KDE_TERMS`` moments of its points about its centre, which are the coefficients of a
    truncated Hermite expansion of the sum of their kernels. A cell meets only grid points
    within ``KDE_REACH`` bandwidths. Each kernel is off by ``kde_error()`` at most (about
    1e-12), so a density is by that over bw * sqrt(2 pi). One aggregate over the points,
    one over occupied cells; no point meets the grid.
    """
    x = F.col(col).cast("double")
    base = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    st = base.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"),
                  F.stddev_samp("x").alias("sd")).first()
    if not st["n"] or st["n"] < 2 or not st["sd"]:
        return df.sparkSession.createDataFrame([], "gi int, gx double, density double")
    n, mn, mx, sd = int(st["n"]), float(st["mn"]), float(st["mx"]), float(st["sd"])
    bw = sd * n ** -0.2
    scale = math.sqrt(2.0) * bw
    width = 2 * KDE_HALF * scale
    cell = F.floor((F.col("x") - F.lit(mn)) / F.lit(width))
    centre = F.lit(mn) + (F.col("cell") + 0.5) * F.lit(width)
    u = (F.col("x") - centre) / F.lit(scale)
    moments = (base.withColumn("cell", cell).withColumn("u", u).groupBy("cell")
               .agg(*[(F.sum(F.pow("u", F.lit(float(j)))) / math.factorial(j)).alias(f"m{j}") for j in range(KDE_TERMS)]))
    g0 = mn - cut * bw
    step = (mx - mn + 2 * cut * bw) / (grid - 1)
    reach = KDE_REACH * bw
    first = F.greatest(F.ceil((centre - F.lit(reach + g0)) / F.lit(step)), F.lit(0)).cast("int")
    last = F.least(F.floor((centre + F.lit(reach - g0)) / F.lit(step)), F.lit(grid - 1)).cast("int")
    e = moments.select(centre.alias("centre"), F.array(*[f"m{j}" for j in range(KDE_TERMS)]).alias("m"),
                       F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("gi"))
    e = e.withColumn("t", (F.lit(g0) + F.col("gi") * F.lit(step) - F.col("centre")) / F.lit(scale))
    # Hermite functions by their recurrence: h(j + 1) = 2 t h(j) - 2 j h(j - 1)
    t = F.col("t")
    zero = F.lit(0.0)
    start = F.struct(zero.alias("before"), F.exp(-t * t).alias("h"), zero.alias("total"), F.lit(0).alias("j"))
    k = F.aggregate("m", start, lambda a, m: F.struct(
        a["h"].alias("before"), (2.0 * t * a["h"] - 2.0 * a["j"] * a["before"]).alias("h"),
        (a["total"] + m * a["h"]).alias("total"), (a["j"] + 1).alias("j")), lambda a: a["total"])
    found = e.groupBy("gi").agg(F.sum(k).alias("k"))
    norm = n * bw * (2 * math.pi) ** 0.5
    every = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("gi"))
    return every.join(F.broadcast(found), "gi", "left").select(
        "gi", (F.lit(g0) + F.col("gi") * F.lit(step)).alias("gx"), (F.coalesce("k", F.lit(0.0)) / F.lit(norm)).alias("density"))
