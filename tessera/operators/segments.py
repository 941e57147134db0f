"""Segmentation: Lloyd steps, PCA map, cluster profiles and naming
(ML6, FE9, FE10, AG16, AG17, SG1-SG7, WN1, WN2, ME14).

Row-level work is column arithmetic against k literal centroids (k x d numbers on
the driver, like a fitted Spark ML model); profiles and naming run on k-row
tables.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exact import isclose, pct_1dp
from tessera.operators.models import assemble


# ---------------------------------------------------------------- ML6
def _sqdist(xs: list[Column], c: list[float]) -> Column:
    d = None
    for x, v in zip(xs, c):
        t = (x - F.lit(float(v))) * (x - F.lit(float(v)))
        d = t if d is None else d + t
    return d


def assign_clusters(df: DataFrame, features: list[str], centroids: list[list[float]],
                    out_col: str = "cluster") -> DataFrame:
    """ML6/SG7: nearest centroid by squared Euclidean distance; ties -> lower id."""
    xs = [F.col(f) for f in features]
    d = F.array(*[_sqdist(xs, c) for c in centroids])
    pos = F.array_position(d, F.array_min(d)) - 1
    return df.withColumn(out_col, pos.cast("int"))


def recompute_centroids(assigned: DataFrame, features: list[str], k: int,
                        old: list[list[float]], cluster_col: str = "cluster") -> list[list[float]]:
    """ML6: mean of the members (one partial aggregate, k rows back); empty keeps old."""
    rows = assigned.groupBy(cluster_col).agg(*[F.avg(f).alias(f) for f in features]).collect()
    new = [list(c) for c in old]
    for r in rows:
        new[r[cluster_col]] = [float(r[f]) for f in features]
    return new


def lloyd(df: DataFrame, features: list[str], init: list[list[float]], steps: int = 1):
    """``steps`` assign+update rounds from fixed centroids; returns (centroids, assigned)."""
    cents = init
    for _ in range(steps):
        a = assign_clusters(df, features, cents)
        cents = recompute_centroids(a, features, len(init), cents)
    return cents, assign_clusters(df, features, cents)


def first_rows_as_centroids(df: DataFrame, features: list[str], id_col: str, k: int) -> list[list[float]]:
    """Initial centroids = the k rows with the lowest id (TakeOrdered, k rows)."""
    rows = df.orderBy(id_col).select(*features).limit(k).collect()
    return [[float(r[f]) for f in features] for r in rows]


# ---------------------------------------------------------------- AG16 / AG17 / SG3
def np_round(c: Column, digits: int) -> Column:
    """NumPy/pandas ``round``: rint(x * 10^d) / 10^d (half-to-even on the scaled double)."""
    s = float(10 ** digits)
    return F.rint(c * F.lit(s)) / F.lit(s)


def cluster_profiles(df: DataFrame, cols: list[str], cluster_col: str = "cluster") -> DataFrame:
    """AG16: per cluster the mean of each profile column rounded to 2, plus size."""
    if not cols:
        raise ValueError("no cluster profile columns were found")
    return df.groupBy(cluster_col).agg(*[np_round(F.avg(c), 2).alias(c) for c in cols],
                                       F.count(F.lit(1)).alias("cluster_size"))


def cluster_shares(assigned: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """AG17/SG3: cluster size and one-decimal percent share."""
    c = assigned.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("cluster_size"))
    w = Window.partitionBy(F.lit(1))  # k rows
    return c.withColumn("percent", pct_1dp(F.col("cluster_size"), F.sum("cluster_size").over(w)))


# ---------------------------------------------------------------- WN1 / WN2 / SG1
def dense_ranks(profiles: DataFrame, directions: list[tuple[str, bool]],
                cluster_col: str = "cluster", prefix: str = "rank_") -> DataFrame:
    """WN1: dense rank per metric (higher_is_better -> descending) over the k-row table."""
    out = profiles
    for c, desc in directions:
        o = F.desc(c) if desc else F.asc(c)
        out = out.withColumn(prefix + c, F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(o)))
    return out


def argmin_rank_sum(ranked: DataFrame, cols: list[str], cluster_col: str = "cluster") -> DataFrame:
    """WN2: rank sum per cluster and the arg-min (first cluster id on ties)."""
    s = None
    for c in cols:
        s = F.col(c) if s is None else s + F.col(c)
    r = ranked.withColumn("rank_sum", s)
    best = r.agg(F.min_by(cluster_col, F.struct("rank_sum", cluster_col)).alias("best"))
    return r, best


def segment_keys(profiles: DataFrame, profile: list[tuple[str, bool]], names: tuple[str, str, str],
                 cluster_col: str = "cluster") -> DataFrame:
    """SG1: ``names`` = (best, risk, other). Best has the lowest rank sum over all columns;
    of the rest, risk has the lowest sum of descending ranks of the last two (risk) columns."""
    missing = [c for c, _ in profile if c not in profiles.columns]
    if missing:
        return profiles.sparkSession.createDataFrame([], f"{cluster_col} int, segment_key string, "
                                                        "health_rank_sum int, risk_rank_sum int")
    r1 = dense_ranks(profiles, [(c, hib) for c, hib in profile], cluster_col, "h_")
    r1, best1 = argmin_rank_sum(r1, ["h_" + c for c, _ in profile], cluster_col)
    r1 = r1.withColumnRenamed("rank_sum", "health_rank_sum")
    rest = r1.join(best1, F.col(cluster_col) == F.col("best"), "left_anti")
    risk = [c for c, _ in profile][-2:]
    r2 = dense_ranks(rest, [(c, True) for c in risk], cluster_col, "g_")
    r2, best2 = argmin_rank_sum(r2, ["g_" + c for c in risk], cluster_col)
    r2 = r2.select(cluster_col, F.col("rank_sum").alias("risk_rank_sum"))
    out = (r1.join(r2, cluster_col, "left")
             .join(best1, F.col(cluster_col) == F.col("best"), "left").withColumnRenamed("best", "b1")
             .join(best2, F.col(cluster_col) == F.col("best"), "left").withColumnRenamed("best", "b2"))
    key = F.when(F.col("b1").isNotNull(), names[0]).when(F.col("b2").isNotNull(), names[1]).otherwise(names[2])
    # risk_rank_sum is 0 for the best cluster (not ranked again)
    return out.select(cluster_col, key.alias("segment_key"), "health_rank_sum",
                      F.coalesce("risk_rank_sum", F.lit(0)).alias("risk_rank_sum"))


def segment_display(keys: DataFrame, labels: dict[str, str], colors: dict[str, str],
                    cluster_col: str = "cluster") -> DataFrame:
    """SG2: display name (fallback ``Cluster {id}``) and colour (fallback ``colors['unknown']``)."""
    names = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    cols = F.create_map(*[x for k, v in colors.items() for x in (F.lit(k), F.lit(v))])
    fallback = F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"))
    return keys.select(cluster_col, "segment_key",
                       F.coalesce(names[F.col("segment_key")], fallback).alias("cluster_name"),
                       F.coalesce(cols[F.col("segment_key")], F.lit(colors["unknown"])).alias("color"))


def describe_position(value: Column, baseline: Column) -> Column:
    """SG5: 'relative position not available' / 'around' / 'above' / 'below' the
    training median (the direction flag does not change the words)."""
    return (F.when(value.isNull() | baseline.isNull() | F.isnan(value) | F.isnan(baseline),
                   F.lit("relative position not available"))
             .when(isclose(value, baseline), F.lit("around the training median"))
             .when(value > baseline, F.lit("above the training median"))
             .otherwise(F.lit("below the training median")))


# ---------------------------------------------------------------- ME14
def silhouette_sq(df: DataFrame, features: list[str], cluster_col: str = "cluster") -> DataFrame:
    """ME14: exact silhouette with squared Euclidean distance in O(n*k*d).

    Per cluster c: n_c, S_c = sum x, Q_c = sum |x|^2 (k rows to the driver). Then
    sum_j |x_i - x_j|^2 over c = n_c|x_i|^2 - 2 x_i.S_c + Q_c: a(i) uses the own
    cluster / (n_c - 1), b(i) the minimum mean over other clusters. Singleton -> 0.
    No pairs are formed. Features are centred first, so points far from the origin lose no
    digits; where both distances are 0 the value is 0. Output: one row per point (id kept)
    with ``silhouette``.
    """
    mean = df.agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)]).first()
    kept = df.columns
    df = df.select("*", *[(F.col(f) - F.lit(float(mean[f"m_{i}"] or 0.0))).alias(f"__c_{i}") for i, f in enumerate(features)])
    features = [f"__c_{i}" for i in range(len(features))]
    st = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.sum(f).alias(f"s_{i}") for i, f in enumerate(features)],
                                     F.sum(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))).alias("q")
                                     ).collect()
    st = sorted(st, key=lambda r: r[cluster_col])
    xx = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    own_sum = None
    others = []
    for r in st:
        dot = sum((F.col(f) * F.lit(float(r[f"s_{i}"])) for i, f in enumerate(features)), F.lit(0.0))
        total = F.lit(float(r["n"])) * xx - F.lit(2.0) * dot + F.lit(float(r["q"]))
        is_own = F.col(cluster_col) == F.lit(r[cluster_col])
        own_sum = F.when(is_own, total / F.lit(float(max(r["n"] - 1, 1)))) if own_sum is None else \
            own_sum.when(is_own, total / F.lit(float(max(r["n"] - 1, 1))))
        others.append(F.when(~is_own, total / F.lit(float(r["n"]))))
    sizes = F.create_map(*[x for r in st for x in (F.lit(r[cluster_col]), F.lit(r["n"]))])
    a = own_sum
    b = F.array_min(F.filter(F.array(*others), lambda v: v.isNotNull())) if len(st) > 1 else F.lit(None)
    out = df.withColumn("__a", a).withColumn("__b", b)
    s = F.when(sizes[F.col(cluster_col)] <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest(F.col("__a"), F.col("__b"))), F.lit(0.0)))
    return out.withColumn("silhouette", s).select(*kept, "silhouette")


# ---------------------------------------------------------------- FE9 / FE10 / SG4
def fit_pca(df: DataFrame, features: list[str], k: int = 2):
    """FE9: PCA on (already centred or centre-here) features.

    Spark's PCA model does not mean-centre in ``transform``; centring is applied
    explicitly. Components get a deterministic sign (largest |loading| positive).
    Returns (components as list of lists, explained variance ratio, means).
    """
    means_row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    means = [float(means_row[f]) for f in features]
    centred = df.select(*[(F.col(f) - F.lit(m)).alias(f) for f, m in zip(features, means)])
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(assemble(centred, features))
    pc = model.pc.toArray()  # d x k
    comps = []
    for j in range(k):
        col = [float(pc[i, j]) for i in range(len(features))]
        big = max(range(len(col)), key=lambda i: abs(col[i]))
        if col[big] < 0:
            col = [-v for v in col]
        comps.append(col)
    return comps, [float(v) for v in model.explainedVariance.toArray()], means


def project(df: DataFrame, features: list[str], comps: list[list[float]], means: list[float],
            prefix: str = "pc") -> DataFrame:
    """FE9/FE10: coordinates on the fitted components (rows or centroids alike)."""
    out = df
    for j, comp in enumerate(comps):
        e = sum(((F.col(f) - F.lit(m)) * F.lit(w) for f, m, w in zip(features, means, comp)), F.lit(0.0))
        out = out.withColumn(f"{prefix}{j + 1}", e)
    return out


# ---------------------------------------------------------------- SG6
def cluster_meaning(profiles: DataFrame, keys: DataFrame, baselines: dict[str, float],
                    labels: list[tuple[str, str, str, int]], summaries: dict[str, str],
                    summary_default: str, intro: str, size_text: str,
                    cluster_col: str = "cluster") -> DataFrame:
    """SG6: per cluster a summary (by segment key, with default) and detail sentences:
    the intro, the size sentence ({n} with thousands separators), then one sentence
    per profile column: '<prefix> <value>[ unit], which is <position> compared with
    the training median of <baseline>.' ``labels`` = (column, prefix, unit, decimals)."""
    from tessera.functions.scalar import fixed
    j = profiles.join(keys.select(cluster_col, "segment_key"), cluster_col, "left")
    smap = F.create_map(*[x for k, v in summaries.items() for x in (F.lit(k), F.lit(v))])
    pre, _, post = size_text.partition("{n}")
    details = [F.lit(intro),
               F.concat(F.lit(pre), F.format_number(F.col("cluster_size").cast("long"), 0), F.lit(post))]
    for c, prefix, unit, d in labels:
        b = F.lit(float(baselines[c]))
        details.append(F.concat(F.lit(prefix + " "), fixed(F.col(c), d), F.lit(unit), F.lit(", which is "),
                                describe_position(F.col(c), b), F.lit(" compared with the training median of "),
                                fixed(b, d), F.lit(".")))
    return j.select(cluster_col, F.coalesce(smap[F.col("segment_key")], F.lit(summary_default)).alias("summary"),
                    F.array(*details).alias("details"))
