"""Exact quantiles (linear interpolation, as pandas/NumPy) without one-task groups.

Spark's exact ``percentile`` aggregate merges every distinct value of a group in
one task; at 100 TB a global median would be a single-task job. Here each
requested order statistic is located by histogram refinement:

1. per group: n, min, max (partial aggregation);
2. each target rank keeps an interval [lo, hi] and the count of rows below lo;
   one pass buckets the rows inside the interval into ``bins`` equal-width
   buckets (count, min, max per bucket; partial aggregation), a window over the
   small histogram picks the bucket holding the rank, and the interval shrinks to
   that bucket's observed [min, max];
3. once an interval holds <= ``max_final`` rows, those rows are ranked exactly.

Each pass is one scan plus a shuffle of at most targets x bins rows. Only the
per-target interval rows (targets are groups x requested ranks) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import null_safe


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] | None = None, bins: int = 1024,
                    max_final: int = 200_000) -> DataFrame:
    """Rows: group cols, ``prob``, ``value`` (none for empty groups). Rows with a null group
    are a group of their own. Intervals shrink until each holds at most ``max_final`` rows
    or one value; the number of passes follows the data."""
    spark = df.sparkSession
    x = F.col(value_col).cast("double")
    base = df.select(*(group_cols or [F.lit(0).alias("__all")]), x.alias("__x"))
    base = base.where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    g = list(group_cols or ["__all"])
    stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"),
                                 F.max("__x").alias("hi")).collect()
    # targets: (tid, group..., k, lo, hi, below, cnt)
    targets = []
    wanted = []  # (group tuple, prob, tid_a, tid_b, frac)
    tid = 0
    index = {}
    for r in stats:
        key = tuple(r[c] for c in g)
        n = r["n"]
        for p in probs:
            h = (n - 1) * p
            k0 = int(math.floor(h))
            k1 = min(k0 + 1, n - 1)
            ids = []
            for k in (k0, k1):
                if (key, k) not in index:
                    index[(key, k)] = tid
                    targets.append({"tid": tid, "key": key, "k": k, "lo": r["lo"], "hi": r["hi"],
                                    "below": 0, "cnt": n, "value": None})
                    tid += 1
                ids.append(index[(key, k)])
            wanted.append((key, p, ids[0], ids[1], h - k0))

    def tgt_frame(ts):
        rows = [(t["tid"], *t["key"], float(t["lo"]), float(t["hi"])) for t in ts]
        schema_g = [(c, base.schema[c].dataType.simpleString()) for c in g]
        schema = ", ".join(["tid long"] + [f"`{c}` {tp}" for c, tp in schema_g] + ["lo double", "hi double"])
        return spark.createDataFrame(rows, schema)

    while True:
        open_ = [t for t in targets if t["value"] is None and t["lo"] < t["hi"] and t["cnt"] > max_final]
        for t in targets:
            if t["value"] is None and t["lo"] == t["hi"]:
                t["value"] = t["lo"]
        if not open_:
            break
        tf = F.broadcast(tgt_frame(open_))  # groups x ranks rows
        j = null_safe(base, tf, g)
        j = j.where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
        width = (F.col("hi") - F.col("lo")) / F.lit(bins)
        b = F.least(F.floor((F.col("__x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
        hist = j.groupBy("tid", b.alias("b")).agg(F.count(F.lit(1)).alias("c"),
                                                  F.min("__x").alias("bmin"), F.max("__x").alias("bmax"))
        w = Window.partitionBy("tid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("cum", F.sum("c").over(w))
        need = spark.createDataFrame([(t["tid"], t["k"] - t["below"]) for t in open_], "tid long, need long")
        pick = (hist.join(F.broadcast(need), "tid")
                    .where((F.col("cum") - F.col("c") <= F.col("need")) & (F.col("need") < F.col("cum")))
                    .select("tid", "c", "bmin", "bmax", (F.col("cum") - F.col("c")).alias("before"))
                    .collect())
        by = {t["tid"]: t for t in targets}
        for r in pick:
            t = by[r["tid"]]
            t["below"] += r["before"]
            t["lo"], t["hi"], t["cnt"] = r["bmin"], r["bmax"], r["c"]
    # final exact ranking inside small intervals
    rest = [t for t in targets if t["value"] is None]
    for t in rest:
        if t["lo"] == t["hi"]:
            t["value"] = t["lo"]
    rest = [t for t in rest if t["value"] is None]
    if rest:
        tf = F.broadcast(tgt_frame(rest))
        j = null_safe(base, tf, g)
        j = j.where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
        w = Window.partitionBy("tid").orderBy("__x")
        need = spark.createDataFrame([(t["tid"], t["k"] - t["below"] + 1) for t in rest], "tid long, rn long")
        got = (j.select("tid", "__x", F.row_number().over(w).alias("rn"))
                .join(F.broadcast(need), ["tid", "rn"]).collect())
        by = {t["tid"]: t for t in targets}
        for r in got:
            by[r["tid"]]["value"] = r["__x"]
    by = {t["tid"]: t for t in targets}
    out = []
    for key, p, a, bb, frac in wanted:
        va, vb = by[a]["value"], by[bb]["value"]
        val = va + (vb - va) * frac if frac else va
        out.append((*key, float(p), float(val)))
    schema_g = [(c, base.schema[c].dataType.simpleString()) for c in g]
    schema = ", ".join([f"`{c}` {tp}" for c, tp in schema_g] + ["prob double", "value double"])
    return spark.createDataFrame(out, schema).drop("__all")
