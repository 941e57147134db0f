"""SMOTE-NC oversampling as Spark jobs (SM5, JN5).

Every class is oversampled to the majority size. Synthetic sample j of class c
takes seed row rank (h(c, j) mod n_c) + 1 in hash order, one of the seed's k
nearest same-class neighbours (chosen by hash), a hash gap u in [0, 1):
continuous = seed + u (neighbour - seed); categorical = most frequent value among
the k neighbours (ties -> smallest). Distance = sum of squared continuous
differences + Med^2 per categorical mismatch, Med = median of the population
standard deviations of the continuous features in the smallest class
(the published SMOTE-NC definition).

Exact k-NN without all pairs: each class is cut into cells of about ``cell_points``
points by quantiles of the two continuous features with the largest spread, so skewed
values don't pile up in one cell (many equal points are dealt out by a hash). A seed is
compared with its own cell first; then it visits every cell whose bounding box (over all
continuous features) is not farther than the k-th distance so far. Boxes may overlap, so
this is exact for any cells. Seeds find those cells in a tree of boxes: a node has up to
16 neighbouring cells or nodes, and a seed goes on from a node only to children that are
near enough, one level a join. So what is compared and shuffled is visits, not seeds
times cells.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import exact_rank, hash_order
from tessera.session import cut_lineage, workers_import


def _hash_int(*parts: Column, seed: str) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed)))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _hash_u(*parts: Column, seed: str) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _generate(counts: DataFrame, cls: str, chunk: int = 100_000) -> DataFrame:
    """(cls, j) for j in [0, need) without one task expanding a huge array."""
    nch = F.floor((F.col("need") - 1) / chunk).cast("int")
    c = counts.where(F.col("need") > 0).select(cls, "need", "n", "base", F.explode(F.sequence(F.lit(0), nch)).alias("ch"))
    c = c.repartition(F.xxhash64(cls, "ch"))
    lo = (F.col("ch") * chunk).cast("long")
    hi = F.least(lo + chunk - 1, F.col("need") - 1).cast("long")
    return c.select(cls, "n", "base", F.explode(F.sequence(lo, hi)).alias("j"))


def _mode(column: str) -> Column:
    """The most frequent value of an array of (value) structs, the smallest of equally frequent ones."""
    counted = F.transform(F.array_distinct(column), lambda v: F.struct(-F.size(F.filter(column, lambda x: x == v)), v[column].alias("v")))
    return F.array_min(counted)["v"]


VISITS = 16_384


def _nearest(q: pd.DataFrame, p: pd.DataFrame, cls: str, cont: list[str], cat: list[str], med2: float, k: int) -> pd.DataFrame:
    """The k nearest points (by distance, then id) of every query of one cell, not beyond its limit."""
    out = []
    ids = p["b_id"].to_numpy()
    for at in range(0, len(q) if len(p) else 0, 256):
        part = q.iloc[at : at + 256]
        d = np.zeros((len(part), len(p)))
        for c in cont:
            d += (part["a_" + c].to_numpy(float)[:, None] - p["b_" + c].to_numpy(float)[None, :]) ** 2
        for c in cat:
            d += np.where(part["a_" + c].to_numpy()[:, None] != p["b_" + c].to_numpy()[None, :], med2, 0.0)
        d[part["q_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
        d[d > part["r2"].to_numpy()[:, None]] = np.inf
        bound = np.partition(d, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1]
        row, col = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        order = np.lexsort((ids[col], d[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        near = p.iloc[col].reset_index(drop=True)[["b_id", *["b_" + c for c in cont + cat]]]
        near.insert(0, "d2", d[row, col])
        near.insert(0, "q_id", part["q_id"].to_numpy()[row])
        near.insert(0, cls, part[cls].to_numpy()[row])
        out.append(near)
    columns = [cls, "q_id", "d2", "b_id", *["b_" + c for c in cont + cat]]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


#: Nodes of a level of the box tree that are sent to every executor; larger levels are shuffled.
SENT_NODES = 65_536


def near_cells(todo: DataFrame, points: DataFrame, cls: str, cont: list[str], strips: dict, rows: dict) -> DataFrame:
    """``todo`` (class, r2, a_ features) with each cell (strip, cell, part) whose box is within r2.

    Level 0 of the tree has the cells (of their parts), level k the nodes (strip, cell)
    shifted by 2 (k - 1) bits, 4 x 4 nodes of the level below, up to one node a class. A
    level of at most ``SENT_NODES`` nodes, by the numbers of strips and cells, is sent to
    every executor; the levels below have so many nodes that no node has many visits.
    """
    ends = [f for c in cont for f in (F.min("b_" + c).alias(f"lo_{c}"), F.max("b_" + c).alias(f"hi_{c}"))]
    leaves = cut_lineage(points.groupBy(cls, "strip", "cell", "part").agg(*ends))
    again = [f for c in cont for f in (F.min(f"lo_{c}").alias(f"lo_{c}"), F.max(f"hi_{c}").alias(f"hi_{c}"))]
    widest = max(max(strips.values(), default=1), max(rows.values(), default=1))
    top = math.ceil(math.log(widest, 4))  # its nodes all hang below (0, 0)

    def shifted(column: str, k: int) -> Column:
        return F.shiftright(F.col(column).cast("int"), 2 * (k - 1))

    def away(c: str) -> Column:
        x = F.col("a_" + c).cast("double")
        far = F.greatest(F.col(f"lo_{c}") - x, x - F.col(f"hi_{c}"), F.lit(0.0))
        return far * far
    gap = reduce(lambda a, b: a + b, [away(c) for c in cont], F.lit(0.0))
    ends_of = [f"{e}_{c}" for c in cont for e in ("lo", "hi")]
    found = todo.withColumn("at_s", F.lit(0)).withColumn("at_c", F.lit(0))  # the top node of the class
    for k in range(top, -1, -1):
        if k:
            nodes = leaves.groupBy(cls, shifted("strip", k).alias("s"), shifted("cell", k).alias("c")).agg(*again)
            names, above = ["s", "c"], [F.shiftright("s", 2), F.shiftright("c", 2)]
        else:
            nodes, names, above = leaves, ["strip", "cell", "part"], [F.col("strip"), F.col("cell")]
        width = 4 ** max(0, k - 1)
        size = sum(-(-strips[v] // width) * -(-rows[v] // width) for v in strips) * (1 if k else 4)  # cells of many points have parts
        nodes = nodes.select(F.col(cls).alias("of"), above[0].alias("up_s"), above[1].alias("up_c"), *names, *ends_of)
        if size <= SENT_NODES:
            nodes = F.broadcast(nodes)
        on = (F.col(cls) == F.col("of")) & (F.col("at_s") == F.col("up_s")) & (F.col("at_c") == F.col("up_c")) & (gap <= F.col("r2"))
        found = found.join(nodes, on).drop("of", "up_s", "up_c", "at_s", "at_c", *ends_of)
        if k:
            found = found.withColumnsRenamed({"s": "at_s", "c": "at_c"})
    return found


def knn_within_class(queries: DataFrame, points: DataFrame, cls: str, id_col: str,
                     cont: list[str], cat: list[str], med2: float, k: int,
                     grid_dims: list[str], cell_points: int = 2048) -> DataFrame:
    """Exact k nearest same-class neighbours (excluding self) of each query point.

    Output: cls, query id (``q_id``), ``nn_rank`` 1..k, neighbour id and features.
    """
    workers_import(points.sparkSession)
    g1, g2 = grid_dims
    feats = cont + cat
    sizes = {r[cls]: r["n"] for r in points.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    strips = {c: max(1, math.ceil(math.sqrt(n / cell_points))) for c, n in sizes.items()}
    rows = {c: max(1, math.ceil(n / strips[c] / cell_points)) for c, n in sizes.items()}

    def cut(column: str, parts: dict, by: list[str]) -> DataFrame:
        """(by, cuts): quantiles that part the column, a number of parts for each class."""
        exprs = [F.percentile_approx(F.when(F.col(cls) == F.lit(c), F.col(column)), [i / m for i in range(1, m)], 10_000)
                 for c, m in parts.items() if m > 1]
        none = F.array().cast("array<double>")
        return points_at.groupBy(*by).agg(F.coalesce(*[e.cast("array<double>") for e in exprs], none).alias("cuts"))

    def place(df: DataFrame) -> DataFrame:
        one = df.join(F.broadcast(cuts1), cls).withColumn("strip", _above(F.col(g1))).drop("cuts")
        two = one.join(small_table(cuts2), [cls, "strip"], "left")
        return two.withColumn("cell", F.coalesce(_above(F.col(g2)), F.lit(0))).drop("cuts")

    def _above(value: Column) -> Column:
        return F.size(F.filter("cuts", lambda c: c < value))

    def small_table(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if sum(strips.values()) * 8 * max(rows.values()) < 64 << 20 else df

    points_at = points
    cuts1 = cut_lineage(cut(g1, strips, [cls]))
    points_at = points.join(F.broadcast(cuts1), cls).withColumn("strip", _above(F.col(g1))).drop("cuts")
    cuts2 = cut_lineage(cut(g2, rows, [cls, "strip"]))
    placed = place(points).select(cls, "strip", "cell", F.col(id_col).alias("b_id"), *[F.col(c).alias("b_" + c) for c in feats])
    placed = cut_lineage(placed)
    # a cell of many equal points is dealt out
    full = placed.groupBy(cls, "strip", "cell").agg(F.ceil(F.count(F.lit(1)) / (4 * cell_points)).cast("int").alias("parts"))
    cell = [cls, "strip", "cell", "part"]
    p = cut_lineage(placed.join(full, cell[:3]).withColumn("part", F.pmod(F.xxhash64("b_id"), F.col("parts")).cast("int")).drop("parts"))
    q = place(queries).join(full, cell[:3], "left").select(
        cls, "strip", "cell", F.pmod(F.xxhash64(id_col), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
        F.col(id_col).alias("q_id"), *[F.col(c).alias("a_" + c) for c in feats])
    q = cut_lineage(q)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([f"`{cls}` {kinds[cls]}", f"q_id {kinds[id_col]}", "d2 double", f"b_id {kinds[id_col]}",
                        *[f"`b_{c}` {kinds[c]}" for c in feats]])

    def search(visits: DataFrame) -> DataFrame:
        """Visits (cell, query, r2) answered cell by cell; a cell with many visits has several groups."""
        many = visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("groups"))
        v = visits.join(many, cell).withColumn("turn", F.pmod(F.xxhash64("q_id"), F.col("groups")).cast("int")).drop("groups")
        pts = p.join(many, cell).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        pts = pts.select(*[F.col(c).alias(c) for c in pts.columns])  # columns of its own beside the visits
        return v.groupBy(*cell, "turn").cogroup(pts.groupBy(*cell, "turn")).applyInPandas(
            lambda a, b: _nearest(a, b, cls, cont, cat, med2, k), schema)

    first = cut_lineage(search(q.withColumn("r2", F.lit(float("inf")))))
    kth = first.groupBy(cls, "q_id").agg(F.when(F.count(F.lit(1)) == k, F.max("d2")).alias("r2"))
    todo = q.withColumnsRenamed({c: f"own_{c}" for c in cell[1:]}).join(kth, [cls, "q_id"], "left")
    todo = todo.withColumn("r2", F.coalesce("r2", F.lit(float("inf"))))
    own = (F.col("strip") == F.col("own_strip")) & (F.col("cell") == F.col("own_cell")) & (F.col("part") == F.col("own_part"))
    visits = near_cells(todo, p, cls, cont, strips, rows).where(~own).select(*cell, "q_id", "r2", *["a_" + c for c in feats])
    found = first.unionByName(search(visits))
    w = Window.partitionBy(cls, "q_id").orderBy("d2", "b_id")
    out = found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)
    return out.select(cls, "q_id", "nn_rank", "b_id", *[F.col("b_" + c).alias(c) for c in feats])


def least_class(sizes: list[int]) -> int:
    """AG18: the size of the smallest class; balancing needs two rows or more in each."""
    if min(sizes) < 2:
        raise ValueError("every class needs two rows or more to be oversampled")
    return min(sizes)


def balance_guard(df: DataFrame, cls: str) -> tuple[int, bool]:
    """AG18: the smallest class and whether ``smotenc`` would go on."""
    sizes = [r["n"] for r in df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()]  # one row a class
    try:
        return least_class(sizes), True
    except ValueError:
        return min(sizes, default=0), False


def smotenc(df: DataFrame, cls: str, id_col: str, cont: list[str], cat: list[str],
            k_max: int = 5, seed: int = 42, cell_points: int = 2048) -> DataFrame:
    """SM5: originals (synthetic=false) + synthetic rows up to the majority size per class.

    Synthetic ids are negative and unique over all classes: -(j + 1) less the number of
    synthetic rows of the classes before (in order of size, then name).
    """
    df = cut_lineage(df)  # read by several passes (counts, spreads, ranks, neighbours)
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    if not counts:
        return df.withColumn("synthetic", F.lit(False))
    k = min(k_max, least_class([r["n"] for r in counts]) - 1)
    n_max = max(r["n"] for r in counts)
    smallest = sorted(counts, key=lambda r: (r["n"], str(r[cls])))[0][cls]
    sd = df.where(F.col(cls) == F.lit(smallest)).agg(*[F.stddev_pop(c).alias(c) for c in cont]).first()
    stds = sorted(float(sd[c] or 0.0) for c in cont)
    med = 0.0 if not stds else (stds[len(stds) // 2] if len(stds) % 2 else
                                (stds[len(stds) // 2 - 1] + stds[len(stds) // 2]) / 2.0)
    med2 = med * med
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in cont]).first()
    grid = sorted(cont, key=lambda c: (-(spread[c] or 0.0), c))[:2]
    if len(grid) < 2:
        grid = (grid * 2)[:2]

    spark = df.sparkSession
    before, base = {}, 0
    for r in sorted(counts, key=lambda r: (r["n"], str(r[cls]))):
        before[r[cls]] = base
        base += n_max - r["n"]
    cnt = spark.createDataFrame([(r[cls], r["n"], n_max - r["n"], before[r[cls]]) for r in counts],
                                f"{cls} {df.schema[cls].dataType.simpleString()}, n long, need long, base long")
    gen = _generate(cnt, cls)
    gen = gen.withColumn("rank", (F.pmod(_hash_int(F.col(cls), F.col("j"), seed=f"{seed}s"), F.col("n")) + 1))
    ranked = exact_rank(df.withColumn("__h", hash_order(id_col, seed)), [cls], "__h", id_col, "rank").drop("__h")
    # a row for each synthetic row; the planner measures the few chunks they are expanded from
    seeds = gen.hint("merge").join(ranked, [cls, "rank"])  # (cls, j, seed row)
    q = seeds.select(cls, id_col, *cont, *cat).dropDuplicates([cls, id_col])
    nn = knn_within_class(q, df.select(cls, id_col, *cont, *cat), cls, id_col, cont, cat, med2, k, grid, cell_points)
    nn = cut_lineage(nn)
    # the neighbours of a seed as one row: no row for each neighbour and column goes on
    near = nn.groupBy(cls, "q_id").agg(F.collect_list(F.struct("nn_rank", *cont)).alias("near"), *[F.collect_list(F.struct(c)).alias(c) for c in cat])
    near = near.select(cls, "q_id", "near", *[_mode(c).alias(c) for c in cat])
    pick = seeds.select(cls, "j", "base", F.col(id_col).alias("q_id"), *[F.col(c).alias("s_" + c) for c in cont],
                        (F.pmod(_hash_int(F.col(cls), F.col("j"), seed=f"{seed}n"), F.lit(k)) + 1).alias("nn_rank"),
                        _hash_u(F.col(cls), F.col("j"), seed=f"{seed}u").alias("u"))
    syn = pick.join(near, [cls, "q_id"]).withColumn("__n", F.get(F.filter("near", lambda x: x["nn_rank"] == F.col("nn_rank")), F.lit(0)))
    syn = syn.where("__n is not null").withColumns({f"n_{c}": F.col("__n")[c] for c in cont})
    syn = syn.select(cls, (-(F.col("base") + F.col("j") + 1)).alias(id_col),
                     *[(F.col("s_" + c) + F.col("u") * (F.col("n_" + c) - F.col("s_" + c))).alias(c) for c in cont],
                     *[F.col(c).cast("double").alias(c) for c in cat], F.lit(True).alias("synthetic"))
    orig = df.select(cls, id_col, *[F.col(c).cast("double").alias(c) for c in cont + cat], F.lit(False).alias("synthetic"))
    return orig.unionByName(syn)
