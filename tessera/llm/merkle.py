"""Merkle dataset manifest: a 16-ary hash tree per source, a tree over their roots, and a proof for every row.

A leaf is the sha256 of a row's fields. The leaves of a source, in the order of their ids,
are cut into superblocks of 16 ** 2 consecutive ones. ``climb`` reduces every superblock to
one node, the nodes of superblocks again, until each source has one node, its subroot; the
subroots, ordered by source, are the leaves of one more tree. ``descend`` goes back: in
each step the nodes of a superblock and the one outer node that they need (proof of the
superblock so far, subroot, root) are cogrouped by superblock in ``applyInPandas``, which
reduces the superblock again, joins both parts of each proof and folds it.

No group holds more than a superblock and its outer node, however many rows a source has.
Places in a source come from a range sort by (source, id), which splits a large source, and
one count for each (source, range). Only narrow rows (ids and digests) are shuffled. Tables
that two steps read are written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc32_sql, read, small, stored
from tessera.llm.kernels import tidied

#: Children of a node (a fixed value), and the levels that a superblock reduces.
FAN, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of the fields: ``-`` for null, else length in bytes, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree first) come sorted by tree; adds each row's place among its tree's rows in this partition."""
    last, seen = None, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        places, at = [], 0
        for tree, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if tree != last:
                last, seen = tree, 0
            places.append(pa.array(range(seen, seen + end - at), pa.int64()))
            seen, at = seen + end - at, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(places) if places else pa.array([], pa.int64())],
                                         [*batch.schema.names, "place"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (column tree) with pos, the place from 0 in the tree's order, and total, the tree's rows; written."""
    rest = [c for c in rows.columns if c != "tree"]
    # equal rows are interchangeable: their number in the scan lets a range cut between them
    spread = rows.select("tree", *rest, F.monotonically_increasing_id().alias("scan"))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "scan")]
    spread = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("scan").withColumn("part", F.spark_partition_id())
    numbered = stored(spread.mapInArrow(lambda it: tidied(_number(it)), spread.withColumn("place", F.lit(0).cast("long")).schema))
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                            F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return numbered.join(small(offsets), ["tree", "part"]).select(
        "tree", (F.col("before") + F.col("place")).alias("pos"), "total", *rest)


def reduced(nodes: list[str], whole: bool, depth: int = LEVELS) -> list[list[str]]:
    """Levels of a superblock, the last of one node. ``whole``: the superblock is the whole tree.

    A superblock of a larger tree goes through all its levels, even from one node.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 or not whole and len(levels) <= depth:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def local_path(levels: list[list[str]], place: int) -> str:
    """Siblings of a node level by level: left ones, ``:``, right ones; levels end in ``,``."""
    out = []
    for level in levels[:-1]:
        run = place // FAN * FAN
        out.append("".join(level[run:place]) + ":" + "".join(level[place + 1 : run + FAN]) + ",")
        place //= FAN
    return "".join(out)


def folded(node: str, path: str) -> str:
    """The root that a node and the siblings on its path give."""
    for step in path.split(",")[:-1]:
        left, right = step.split(":")
        node = digest(left + node + right)
    return node


def proof_hash(path: str) -> str:
    """Hash of the siblings on a path, level by level, left to right."""
    return digest(path.replace(":", "").replace(",", ""))


def _reduce(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    rows, block = rows.sort_values("pos"), FAN**depth
    tree, pos, total = rows["tree"].iat[0], int(rows["pos"].iat[0]), int(rows["total"].iat[0])
    top = reduced(rows["hash"].tolist(), total <= block, depth)[-1][0]
    return pd.DataFrame({"tree": [tree], "pos": [pos // block], "total": [-(-total // block)], "hash": [top]})


def _block(depth: int) -> Column:
    return F.expr(f"pos div {FAN**depth}").alias("block")


def climb(leaves: DataFrame, depth: int = LEVELS) -> list[DataFrame]:
    """Levels of superblocks' nodes (tree, pos, total, hash) from ``leaves`` up; the last has one node a tree."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    levels = [leaves]
    while len(levels) < 2 or most > 1:
        nodes = levels[-1].select("tree", "pos", "total", "hash")
        levels.append(stored(nodes.groupBy("tree", _block(depth)).applyInPandas(
            lambda rows: _reduce(rows, depth), "tree string, pos long, total long, hash string")))
        most = -(-most // FAN**depth)
    return levels


def _inherit(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Nodes of a superblock with their path, subroot and root; ``outer`` is the row of the superblock's own node."""
    nodes = nodes.sort_values("pos").reset_index(drop=True)
    levels = reduced(nodes["hash"].tolist(), int(nodes["total"].iat[0]) <= FAN**depth, depth)
    above, start = outer["path"].iat[0], int(nodes["pos"].iat[0])
    nodes["path"] = [local_path(levels, p - start) + above for p in nodes["pos"]]
    nodes["subroot"], nodes["root"] = outer["subroot"].iat[0], outer["root"].iat[0]
    return nodes


def _meet(nodes: DataFrame, outer: DataFrame, depth: int):
    return nodes.groupBy("tree", _block(depth)).cogroup(outer.groupBy("tree", F.col("pos").alias("block")))


def descend(levels: list[DataFrame], outer: DataFrame, depth: int = LEVELS) -> DataFrame:
    """Paths of all nodes of the lowest of ``levels``, from those of the level above the highest."""
    for nodes in reversed(levels):
        outer = _meet(nodes, outer, depth).applyInPandas(
            lambda a, b: _inherit(a, b, depth), nodes.select("*", *[F.lit("").alias(c) for c in ("path", "subroot", "root")]).schema)
    return outer


_OUT = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]


def _prove(with_proof: bool, rows: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    rows = _inherit(rows, outer, depth)
    rows["proof_sha256"] = [proof_hash(p) for p in rows["path"]]
    rows["folded_root"] = [folded(t or h, p) for t, h, p in zip(rows["tampered"], rows["hash"], rows["path"])]
    rows["verified"] = rows["folded_root"] == rows["root"]
    return rows.rename(columns={"hash": "leaf", "path": "proof"})[_OUT if with_proof else _OUT[:-1]]


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             claimed: dict[str, Column] | None = None, when: Column | None = None, with_proof: bool = False,
             depth: int = LEVELS) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``claimed`` replaces fields before the row is checked against its proof, where ``when``
    holds; without it every row is checked as it is. With ``with_proof`` a column ``proof``
    has the siblings themselves (``local_path``), which ``folded`` folds.

    A null source is a source of its own and comes first; null ids come first in theirs.
    Rows of equal id stand in the order of their leaves, repeated rows each have a leaf and
    a place. Null fields count as ``-``, empty texts as ``0:``; whole texts are hashed, in
    the JVM, and go no further. A table without rows has no tree and no rows come out.
    Columns that are no field are ignored.
    """
    own = [F.col(f) for f in fields]
    other = [(claimed or {}).get(f, F.col(f)) for f in fields]
    tampered = F.when(F.coalesce(when, F.lit(False)), leaf_hash(other)) if when is not None else F.lit(None).cast("string")
    source = F.col(source_col).cast("string")
    rows = docs.select(F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("tree"),
                       F.col(id_col).alias("id"), leaf_hash(own).alias("hash"), tampered.alias("tampered"))
    leaves = placed(rows, ["id", "hash"]).withColumn("id", F.col("id").cast("string"))  # null numbers are floats in pandas
    levels = climb(leaves, depth)
    roots = placed(levels[-1].select(F.lit("r").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    upper = climb(roots, depth)
    start = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    subroots = descend(upper[:-1], start, depth).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root")
    kinds = [f"{c} {'boolean' if c == 'verified' else 'string'}" for c in (_OUT if with_proof else _OUT[:-1])]
    out = _meet(leaves, descend(levels[1:-1], stored(subroots), depth), depth).applyInPandas(
        lambda rows, outer: _prove(with_proof, rows, outer, depth), ", ".join(kinds))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, claimed={"text": F.translate("text", _UPPER, _LOWER)}, when=chosen)


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


_UP_SQL = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"


def _sides_sql(at: str) -> str:
    run = f"({at}) // 16 * 16"
    return (f"array_to_string(nodes[{run} + 1 : {at}], '') AS l, "
            f"array_to_string(nodes[{at} + 2 : {run} + 16], '') AS r")


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql('text')} AS leaf,
         CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN
           {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(tree, lev, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree
  UNION ALL SELECT tree, lev + 1, {_UP_SQL} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS tpos FROM lv WHERE len(nodes) = 1),
up(lev, nodes) AS (
  SELECT 0, list(subroot ORDER BY tpos) FROM sub
  UNION ALL SELECT lev + 1, {_UP_SQL} FROM up WHERE len(nodes) > 1),
steps AS (
  SELECT p.tree, pos, lev, {_sides_sql('CAST(pos AS BIGINT) // CAST(power(16, lev) AS BIGINT)')}
  FROM p JOIN lv ON p.tree = lv.tree WHERE len(nodes) > 1
  UNION ALL SELECT p.tree, pos, 100 + lev, {_sides_sql('CAST(tpos AS BIGINT) // CAST(power(16, lev) AS BIGINT)')}
  FROM p JOIN sub ON p.tree = sub.tree CROSS JOIN up WHERE len(nodes) > 1),
path AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY lev)) AS proof, list(l || ':' || r ORDER BY lev) AS sides
         FROM steps GROUP BY tree, pos),
f AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM up WHERE len(nodes) = 1) AS root,
             coalesce(proof, sha256('')) AS proof_sha256,
             list_reduce(coalesce(sides, CAST([] AS VARCHAR[])),
                         lambda a, s: sha256(split_part(s, ':', 1) || a || split_part(s, ':', 2)),
                         coalesce(tampered, leaf)) AS folded_root
      FROM p JOIN sub ON p.tree = sub.tree LEFT JOIN path ON p.tree = path.tree AND p.pos = path.pos)
SELECT *, folded_root = root AS verified FROM f
"""
