"""Benchmark decontamination: a broadcast set of test n-grams, scanned over all token windows.

Everything is DataFrame functions. A document becomes an array of words once; every
window of n words is hashed in place and looked up in the set of the benchmark's window
hashes, and only windows whose hash is in it become rows, which then join the
benchmark's windows on their actual words. The set travels inside the plan as a literal
up to ``MAX_LITERAL`` windows; beyond it, windows become rows and join the hashes (sent to
all executors up to ``common.BROADCAST_ROWS``, else shuffled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, small

WINDOW = 10
MAX_LITERAL = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: [^...] of the words, and capitals are letters before they are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in their own case."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), lambda w: w != "")


def fold(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def _hash(array: Column, start: Column, n: int) -> Column:
    """Hash of n words; equal folded words give equal hashes."""
    return F.xxhash64(*[array[start + k] for k in range(n)])


def _folded_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(F.lower(w)))


def _starts(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, len, gram, hash): all windows of n words; a shorter item is one window."""
    items = (benchmark.filter(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
             .withColumn("h", _folded_hashes(F.col("w"))).withColumn("size", F.size("w")).filter("size > 0"))
    size = F.least(F.col("size"), F.lit(n))
    # words beyond a short item's end are null and leave the hash as it is
    rows = items.select("item_id", size.alias("len"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("size") - size), lambda i: F.struct(
            F.xxhash64(*[F.get("h", i + k) for k in range(n)]).alias("hash"),
            fold(F.array_join(F.slice("w", i + 1, size), " ")).alias("gram")))).alias("g"))
    return rows.select("item_id", "len", "g.hash", "g.gram").distinct()


def _matches(k: int, hashes: list[int]) -> Column:
    """The windows of k words whose hash is in the literal set, with their words."""
    hit = F.filter(_starts(F.col("n_words"), k), lambda i: _hash(F.col("h"), i, k).isin(hashes))
    return F.transform(hit, lambda i: F.struct(
        F.lit(k).alias("len"), i.alias("pos"), fold(F.array_join(F.slice("w", i + 1, F.lit(k)), " ")).alias("gram")))


def _all_windows(k: int) -> Column:
    return F.transform(_starts(F.col("n_words"), k), lambda i: F.struct(
        F.lit(k).alias("len"), i.alias("pos"), _hash(F.col("h"), i, k).alias("hash")))


KEYS = ["_id", "_sum"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
                  max_literal: int = MAX_LITERAL, with_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; benchmark rows without an id or words
    have no windows. Repeated rows each come out; rows are told apart by id and content.
    Other columns are ignored. With ``with_hash`` a column text_hash (xxhash64 of the text)
    tells rows of one id apart.
    """
    grams = benchmark_windows(benchmark, item_col, item_text, n).cache()
    try:
        lengths = [(r["len"], r["n"]) for r in grams.groupBy("len").agg(F.countDistinct("hash").alias("n")).collect()]
        wide = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                .select("_id", F.xxhash64("_text").alias("_sum"), words(F.col("_text")).alias("w"))
                .select("*", F.size("w").alias("n_words"), _folded_hashes(F.col("w")).alias("h")))
        literal = sum(k for _, k in lengths) <= max_literal
        parts = []
        for k, _ in sorted(lengths):
            if literal:
                hashes = [r[0] for r in grams.filter(F.col("len") == k).select("hash").distinct().collect()]
                parts.append(_matches(k, hashes))
            else:
                parts.append(_all_windows(k))
    finally:
        grams.unpersist()
    kind = "struct<len:int,pos:int,gram:string>" if literal else "struct<len:int,pos:int,hash:bigint>"
    none = F.lit(None).cast(kind)
    rows = wide.select(*KEYS, "n_words", F.explode(F.concat(F.array(none), *parts)).alias("f"))
    if not literal:
        rows = _verified(rows, docs, grams, id_col, text_col)
    hits = rows.join(small(grams.select("len", "gram", "item_id")).withColumnRenamed("len", "l").withColumnRenamed("gram", "g"),
                     (F.col("f.len") == F.col("l")) & (F.col("f.gram") == F.col("g")), "left")
    # one row per document, and few for windows: at most the occurrences of benchmark text
    hits = hits.filter(F.col("f").isNull() | F.col("item_id").isNotNull())
    covered = hits.groupBy(*KEYS).agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("f").isNull().cast("int")).alias("_copies"),
        F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("f.pos", "f.len"))).alias("_spans"),
        F.collect_set("item_id").alias("_items"))
    positions = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    out = covered.select(
        F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.size(positions).cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"), *([F.col("_sum").alias("text_hash")] if with_hash else []), F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def _verified(rows: DataFrame, docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The way beyond the literal set: windows whose hash joins, then their words from the documents concerned."""
    hashes = small(grams.select(F.col("hash").alias("_h"), F.col("len").alias("_l")).distinct())
    near = rows.join(hashes, (F.col("f.hash") == F.col("_h")) & (F.col("f.len") == F.col("_l")), "left")
    near = near.filter(F.col("f").isNull() | F.col("_h").isNotNull()).drop("_h", "_l")
    base, found = near.filter(F.col("f").isNull()), near.filter(F.col("f").isNotNull())
    texts = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_s"), F.col(text_col).alias("_text"))
    found = found.join(texts.dropDuplicates(["_i", "_s"]), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_s")))
    found = found.select(*KEYS, "n_words", "f", words(F.col("_text")).alias("w")).select(*KEYS, "n_words", F.struct(
        F.col("f.len").alias("len"), F.col("f.pos").alias("pos"),
        fold(F.array_join(F.slice("w", F.col("f.pos") + 1, F.col("f.len")), " ")).alias("gram")).alias("f"))
    kind = "struct<len:int,pos:int,gram:string>"
    return base.select(*KEYS, "n_words", F.lit(None).cast(kind).alias("f")).unionByName(found)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS gram
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
win AS (SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram
        FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, g.k, item_id FROM win JOIN g ON win.k = g.k AND win.gram = g.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
