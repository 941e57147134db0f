"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector and a text's fingerprint is the sum of its
paragraphs' vectors, modulo powers of two: paragraphs may come in any order, adding one
is an addition and removing one a subtraction. A vector has two parts:

* ``EXACT`` lanes modulo 2**64, a hash of the whole paragraph: equality;
* ``WIDE`` lanes modulo 2**32: the paragraph's 3-word shingles, each +1 or -1 in a lane of
  its own hash. Sums of such vectors keep distances, so two fingerprints show how much
  of their shingles the texts share: 1 - |a - b|^2 / (|a|^2 + |b|^2), not below 0. Lanes
  are read back as signed numbers; a lane wraps at 2**31 shingles, more than the longest
  text (2**31 bytes) has, whether they are equal or not.

A fingerprint is order-independent; paragraph boundaries are line ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import read
from tessera.llm.kernels import SPACE_WORDS, hash_words, mix, shingles, stream, tidied

EXACT, WIDE, SHINGLE = 4, 128, 3
#: Ids a bucket that give the bounds of buckets, where ids are no numbers.
SAMPLE = 20
_U = np.uint64
_LANES = stream(EXACT, 31)
_EMPTY = np.zeros(EXACT + WIDE, np.uint64)
_MASK = _U(0xFFFFFFFF)


def vectors(paragraphs: list[bytes]) -> np.ndarray:
    """Sum of the paragraphs' vectors, as 64-bit integers (wide lanes modulo 2**32)."""
    out = _EMPTY.copy()
    if not paragraphs:
        return out
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])])
    data = np.frombuffer(b"".join(paragraphs), np.uint8)
    words, counts = hash_words(data, bounds, SPACE_WORDS)
    whole = np.array([int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") for p in paragraphs], np.uint64)
    units, _ = shingles(words, counts, SHINGLE)
    with np.errstate(over="ignore"):
        out[:EXACT] = mix(whole[:, None] + _LANES[None, :]).sum(axis=0, dtype=np.uint64)
        lane = (units & _U(WIDE - 1)).astype(np.int64)
        signs = 1.0 - 2.0 * ((units >> _U(20)) & _U(1)).astype(float)
        out[EXACT:] = np.bincount(lane, signs, WIDE).astype(np.int64).astype(np.uint64) & _MASK
    return out


def paragraphs(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = a + b
    out[EXACT:] &= _MASK
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = a - b
    out[EXACT:] &= _MASK
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints, also of empty texts."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.uint32).astype(np.int32).astype(float) for v in (a, b))
    size = float(x @ x + y @ y)
    return max(0.0, 1.0 - float((x - y) @ (x - y)) / size) if size else 0.0


def written(v: np.ndarray) -> str:
    return v[:EXACT].astype("<u8").tobytes().hex() + v[EXACT:].astype("<u4").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    raw = bytes.fromhex(text)
    return np.concatenate([np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<u4").astype(np.uint64)])


def edited(text: str, own: np.ndarray, following: str) -> tuple[str, np.ndarray]:
    """The edited text and its fingerprint: paragraphs of the replaced end are taken out, those of the new end put in."""
    half = len(text) // 2
    if not half:
        return text, own
    keep = len(text) - half
    out = text[:keep] + following[:half]
    start = text.rfind("\n", 0, keep) + 1  # the paragraphs before stand in both
    gone, new = paragraphs(text[start:]), paragraphs(out[start:])
    if not text[start:]:
        gone = [b""]
    if not out[start:]:
        new = [b""] if out else []
    return out, plus(minus(own, vectors(gone)), vectors(new))


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket stand in order, after its last one the first of the next bucket (``ghost``)."""
    held = None  # (bucket, id, text, fingerprint)
    for batch in batches:
        rows: list[tuple] = []
        for bucket, ghost, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            if ghost and (held is None or held[0] != bucket):
                continue
            own = vectors(paragraphs(text))
            if held is not None and held[0] == bucket:
                _, old_key, old, old_print = held
                changed, changed_print = edited(old, old_print, text)
                rows.append((old_key, len(old), hashlib.sha256(changed.encode()).hexdigest(), written(old_print),
                             written(changed_print), likeness(old_print, changed_print), likeness(old_print, own)))
            held = None if ghost else (bucket, key, text, own)
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [batch.schema.field(2).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_id", *_OUT])


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: id, n_chars, fingerprints of the text and its edited text, their likeness and that to the next row.

    The next row is that of the next smaller id; after the last comes the first. Equal ids
    stand in the order of their texts' hashes; null ids come last. Null texts are empty. A
    single row is its own next. Other columns are ignored.

    Rows go to buckets of adjoining ids, whose bounds are quantiles of the ids (of numbers all,
    of other ids the ``SAMPLE`` a bucket with the least hashes); one row of each bucket also
    goes to the bucket before it. So texts are shuffled once and no bucket depends on
    another. Equal ids share a bucket. Repeated rows are one another's next rows; very long
    texts are hashed whole, a paragraph's words at a time.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if isinstance(rows.schema["_id"].dataType, T.NumericType):
        place = F.col("_id").cast("double")
        cuts = rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
        cuts = sorted({float(c) for c in cuts}, reverse=True)
    else:
        place = F.col("_id")
        some = rows.where(place.isNotNull()).select("_id", F.xxhash64("_id").alias("h")).distinct().orderBy("h", "_id").limit(SAMPLE * n)
        ids = [r["_id"] for r in some.orderBy(F.col("_id").desc()).collect()]
        cuts = ids[SAMPLE::SAMPLE] if len(ids) > SAMPLE * 2 else ids[1::2][: n - 1]
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if cuts:  # the number of cuts above the id, by halving
        above = F.array(*[F.lit(c) for c in cuts])
        bucket = F.coalesce(F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda a, k: F.when(
            F.coalesce(F.get(above, a + k - 1) > place, F.lit(False)), a + k).otherwise(a)), F.lit(0))
        bucket = F.when(F.col("_id").isNull(), len(cuts)).otherwise(bucket)
    else:
        bucket = F.lit(0)
    placed = rows.select(bucket.alias("_bucket"), F.lit(0).alias("_ghost"), "_id", "_text")
    turned = F.bitwise_not(F.xxhash64("_text"))
    order = F.struct(F.col("_id").isNotNull(), F.col("_id"), turned)
    heads = sorted((r["_bucket"], r["top"]) for r in placed.groupBy("_bucket").agg(F.max(order).alias("top")).collect())
    spots = [b for b, _ in heads]
    if heads:
        before = {b: spots[i - 1] for i, b in enumerate(spots)}
        tops = docs.sparkSession.createDataFrame(
            [(b, before[b], t[1], t[2]) for b, t in heads],
            rows.select(F.lit(0).alias("_b"), F.lit(0).alias("_to"), F.col("_id").alias("_top"), turned.alias("_sum")).schema)
        ghosts = placed.join(F.broadcast(tops), (F.col("_bucket") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_top"))
                             & (turned == F.col("_sum")))  # one narrow row for each bucket
        ghosts = ghosts.select(F.col("_to").alias("_bucket"), F.lit(1).alias("_ghost"), "_id", "_text")
        placed = placed.unionByName(ghosts)
    ordered = placed.repartition(n, "_bucket").sortWithinPartitions(
        F.col("_bucket"), F.col("_ghost"), F.col("_id").desc_nulls_last(), F.xxhash64("_text"))
    out = ordered.mapInArrow(lambda it: tidied(_chain(it)), rows.select(
        "_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in _OUT[1:4]],
        *[F.lit(0.0).alias(c) for c in _OUT[4:]]).schema)
    return out.withColumnRenamed("_id", id_col)


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_chain(read(spark, sf_dir, "documents"))
