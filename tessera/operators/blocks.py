"""Training rows packed into blocks, for fits that pass over them many times.

A block is one row of binary columns: up to ``BLOCK_ROWS`` rows' keys, labels, folds,
features and scores as plain arrays. A pass reads blocks as Arrow batches and works on
whole arrays; nothing is exploded and no row is handled alone. Blocks stay where their
partition is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import workers_import
from tessera.sources.io import scratch_path

BLOCK_ROWS = 4_096
BLOCK = "n int, key binary, y binary, fold binary, x binary, score binary"
_NAMES = [part.split()[0] for part in BLOCK.split(", ")]
#: Keys are hashed in the integers modulo this prime (a fixed value, 2^31 - 1).
PRIME = (1 << 31) - 1


def row_key(df: DataFrame, id_col: str) -> Column:
    """A number of 0 to PRIME - 1 for each id; integers as they are, others by their hash; null is 0."""
    whole = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    number = F.col(id_col).cast("long") if whole else F.xxhash64(id_col)
    return F.coalesce(F.pmod(number, F.lit(PRIME)), F.lit(0)).cast("long")


def key_unit(key: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for keys, another series for each ``draw`` (1 to PRIME - 1)."""
    h = (key + 1) % PRIME * draw % PRIME
    return (h * h + draw) % PRIME / PRIME


def _pack(nf: int, scores: int, splits: list[list[float]] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, y, fold, features ...) as blocks; with ``splits`` features become bins of one byte."""
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        key, y, fold = (rows.column(i).to_numpy() for i in range(3))
        x = np.column_stack([rows.column(3 + f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in range(nf)]) if nf else np.zeros((n, 0))
        if splits is not None:
            bins = np.empty((n, nf), np.uint8)
            for f, edges in enumerate(splits):
                # bin i is [s_i, s_i+1), missing values have the last one
                bins[:, f] = np.where(np.isnan(x[:, f]), len(edges) - 1, np.searchsorted(edges[1:-1], x[:, f], side="right"))
            x = bins
        fields = (key.astype(np.int64), y.astype(np.int16), fold.astype(np.int16), np.ascontiguousarray(x), np.zeros(n * scores))
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in fields)], _NAMES)

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, BLOCK_ROWS))
            rest = table.slice(BLOCK_ROWS)
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield block(pa.Table.from_batches(held))


def packed(df: DataFrame, features: list[str], label: Column, key: Column, fold: Column | None, scores: int = 0,
           splits: list[list[float]] | None = None) -> DataFrame:
    """Blocks of ``df``; the class scores are zeros."""
    workers_import(df.sparkSession)
    rows = df.select(key.alias("key"), label.cast("int").alias("y"), (fold if fold is not None else F.lit(-1)).cast("int").alias("fold"),
                     *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return rows.mapInArrow(lambda it: _pack(len(features), scores, splits, it), BLOCK)


class Block:
    """The arrays of a block."""

    def __init__(self, batch: pa.RecordBatch, i: int, nf: int, binned: bool) -> None:
        self.n = batch.column(0)[i].as_py()
        raw = [batch.column(c)[i].as_buffer() for c in range(1, 6)]
        self.key = np.frombuffer(raw[0], np.int64)
        self.y = np.frombuffer(raw[1], np.int16)
        self.fold = np.frombuffer(raw[2], np.int16)
        self.x = np.frombuffer(raw[3], np.uint8 if binned else np.float64).reshape(self.n, nf)
        self.score = np.frombuffer(raw[4], np.float64).reshape(self.n, -1)


def blocks_of(batches: Iterator[pa.RecordBatch], nf: int, binned: bool) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, Block(batch, i, nf, binned)


def with_score(batch: pa.RecordBatch, i: int, score: np.ndarray) -> pa.RecordBatch:
    """Block i of the batch with another score."""
    one = batch.slice(i, 1)
    return pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([np.ascontiguousarray(score).tobytes()], pa.binary())], _NAMES)


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that this run wrote itself."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def steady_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, whose plans are not changed while they run."""
    out = spark.newSession()
    for key, value in spark.sparkContext.getConf().getAll():
        if key.startswith("spark.sql.") and not key.startswith(("spark.sql.warehouse", "spark.sql.catalogImplementation")):
            out.conf.set(key, spark.conf.get(key, value))
    out.conf.set("spark.sql.adaptive.enabled", "false")
    return out


class Written:
    """The newest copy of a frame in the shared folder; an older one is deleted once the newer is complete."""

    def __init__(self, spark: SparkSession, name: str, reader: SparkSession | None = None) -> None:
        self.spark, self.name, self.path, self.reader = spark, name, None, reader or spark

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        if self.path:
            delete_table(self.spark, self.path)
        self.path = path
        return self.reader.read.parquet(path)

    def drop(self) -> None:
        if self.path:
            delete_table(self.spark, self.path)
            self.path = None
