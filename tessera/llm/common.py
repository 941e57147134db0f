"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import workers_import

#: Most rows of two or three narrow columns that are sent to every executor (about 64 MB).
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the folder all executors share.

    Only a local session without the setting gets a scratch folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def join_firsts(rows: DataFrame, firsts: DataFrame, key: str, count: str, max_rows: int = 500_000) -> DataFrame:
    """Left join of ``rows`` to ``firsts`` (one row per ``key``, ``count`` rows of it in ``rows``), safe for hot keys.

    Few firsts are sent to every executor. Else those of hot keys are: keys of at least
    1/max_rows of all rows, so no more than ``max_rows`` of them; the others are shuffled,
    and none of them is hot. Keys are never null.
    """
    size = firsts.agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("rows")).first()
    if size["n"] <= max_rows:
        return rows.join(F.broadcast(firsts.drop(count)), key, "left")
    hot = F.col(count) >= max(2, size["rows"] // max_rows + 1)
    heavy, light = firsts.filter(hot).drop(count), firsts.filter(~hot).drop(count)
    known = F.broadcast(heavy.select(key))
    return (rows.join(F.broadcast(heavy), key)
            .unionByName(rows.join(known, key, "left_anti").join(light, key, "left")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the crc32 of an ASCII text."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: "
            "list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, "
            "xor(a, b)), 4294967295::BIGINT), 4294967295)")
