"""Sources, sinks and persistence helpers (IO1-IO8)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO1: CSV with header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


#: Texts that count as missing when types are inferred.
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A")
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"
_TRUTH = ("True", "False", "true", "false", "TRUE", "FALSE")


def inferred_types(texts: DataFrame) -> dict[str, str]:
    """Type of each text column, of all its values: the least of boolean, long, double, string that holds them.

    Whole numbers beyond 64 bits are doubles; a column without values is a string. Each
    column has one flag a type, and flags are merged by ``min`` over all rows in one
    aggregate: boolean and long have no type in common but string, long widens to double.
    """
    if not texts.columns:
        return {}
    flags = []
    for i, c in enumerate(texts.columns):
        v = F.trim(F.col(f"`{c}`"))
        some = v.isNotNull() & ~v.isin(*MISSING)
        whole = v.rlike(_WHOLE) & v.try_cast("long").isNotNull()
        for kind, holds in (("boolean", v.isin(*_TRUTH)), ("long", whole), ("double", v.rlike(_NUMBER))):
            flags.append(F.min(F.when(some, holds)).alias(f"{kind}_{i}"))
    found = texts.agg(*flags).first()
    return {c: next((kind for kind in ("boolean", "long", "double") if found[f"{kind}_{i}"]), "string")
            for i, c in enumerate(texts.columns)}


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """IO1: CSV with a header, types inferred from every row (not a sample); missing texts are null.

    Two scans: one finds the types, the other reads with them. Columns stay in the file's
    order; strings keep their blanks.
    """
    texts = spark.read.option("header", True).option("inferSchema", False).csv(path)
    kinds = inferred_types(texts)
    out = []
    for c in texts.columns:
        v = F.col(f"`{c}`")
        missing = F.trim(v).isin(*MISSING)
        out.append((F.when(~missing, v) if kinds[c] == "string" else F.when(~missing, F.trim(v)).try_cast(kinds[c])).alias(c))
    return texts.select(*out)


def write_csv(df: DataFrame, path: str) -> str:
    """IO3/IO4: CSV table sink with header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """IO2/IO3: parquet sink (optionally partitioned so reads prune partitions)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file in one step; False if there is one already, which stays."""
    fs, target = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(target) and fs.rename(part, target):
        return True
    fs.delete(part, False)
    return False


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is no such file."""
    if not exists(spark, path):
        return None
    return spark.read.option("wholetext", True).text(path).first()[0]


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    fs, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def require_path(spark: SparkSession, path: str, hint: str) -> str:
    """IO6: fail early with an actionable message when a required input is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Required input not found: {path}. {hint}")
    return path


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """IO7: read the derived table if present, else build it, write it, and read it back."""
    if not exists(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def load_importance(spark: SparkSession, path: str) -> DataFrame | None:
    """IO8: importance table, or None when the file or its ``feature`` column is missing."""
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df if "feature" in df.columns else None
