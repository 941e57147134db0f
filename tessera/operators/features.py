"""Feature encoding, scaling, imputation and projection (FE1-FE10).

Fitting reads only small aggregates to the driver (category lists up to
``MAX_LITERALS``, one row of means/stds); transforms are pure column
expressions (``create_map`` lookups, arithmetic) inside whole-stage codegen, so
scoring a 100 TB table is one narrow map stage. A column of more categories has a
``CodeTable`` instead of a list: ranked on the executors, written, and joined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ordering import exact_rank_global
from tessera.plans.spec import TableSpec
from tessera.sources.io import scratch_path

#: Most categories of a column that become literals of an expression.
MAX_LITERALS = 10_000
#: Bytes of a code table that is sent to every executor.
SENT_BYTES = 64 << 20


@dataclass
class CodeTable:
    """Codes of a column with many categories, as a written table (value, code)."""

    path: str
    size: int
    bytes: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def codes(self, df: DataFrame, col: str) -> DataFrame:
        """``df`` with ``__code``; null where the value has none."""
        table = self.frame(df.sparkSession).withColumnsRenamed({"value": "__value", "code": "__code"})
        table = F.broadcast(table) if self.bytes <= SENT_BYTES else table
        return df.join(table, F.col(col).cast("string") == F.col("__value"), "left").drop("__value")


def _map_expr(mapping: dict) -> Column:
    if not mapping:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])


def fit_categories(df: DataFrame, cols: list[str], max_literals: int = MAX_LITERALS) -> dict[str, list[str] | CodeTable]:
    """FE1/FE4 fit: sorted distinct non-null values per column (one pass, partial agg).

    Lists of at most ``max_literals`` values reach the driver; a column of more has a
    ``CodeTable``, whose codes are the same: the value's place among all, from 0.
    """
    if not cols:
        return {}
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                             for c in cols]))
    d = (df.select(kv.alias("kv")).select("kv.c", "kv.v").where(F.col("v").isNotNull())
           .distinct())
    sizes = {r["c"]: (r["n"], r["b"]) for r in d.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v") + 32).alias("b")).collect()}  # one row a column
    out: dict[str, list[str] | CodeTable] = {c: [] for c in cols}
    few = [c for c in cols if sizes.get(c, (0, 0))[0] <= max_literals]
    for r in d.where(F.col("c").isin(few)).collect():
        out[r["c"]].append(r["v"])
    out = {c: sorted(v) for c, v in out.items()}
    for c in cols:
        if c not in few:
            path = scratch_path(df.sparkSession, "codes")
            ranked = exact_rank_global(d.where(F.col("c") == c).select("v"), "v", "v")
            ranked.select(F.col("v").alias("value"), (F.col("rank") - 1).cast("double").alias("code")).write.parquet(path)
            out[c] = CodeTable(path, *sizes[c])
    return out


def encode_labels(df: DataFrame, col: str, classes: list[str] | CodeTable, out_col: str | None = None,
                  unknown: float | None = None, strict: bool = False) -> DataFrame:
    """FE1/FE4 transform: code = position in sorted class list (double).

    Unknown values -> ``unknown`` (null by default); ``strict`` raises instead.
    """
    if isinstance(classes, CodeTable):
        df, code = classes.codes(df, col), F.col("__code")
    else:
        code = _map_expr({c: i for i, c in enumerate(classes)})[F.col(col).cast("string")]
    if strict:
        code = F.when(code.isNull() & F.col(col).isNotNull(),
                      F.raise_error(F.concat(F.lit(f"unknown label in {col}: "), F.col(col).cast("string")))
                      ).otherwise(code)
    if unknown is not None:
        code = F.when(F.col(col).isNull(), F.lit(None).cast("double")).otherwise(
            F.coalesce(code, F.lit(float(unknown))))
    return df.withColumn(out_col or col, code.cast("double")).drop("__code")


def decode_labels(df: DataFrame, col: str, classes: list[str], out_col: str) -> DataFrame:
    """FE2: code -> name."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out_col, F.element_at(names, (F.col(col).cast("int") + 1)))


def encode_ordinal(df: DataFrame, col: str, levels: tuple[str, ...], out_col: str | None = None) -> DataFrame:
    """FE3: fixed-order ordinal code, unknown -> -1 (nulls stay null)."""
    code = _map_expr({c: i for i, c in enumerate(levels)})[F.col(col)]
    code = F.when(F.col(col).isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(code, F.lit(-1.0)))
    return df.withColumn(out_col or col, code)


@dataclass
class Preprocessor:
    """FE6: fitted preprocessing state (encoders, scaler, fill values)."""

    spec: TableSpec
    classes: list[str]
    nominal: dict[str, list[str] | CodeTable]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    fill: dict[str, float] = field(default_factory=dict)

    # ---------------------------------------------------------------- transform
    def encode(self, df: DataFrame, strict: bool = False, label: bool = True) -> DataFrame:
        """Typed, encoded features (double) + ``label`` code; other columns kept."""
        s = self.spec
        out = df
        if label and s.target in df.columns:
            out = encode_labels(out, s.target, self.classes, "label", strict=strict)
        have = set(df.columns)
        for c in s.numeric + s.binary:
            if c in have:
                out = out.withColumn(c, F.col(c).cast("double"))
        for c, lv in s.ordinal:
            if c in have:
                out = encode_ordinal(out, c, lv)
        for c in s.nominal:
            if c in have:
                out = encode_labels(out, c, self.nominal[c], unknown=None if strict else -1.0,
                                    strict=strict)
        return out

    def scale(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """FE5: (x - mean) / std_pop; a constant column divides by 1."""
        cols = []
        for c in self.spec.features:
            sd = self.stds.get(c) or 1.0
            cols.append(((F.col(c) - F.lit(self.means[c])) / F.lit(sd)).alias(c + suffix))
        keep = [c for c in df.columns if suffix or c not in self.spec.features]
        return df.select(*keep, *cols)

    def impute(self, df: DataFrame, missing_col: str | None = "missing_columns") -> DataFrame:
        """FE7/FE8: fill nulls with train mean (numeric) / mode (others) and list
        the filled columns per row (feature order)."""
        feats = self.spec.features
        out = df
        if missing_col:
            out = out.withColumn(missing_col, F.filter(
                F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in feats]), lambda x: x.isNotNull()))
        return out.select(*[c for c in out.columns if c not in feats],
                          *[F.coalesce(F.col(c), F.lit(self.fill[c])).alias(c) for c in feats])

    def vector(self, df: DataFrame, cols: list[str] | None = None, out_col: str = "features") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        return VectorAssembler(inputCols=list(cols or self.spec.features), outputCol=out_col,
                               handleInvalid="keep").transform(df)

    # ---------------------------------------------------------------- persistence (IO5)
    def save(self, path: str) -> None:
        """Written by Spark, so ``path`` may be in any store that the executors share."""
        spark = SparkSession.active()
        nominal = dict(self.nominal)
        for c, v in nominal.items():
            if isinstance(v, CodeTable):
                v.frame(spark).write.mode("overwrite").parquet(f"{path}/codes/{c}")
                nominal[c] = {"path": f"{path}/codes/{c}", "size": v.size, "bytes": v.bytes}
        state = {"classes": self.classes, "nominal": nominal, "means": self.means,
                 "stds": self.stds, "fill": self.fill}
        one = spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "state string")
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/preprocessor")

    @classmethod
    def load(cls, path: str, spec: TableSpec) -> "Preprocessor":
        from tessera.sources.io import exists
        spark, p = SparkSession.active(), f"{path}/preprocessor"
        if not exists(spark, p):
            raise FileNotFoundError(f"missing fitted preprocessor: {p}; run the fit step first")
        state = json.loads(spark.read.parquet(p).first()["state"])
        state["nominal"] = {c: CodeTable(**v) if isinstance(v, dict) else v for c, v in state["nominal"].items()}
        return cls(spec=spec, **state)


def fit_preprocessor(train: DataFrame, spec: TableSpec) -> Preprocessor:
    """FE6: fit target/nominal encoders, then scaler and fill values on encoded train.

    Two small driver round trips: the distinct category lists, then one row of
    aggregates (mean, population std, mode per feature).
    """
    cats = fit_categories(train, [spec.target, *spec.nominal])
    pre = Preprocessor(spec=spec, classes=cats[spec.target],
                       nominal={c: cats[c] for c in spec.nominal})
    enc = pre.encode(train, strict=True)
    aggs = []
    for c in spec.features:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
        if c not in spec.numeric:
            aggs.append(F.mode(c, True).alias(f"o__{c}"))
    row = enc.agg(*aggs).first().asDict()
    pre.means = {c: float(row[f"m__{c}"]) if row[f"m__{c}"] is not None else 0.0 for c in spec.features}
    pre.stds = {c: float(row[f"s__{c}"] or 0.0) for c in spec.features}
    pre.fill = {c: (pre.means[c] if c in spec.numeric else float(row[f"o__{c}"]))
                for c in spec.features}
    return pre


def scoring_features(raw: DataFrame, pre: Preprocessor) -> DataFrame:
    """FE8: raw (possibly string-typed) rows -> coerced, encoded, imputed features +
    ``missing_columns`` + scaled copies (suffix ``_scaled``).

    Numbers parse with ``try_cast`` (unparseable -> null -> imputed); unknown
    categories -> -1; blanks -> train mean/mode and listed as missing.
    """
    s = pre.spec
    out = raw
    for c in s.numeric + s.binary:
        out = out.withColumn(c, F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)"))
    for c in s.ordinal_cols + s.nominal:
        out = out.withColumn(c, F.when(F.trim(F.col(c).cast("string")) == "", None).otherwise(F.col(c)))
    out = pre.encode(out, strict=False, label=False)
    out = pre.impute(out)
    return pre.scale(out, suffix="_scaled")
