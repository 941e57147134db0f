"""Every registered query with an oracle matches DuckDB at sf0.001 (fast layer)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"sm5_jn5_smotenc", "sm5_class_counts"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def _pandas(df):
    """Whole numbers stay whole numbers beside nulls, as in DuckDB's frames."""
    out = df.toPandas()
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
            out[f.name] = out[f.name].astype("Int64")
    return out


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


NAMES = [n for n in E.oracle_sql() if n not in SLOW]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = _pandas(E.queries()[name](spark, SF))
    dd = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() > 0 and out.where("actions is null or actions = ''").count() == 0
