"""Exact arithmetic helpers shared by operators (identical results across engines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_1dp(num: Column, den: Column) -> Column:
    """100*num/den rounded half-up to one decimal, from integers (no float rounding)."""
    n = num.cast("long")
    d = den.cast("long")
    tenths = F.when(d == 0, F.lit(0)).otherwise(F.floor((F.lit(2000) * n + d) / (F.lit(2) * d)))
    return (tenths.cast("decimal(20,0)") / F.lit(10)).cast("decimal(20,1)")


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NumPy ``isclose`` semantics: |a-b| <= atol + rtol*|b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def safe_div(num: Column, den: Column, zero: float = 0.0) -> Column:
    """num/den, ``zero`` when den == 0 (zero_division semantics)."""
    return F.when(den == 0, F.lit(zero)).otherwise(num.cast("double") / den.cast("double"))
