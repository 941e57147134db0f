"""Scalar column functions (SC1-SC10) - all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.exact import isclose  # noqa: F401  (SC8 re-export)


def fixed(x, decimals: int) -> Column:
    """Fixed-point text like Python's ``f"{x:.{d}f}"``: half-to-even on the exact
    binary value (Java DecimalFormat), no grouping separators."""
    c = x if isinstance(x, Column) else F.col(x)
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_case(x) -> Column:
    """Python ``str.title``: upper-case a letter that follows a non-letter, lower-case
    the others (``initcap`` only splits on spaces: 'hba1c' -> 'Hba1C' here)."""
    chars = F.split(_c(x), "")
    def f(ch, i):
        prev = F.element_at(chars, i)  # 1-based: element i is the previous char
        starts = (i == 0) | ~prev.rlike("^[A-Za-z]$")
        return F.when(starts, F.upper(ch)).otherwise(F.lower(ch))
    return F.array_join(F.transform(chars, f), "")


def feature_label(x, overrides: dict[str, str] | None = None) -> Column:
    """SC1: override map, else '_' -> ' ' and title case."""
    base = title_case(F.regexp_replace(_c(x), "_", " "))
    if not overrides:
        return base
    m = F.create_map(*[v for k, val in overrides.items() for v in (F.lit(k), F.lit(val))])
    return F.coalesce(m[_c(x)], base)


def contains_ci(x, needle: str) -> Column:
    """SC2: lower-case substring test."""
    return F.lower(_c(x)).contains(needle.lower())


def strip_prefix(x, prefix: str) -> Column:
    """SC3: value without ``prefix`` when it starts with it, else unchanged."""
    c = _c(x)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def format_value(x, integer: bool) -> Column:
    """SC4: blank -> 'Imputed'; integer types plain; floats with 2 decimals."""
    c = _c(x)
    txt = c.cast("long").cast("string") if integer else fixed(c, 2)
    return F.when(c.isNull() | (F.isnan(c) if not integer else F.lit(False)), F.lit("Imputed")).otherwise(txt)


def abbreviate_list(arr, max_items: int = 4, label=None) -> Column:
    """SC5: 'a, b, c, d, +n more' over the labels of the first items; 'None' if empty."""
    a = _c(arr)
    lab = F.transform(F.slice(a, 1, max_items), label) if label else F.slice(a, 1, max_items)
    more = F.when(F.size(a) > max_items,
                  F.array(F.concat(F.lit("+"), (F.size(a) - max_items).cast("string"), F.lit(" more"))))
    joined = F.array_join(F.concat(lab, F.coalesce(more, F.array().cast("array<string>"))), ", ")
    return F.when(a.isNull() | (F.size(a) == 0), F.lit("None")).otherwise(joined)


def thousands(x) -> Column:
    """SC6: integer with thousands separators ('1,234')."""
    return F.format_number(_c(x).cast("long"), 0)


def percent_1dp(x) -> Column:
    """SC6: '%.1f%%' of a 0-100 value."""
    return F.format_string("%.1f%%", _c(x))


def clamp(x, lo, hi) -> Column:
    """SC7: min/max clamp."""
    return F.least(F.greatest(_c(x), F.lit(lo) if not isinstance(lo, Column) else lo),
                   F.lit(hi) if not isinstance(hi, Column) else hi)


def argsort_desc(arr) -> Column:
    """SC9: indices (0-based) of a numeric array by descending value; ties -> lower index."""
    a = _c(arr)
    z = F.transform(a, lambda v, i: F.struct(v.alias("v"), (-i).alias("ni")))
    return F.transform(F.sort_array(z, asc=False), lambda s: -s["ni"])


def slug(x) -> Column:
    """SC10: lower case, spaces -> underscores."""
    return F.regexp_replace(F.lower(_c(x)), " ", "_")
