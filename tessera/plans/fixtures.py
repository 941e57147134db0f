"""Driver-table fixtures: class list and literal rule classifiers on order_profile.

The reference's fitted models are not available, so label/score-based evaluation
is exercised with deterministic rule classifiers whose outputs are reproducible in
SQL. Each rule model yields ``prediction`` (class name) and ``probability``
(array over the class list in code order) from normalised inverse distances to
literal per-class centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage classes in code (alphabetical) order.
STAGES = ["bulk", "empty", "large", "mid", "small"]

# Rule models. centre per class (code order), distance scale, the
# feature used, and threshold rules (first match wins, else the default class).
RULE_MODELS = {
    "price_rule": {
        "feature": "price_sum", "centres": [500000.0, 0.0, 260000.0, 140000.0, 80000.0],
        "scale": 50000.0,
        "rules": [("=", 0.0, "empty"), ("<", 60000.0, "small"), ("<", 200000.0, "mid")],
        "default": "large",
    },
    "centre_rule": {
        "feature": "price_sum", "centres": [500000.0, 0.0, 260000.0, 140000.0, 80000.0],
        "scale": 10000.0, "rules": None, "default": None,
    },
    "total_rule": {
        "feature": "total_price", "centres": [255000.0, 254000.0, 250000.0, 251000.0, 250500.0],
        "scale": 20000.0,
        "rules": [("<", 100000.0, "small"), ("<", 250000.0, "mid")],
        "default": "large",
    },
}


def _inv(x: Column, centre: float, scale: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(x - F.lit(centre)) / F.lit(scale))


def rule_scored(df: DataFrame, model: str, label_col: str = "stage") -> DataFrame:
    """Adds ``probability`` (array<double>) and ``prediction`` (class name)."""
    m = RULE_MODELS[model]
    x = F.col(m["feature"])
    invs = [_inv(x, c, m["scale"]) for c in m["centres"]]
    tot = invs[0]
    for v in invs[1:]:
        tot = tot + v
    prob = F.array(*[v / tot for v in invs])
    out = df.withColumn("probability", prob)
    if m["rules"] is None:
        names = F.array(*[F.lit(s) for s in STAGES])
        pos = F.array_position(F.col("probability"), F.array_max(F.col("probability")))
        pred = F.element_at(names, pos.cast("int"))
    else:
        pred = None
        for op, thr, cls in m["rules"]:
            cond = (x == F.lit(thr)) if op == "=" else (x < F.lit(thr))
            pred = F.when(cond, F.lit(cls)) if pred is None else pred.when(cond, F.lit(cls))
        pred = pred.otherwise(F.lit(m["default"]))
    return out.withColumn("prediction", pred).withColumn("label", F.col(label_col))


def rule_scored_sql(model: str, source: str = "t", label_col: str = "stage") -> str:
    """SQL text of ``rule_scored`` over relation ``source`` (same arithmetic order)."""
    m = RULE_MODELS[model]
    x = m["feature"]
    invs = [f"(1.0 / (1.0 + abs({x} - {c!r}) / {m['scale']!r}))" for c in m["centres"]]
    tot = "(" + " + ".join(invs) + ")"
    # left-to-right addition like the Spark expression tree
    tot = invs[0]
    for v in invs[1:]:
        tot = f"({tot} + {v})"
    prob = "[" + ", ".join(f"{v} / {tot}" for v in invs) + "]"
    if m["rules"] is None:
        names = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
        pred = f"{names}[list_position(probability, list_max(probability))]"
        inner = f"SELECT *, {prob} AS probability FROM {source}"
        return f"SELECT *, {pred} AS prediction, {label_col} AS label FROM ({inner}) r"
    whens = " ".join(
        f"WHEN {x} {'=' if op == '=' else '<'} {thr!r} THEN '{cls}'" for op, thr, cls in m["rules"])
    pred = f"CASE {whens} ELSE '{m['default']}' END"
    return (f"SELECT *, {prob} AS probability, {pred} AS prediction, {label_col} AS label "
            f"FROM {source}")
