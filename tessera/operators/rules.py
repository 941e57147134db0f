"""Decision rules over a scored batch/stream (DR1-DR11).

Rules are configuration (``RuleSet``): thresholds, texts and lookup tables. The
engine turns them into column expressions (``when`` chains, ``filter`` over an
array of candidate sentences, ``format_string``) evaluated row by row inside
whole-stage codegen; lookup tables are small literal maps. The same function
serves batch and Structured Streaming (stateless).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PH = re.compile(r"\{(v|m|a|b)\}")


@dataclass(frozen=True)
class ActionRule:
    """kind: 'tiers' (first matching tier wins), 'pair' (any-of on two columns,
    '?' when one is blank), 'range' (outside [lo, hi]), 'contains' (lower-case
    substring), 'flag' (>= 1). Threshold 'median' uses the training median."""

    kind: str
    cols: tuple[str, ...]
    tiers: tuple = ()
    decimals: int = 2


@dataclass(frozen=True)
class SegmentRule:
    """Segment recommendation: profile value ``cmp`` baseline (median, or
    max(floor, median) when ``floor`` is set) -> text."""

    col: str
    cmp: str  # '<' or '>'
    text: str
    floor: float | None = None


@dataclass
class RuleSet:
    actions: list[ActionRule]
    default_ok_class: str
    default_ok_text: str
    default_other_text: str
    segment_rules: list[SegmentRule]
    segment_default: str
    stage_texts: dict[str, dict[str, list[str]]]  # class or '*' -> {meaning, guidance, next_steps}
    combined_notes: dict[tuple[str, str], str]  # (class|'*', segment|'*') -> text
    segment_summaries: dict[str, str] = field(default_factory=dict)
    segment_summary_default: str = ""
    personal_none: str = "Priorities use the values entered."
    personal_all: str = "Priorities use all {n} entered inputs."
    personal_some: str = "Priorities use the {n} values entered. Blank fields were excluded from this section."


# ---------------------------------------------------------------- helpers
def entered_number(c: str, missing: Column | None = None) -> Column:
    """DR3: numeric value only if it was entered (not blank / unparseable / imputed)."""
    v = F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
    ok = v.isNotNull() & ~F.isnan(v)
    if missing is not None:
        ok = ok & ~F.array_contains(missing, F.lit(c))
    return F.when(ok, v)


def entered_text(c: str, missing: Column | None = None) -> Column:
    v = F.col(c).cast("string")
    ok = v.isNotNull() & (v != "")
    if missing is not None:
        ok = ok & ~F.array_contains(missing, F.lit(c))
    return F.when(ok, v)


def _fmt(x: Column, decimals: int) -> Column:
    from tessera.functions.scalar import fixed
    return fixed(x, decimals)


def render(template: str, values: dict[str, Column]) -> Column:
    """Template with {v} {m} {a} {b} placeholders -> concat of literals and columns."""
    parts, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _cmp(v: Column, op: str, t: Column) -> Column:
    return {"<": v < t, "<=": v <= t, ">": v > t, ">=": v >= t}[op]


def action_column(rule: ActionRule, medians: dict[str, float], missing: Column | None) -> Column:
    if rule.kind == "tiers":
        c = rule.cols[0]
        v = entered_number(c, missing)
        out = None
        for op, thr, text in rule.tiers:
            t = F.lit(float(medians[c] if thr == "median" else thr))
            vals = {"v": _fmt(v, rule.decimals)}
            if thr == "median":
                vals["m"] = _fmt(F.lit(float(medians[c])), rule.decimals)
            cond = v.isNotNull() & _cmp(v, op, t)
            out = F.when(cond, render(text, vals)) if out is None else out.when(cond, render(text, vals))
        return out
    if rule.kind == "pair":
        a, b = (entered_number(c, missing) for c in rule.cols)
        ta = F.coalesce(_fmt(a, rule.decimals), F.lit("?"))
        tb = F.coalesce(_fmt(b, rule.decimals), F.lit("?"))
        out = None
        for (t1, t2), text in rule.tiers:
            cond = (a.isNotNull() & (a >= F.lit(float(t1)))) | (b.isNotNull() & (b >= F.lit(float(t2))))
            r = render(text, {"a": ta, "b": tb})
            out = F.when(cond, r) if out is None else out.when(cond, r)
        return out
    if rule.kind == "range":
        v = entered_number(rule.cols[0], missing)
        (lo, hi), text = rule.tiers
        return F.when(v.isNotNull() & ((v < F.lit(float(lo))) | (v > F.lit(float(hi)))),
                      render(text, {"v": _fmt(v, rule.decimals)}))
    if rule.kind == "contains":
        t = entered_text(rule.cols[0], missing)
        needle, text = rule.tiers
        return F.when(t.isNotNull() & F.lower(t).contains(needle.lower()), F.lit(text))
    if rule.kind == "flag":
        v = entered_number(rule.cols[0], missing)
        (text,) = rule.tiers
        return F.when(v.isNotNull() & (v >= F.lit(1.0)), F.lit(text))
    raise ValueError(f"unknown rule kind {rule.kind}")


# ---------------------------------------------------------------- DR3 / DR4
def patient_actions(df: DataFrame, rules: RuleSet, medians: dict[str, float],
                    predicted_col: str = "predicted", missing_col: str | None = "missing_columns",
                    out_col: str = "actions") -> DataFrame:
    """DR3/DR4: fired action sentences in rule order; the default sentence when none fired."""
    missing = F.col(missing_col) if missing_col and missing_col in df.columns else None
    arr = F.filter(F.array(*[action_column(r, medians, missing) for r in rules.actions]),
                   lambda x: x.isNotNull())
    default = F.when(F.col(predicted_col) == F.lit(rules.default_ok_class), F.lit(rules.default_ok_text)) \
        .otherwise(F.lit(rules.default_other_text))
    return df.withColumn(out_col, F.when(F.size(arr) == 0, F.array(default)).otherwise(arr))


# ---------------------------------------------------------------- DR1 / DR2 / WN7
def stage_result(df: DataFrame, classes: list[str], prob_col: str = "probability") -> DataFrame:
    """DR1/WN7: predicted class, confidence, runner-up and gap max(p1 - p2, 0).
    Ties -> lower class code first."""
    names = F.array(*[F.lit(c) for c in classes])
    z = F.transform(F.col(prob_col), lambda p, i: F.struct(p.alias("p"), (-i).alias("ni")))
    srt = F.sort_array(z, asc=False)
    top, second = F.element_at(srt, 1), F.element_at(srt, 2)
    return (df.withColumn("predicted", F.element_at(names, (-top["ni"] + 1).cast("int")))
              .withColumn("confidence", top["p"])
              .withColumn("runner_up", F.element_at(names, (-second["ni"] + 1).cast("int")))
              .withColumn("runner_up_probability", second["p"])
              .withColumn("gap", F.greatest(top["p"] - second["p"], F.lit(0.0))))


def probability_rows(df: DataFrame, classes: list[str], id_col: str,
                     prob_col: str = "probability", predicted_col: str = "predicted") -> DataFrame:
    """DR2: one row per (row, class) with a Predicted/Other flag and a '%.1f%%' label."""
    names = F.array(*[F.lit(c) for c in classes])
    ex = df.select(id_col, predicted_col, F.posexplode(prob_col).alias("code", "probability"))
    ex = ex.withColumn("class_name", F.element_at(names, F.col("code") + 1))
    return ex.select(id_col, "code", "class_name", "probability",
                     F.when(F.col("class_name") == F.col(predicted_col), "Predicted").otherwise("Other").alias("flag"),
                     F.concat(_fmt(F.col("probability") * 100, 1), F.lit("%")).alias("label"))


# ---------------------------------------------------------------- DR5
def segment_recommendations(profiles: DataFrame, rules: RuleSet, medians: dict[str, float],
                            cluster_col: str = "cluster") -> DataFrame:
    """DR5: profile vs training medians -> recommendation lines; default if none."""
    items = []
    for r in rules.segment_rules:
        base = medians[r.col] if r.floor is None else max(r.floor, medians[r.col])
        v = F.coalesce(F.col(r.col), F.lit(0.0))
        items.append(F.when(_cmp(v, r.cmp, F.lit(float(base))), F.lit(r.text)))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return profiles.select(cluster_col, F.when(F.size(arr) == 0, F.array(F.lit(rules.segment_default)))
                           .otherwise(arr).alias("recommendations"))


# ---------------------------------------------------------------- DR6 / DR7 / DR8
def _text_map(d: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def stage_texts(df: DataFrame, rules: RuleSet, predicted_col: str = "predicted") -> DataFrame:
    """DR6: meaning / guidance / next-step sentences by predicted class (default '*')."""
    out = df
    for part in ("meaning", "guidance", "next_steps"):
        m = F.create_map(*[x for k, v in rules.stage_texts.items() if k != "*"
                           for x in (F.lit(k), F.array(*[F.lit(s) for s in v[part]]))])
        dflt = F.array(*[F.lit(s) for s in rules.stage_texts["*"][part]])
        out = out.withColumn(part, F.coalesce(m[F.col(predicted_col)], dflt))
    return out


def combined_note(df: DataFrame, rules: RuleSet, predicted_col: str = "predicted",
                  segment_col: str = "segment_key") -> DataFrame:
    """DR7: most specific of (class, segment), (class, '*'), ('*', '*')."""
    exact = {f"{c}|{s}": t for (c, s), t in rules.combined_notes.items() if c != "*" and s != "*"}
    by_cls = {c: t for (c, s), t in rules.combined_notes.items() if c != "*" and s == "*"}
    dflt = rules.combined_notes[("*", "*")]
    key = F.concat_ws("|", F.col(predicted_col), F.coalesce(F.col(segment_col), F.lit("")))
    note = F.coalesce(_text_map(exact)[key], _text_map(by_cls)[F.col(predicted_col)], F.lit(dflt))
    return df.withColumn("combined_note", note)


def personalisation_note(df: DataFrame, rules: RuleSet, n_features: int,
                         missing_col: str = "missing_columns") -> DataFrame:
    """DR8: entered = features - missing."""
    m = F.col(missing_col)
    n = (F.lit(n_features) - F.coalesce(F.size(m), F.lit(0))).cast("string")
    def r(t):
        pre, _, post = t.partition("{n}")
        return F.concat(F.lit(pre), n, F.lit(post)) if "{n}" in t else F.lit(t)
    note = (F.when(m.isNull(), F.lit(rules.personal_none))
             .when(F.size(m) == 0, r(rules.personal_all)).otherwise(r(rules.personal_some)))
    return df.withColumn("personalisation_note", note)


# ---------------------------------------------------------------- DR9 / DR10
def fallback_texts(spec, fill: dict[str, float], means: dict[str, float],
                   nominal: dict[str, list[str]], spark) -> DataFrame:
    """DR9: blank-field default description per feature kind (small config table)."""
    rows = []
    ordl = spec.ordinal_levels
    for c in spec.features:
        if c in spec.numeric:
            t = f"Average if blank: {means[c]:.2f}"
        elif c in spec.binary:
            t = "Default if blank: " + ("Yes" if int(round(fill[c])) == 1 else "No")
        else:
            cats = list(ordl[c]) if c in ordl else list(nominal[c])
            i = int(round(fill[c]))
            t = f"Default if blank: {cats[i]}" if 0 <= i < len(cats) else "Default if blank: most common value"
        rows.append((c, t))
    return spark.createDataFrame(rows, "feature string, fallback_text string")


def allowed_values(spec, nominal: dict[str, list[str]], spark) -> DataFrame:
    """DR10: allowed values per categorical field, in code order."""
    rows = [(c, i, v) for c, lv in spec.ordinal for i, v in enumerate(lv)]
    rows += [(c, i, v) for c in spec.nominal if isinstance(nominal[c], list) for i, v in enumerate(nominal[c])]
    rows += [(c, i, str(i)) for c in spec.binary for i in (0, 1)]
    out = spark.createDataFrame(rows, "feature string, code int, value string")
    for c in spec.nominal:
        if not isinstance(nominal[c], list):  # many categories: a table of codes
            out = out.unionByName(nominal[c].frame(spark).select(F.lit(c).alias("feature"), F.col("code").cast("int").alias("code"), "value"))
    return out
