"""Registered queries: decision rules and scalar functions (DR1-DR11, SC1-SC10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as SC
from tessera.functions.quantiles import exact_quantiles
from tessera.operators import features as FE
from tessera.operators import rules as R
from tessera.operators import segments as SG
from tessera.plans.fixtures import STAGES, rule_scored, rule_scored_sql
from tessera.plans.order_rules import ORDER_RULES, ORDER_SEGMENT_COLORS, ORDER_SEGMENT_LABELS
from tessera.plans.q_core import op, op_split
from tessera.plans.spec import ORDER_SPEC
from tessera.plans.sqltext import OP_CTE, split_ctes

QUERIES: dict = {}
SQL: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


S = ORDER_SPEC
RS = ORDER_RULES
MED_COLS = sorted({r.cols[0] for r in RS.actions if r.kind == "tiers" and any(t[1] == "median" for t in r.tiers)}
                  | {r.col for r in RS.segment_rules})


def medians(spark, sf) -> dict[str, float]:
    tr = op_split(spark, sf).where(F.col("split") == "train")
    q = exact_quantiles(tr.unpivot("row_id", MED_COLS, "feature", "v"), "v", [0.5], ["feature"]).collect()
    return {r["feature"]: float(r["value"]) for r in q}


def subjects(spark, sf):
    """Test-split orders scored by the price rule, with DR1 columns and missing list."""
    te = op_split(spark, sf).where(F.col("split") == "test")
    sc = rule_scored(te, "centre_rule")
    sc = R.stage_result(sc, STAGES)
    miss = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in S.features]), lambda x: x.isNotNull())
    return sc.withColumn("missing_columns", miss)


_names = "[" + ", ".join(f"'{c}'" for c in STAGES) + "]"
SUBJ_SQL = f"""WITH {OP_CTE},{split_ctes()},
scored AS ({rule_scored_sql('centre_rule', "(SELECT * FROM split WHERE split = 'test')")}),
pr AS (SELECT row_id, generate_subscripts(probability, 1) - 1 AS code, UNNEST(probability) AS p FROM scored),
rk AS (SELECT row_id, code, p, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY p DESC, code) AS r FROM pr),
top2 AS (SELECT row_id, MAX(CASE WHEN r = 1 THEN code END) AS c1, MAX(CASE WHEN r = 1 THEN p END) AS p1,
                MAX(CASE WHEN r = 2 THEN code END) AS c2, MAX(CASE WHEN r = 2 THEN p END) AS p2 FROM rk GROUP BY row_id),
subj AS (SELECT s.*, {_names}[t.c1 + 1] AS predicted, t.p1 AS confidence, {_names}[t.c2 + 1] AS runner_up,
                t.p2 AS runner_up_probability, GREATEST(t.p1 - t.p2, 0.0) AS gap,
                list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in S.features)}], lambda x: x IS NOT NULL) AS missing_columns
         FROM scored s JOIN top2 t USING (row_id)),
med AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in MED_COLS)} FROM split WHERE split = 'train')"""


# DR1 ------------------------------------------------------------------------
reg("dr1_stage_result", SUBJ_SQL + " SELECT row_id, predicted, confidence, runner_up, runner_up_probability, gap FROM subj")(
    lambda spark, sf: subjects(spark, sf).select("row_id", "predicted", "confidence", "runner_up",
                                                 "runner_up_probability", "gap"))

# DR2 ------------------------------------------------------------------------
reg("dr2_probability_rows", SUBJ_SQL + f""", ex AS (SELECT row_id, predicted, generate_subscripts(probability, 1) - 1 AS code,
UNNEST(probability) AS probability FROM subj)
SELECT row_id, code, {_names}[code + 1] AS class_name, probability,
CASE WHEN {_names}[code + 1] = predicted THEN 'Predicted' ELSE 'Other' END AS flag,
printf('%.1f%%', probability * 100) AS label FROM ex""")(
    lambda spark, sf: R.probability_rows(subjects(spark, sf), STAGES, "row_id"))


# DR3 / DR4 ------------------------------------------------------------------
def _sql_num(c):
    return f"(CASE WHEN {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)) AND NOT list_contains(missing_columns, '{c}') THEN CAST({c} AS DOUBLE) END)"


def _sql_render(t, vals):
    out, pos = [], 0
    for m in R._PH.finditer(t):
        if m.start() > pos:
            out.append("'" + t[pos:m.start()].replace("'", "''") + "'")
        out.append(vals[m.group(1)])
        pos = m.end()
    if pos < len(t):
        out.append("'" + t[pos:].replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def _sql_action(r):
    if r.kind == "tiers":
        v = _sql_num(r.cols[0])
        whens = []
        for op_, thr, text in r.tiers:
            t = f"(SELECT med_{r.cols[0]} FROM med)" if thr == "median" else repr(float(thr))
            vals = {"v": f"printf('%.{r.decimals}f', {v})", "m": f"printf('%.{r.decimals}f', {t})"}
            whens.append(f"WHEN {v} IS NOT NULL AND {v} {op_} {t} THEN {_sql_render(text, vals)}")
        return "CASE " + " ".join(whens) + " END"
    if r.kind == "pair":
        a, b = (_sql_num(c) for c in r.cols)
        ta = f"COALESCE(printf('%.{r.decimals}f', {a}), '?')"
        tb = f"COALESCE(printf('%.{r.decimals}f', {b}), '?')"
        whens = [f"WHEN ({a} IS NOT NULL AND {a} >= {float(t1)!r}) OR ({b} IS NOT NULL AND {b} >= {float(t2)!r}) "
                 f"THEN {_sql_render(text, {'a': ta, 'b': tb})}" for (t1, t2), text in r.tiers]
        return "CASE " + " ".join(whens) + " END"
    if r.kind == "range":
        v = _sql_num(r.cols[0])
        (lo, hi), text = r.tiers
        return (f"CASE WHEN {v} IS NOT NULL AND ({v} < {float(lo)!r} OR {v} > {float(hi)!r}) "
                f"THEN {_sql_render(text, {'v': f'printf({chr(39)}%.{r.decimals}f{chr(39)}, {v})'})} END")
    if r.kind == "contains":
        c = r.cols[0]
        needle, text = r.tiers
        return (f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' AND NOT list_contains(missing_columns, '{c}') "
                f"AND contains(lower(CAST({c} AS VARCHAR)), '{needle.lower()}') THEN '{text}' END")
    if r.kind == "flag":
        v = _sql_num(r.cols[0])
        (text,) = r.tiers
        return f"CASE WHEN {v} IS NOT NULL AND {v} >= 1.0 THEN '{text}' END"
    raise ValueError(r.kind)


_acts = "list_filter([" + ", ".join(_sql_action(r) for r in RS.actions) + "], lambda x: x IS NOT NULL)"
_dflt = f"CASE WHEN predicted = '{RS.default_ok_class}' THEN '{RS.default_ok_text}' ELSE '{RS.default_other_text}' END"
ACTIONS_SQL = SUBJ_SQL + f""", act AS (SELECT *, {_acts} AS a0 FROM subj),
act2 AS (SELECT *, CASE WHEN len(a0) = 0 THEN [{_dflt}] ELSE a0 END AS actions FROM act)"""


def actions_df(spark, sf):
    return R.patient_actions(subjects(spark, sf), RS, medians(spark, sf))


reg("dr3_dr4_patient_actions", ACTIONS_SQL + " SELECT row_id, predicted, len(actions) AS n_actions, array_to_string(actions, ' | ') AS actions FROM act2")(
    lambda spark, sf: actions_df(spark, sf).select("row_id", "predicted", F.size("actions").alias("n_actions"),
                                                 F.array_join("actions", " | ").alias("actions")))

# DR6 / DR7 / DR8 --------------------------------------------------------------
_exact = {f"{c}|{s}": t for (c, s), t in RS.combined_notes.items() if c != "*" and s != "*"}
_bycls = {c: t for (c, s), t in RS.combined_notes.items() if c != "*" and s == "*"}


def _case_map(expr, d, default):
    w = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {w} ELSE {default} END"


def _stage_list(part):
    w = " ".join(f"WHEN predicted = '{k}' THEN [{', '.join(repr(x) for x in v[part])}]"
                 for k, v in RS.stage_texts.items() if k != "*")
    return f"CASE {w} ELSE [{', '.join(repr(x) for x in RS.stage_texts['*'][part])}] END"


def _texts(spark, sf):
    d = R.stage_texts(subjects(spark, sf), RS)
    d = d.withColumn("segment_key", F.when(F.col("has_open") == 1, "strained").when(F.col("has_return") == 1, "steady"))
    d = R.combined_note(d, RS)
    d = R.personalisation_note(d, RS, len(S.features))
    return d.select("row_id", F.array_join("meaning", " | ").alias("meaning"),
                    F.array_join("guidance", " | ").alias("guidance"),
                    F.array_join("next_steps", " | ").alias("next_steps"), "combined_note", "personalisation_note")


_n = len(S.features)
_pn = (f"CASE WHEN missing_columns IS NULL THEN '{RS.personal_none}' "
       f"WHEN len(missing_columns) = 0 THEN replace('{RS.personal_all}', '{{n}}', CAST({_n} - len(missing_columns) AS VARCHAR)) "
       f"ELSE replace('{RS.personal_some}', '{{n}}', CAST({_n} - len(missing_columns) AS VARCHAR)) END")
reg("dr6_dr8_stage_texts_notes", SUBJ_SQL + f""", sk AS (SELECT *, CASE WHEN has_open = 1 THEN 'strained' WHEN has_return = 1 THEN 'steady' END AS segment_key FROM subj)
SELECT row_id, array_to_string({_stage_list('meaning')}, ' | ') AS meaning,
       array_to_string({_stage_list('guidance')}, ' | ') AS guidance,
       array_to_string({_stage_list('next_steps')}, ' | ') AS next_steps,
       {_case_map("predicted || '|' || COALESCE(segment_key, '')", _exact, _case_map('predicted', _bycls, repr(RS.combined_notes[('*', '*')])))} AS combined_note,
       {_pn} AS personalisation_note FROM sk""")(_texts)


# DR5 ------------------------------------------------------------------------
def _dr5(spark, sf):
    from tessera.plans.q_segments import profiles
    prof = profiles(spark, sf)
    tr = op_split(spark, sf).where(F.col("split") == "train")
    q = exact_quantiles(tr.unpivot("row_id", [r.col for r in RS.segment_rules], "feature", "v"), "v", [0.5],
                        ["feature"]).collect()
    med = {r["feature"]: float(r["value"]) for r in q}
    rec = R.segment_recommendations(prof, RS, med)
    return rec.select("cluster", F.array_join("recommendations", " | ").alias("recommendations"))


def _dr5_sql():
    from tessera.plans.q_segments import CLUSTER_SQL
    items = []
    for r in RS.segment_rules:
        base = f"(SELECT quantile_cont({r.col}, 0.5) FROM split WHERE split = 'train')"
        if r.floor is not None:
            base = f"GREATEST({float(r.floor)!r}, {base})"
        items.append(f"CASE WHEN COALESCE({r.col}, 0.0) {r.cmp} {base} THEN '{r.text}' END")
    arr = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return (CLUSTER_SQL + f", rr AS (SELECT cluster, {arr} AS a FROM prof) SELECT cluster, "
            f"array_to_string(CASE WHEN len(a) = 0 THEN ['{RS.segment_default}'] ELSE a END, ' | ') AS recommendations FROM rr")


reg("dr5_segment_recommendations", _dr5_sql())(_dr5)


# DR9 / DR10 -----------------------------------------------------------------
def _dr9(spark, sf):
    tr = op_split(spark, sf).where(F.col("split") == "train")
    pre = FE.fit_preprocessor(tr, S)
    enc = pre.encode(tr, strict=True)
    num = [F.struct(F.lit(c).alias("feature"),
                    F.format_string("Average if blank: %.2f", F.avg(c)).alias("fallback_text")) for c in S.numeric]
    return enc.agg(F.array(*num).alias("a")).select(F.explode("a").alias("r")).select("r.*")


reg("dr9_fallback_texts_numeric", f"WITH {OP_CTE},{split_ctes()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, printf('Average if blank: %.2f', AVG(CAST({c} AS DOUBLE))) AS fallback_text FROM split WHERE split = 'train'"
    for c in S.numeric))(_dr9)


def _dr10(spark, sf):
    tr = op_split(spark, sf).where(F.col("split") == "train")
    return R.allowed_values(S, FE.fit_preprocessor(tr, S).nominal, spark)


_levels = [(c, i, v) for c, levels in S.ordinal for i, v in enumerate(levels)] + [(c, i, str(i)) for c in S.binary for i in (0, 1)]
reg("dr10_allowed_values", f"WITH {OP_CTE},{split_ctes()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code, v AS value "
    f"FROM (SELECT DISTINCT {c} AS v FROM split WHERE split = 'train' AND {c} IS NOT NULL) d" for c in S.nominal)
    + f" UNION ALL SELECT * FROM (VALUES {', '.join(f'({c!r}, {i}, {v!r})' for c, i, v in _levels)}) l(feature, code, value)")(_dr10)


# DR11 -----------------------------------------------------------------------
def _segment_texts(spark, sf):
    """DR5 and SG6 lines of every cluster (one row each)."""
    from tessera.plans import q_segments
    meaning = q_segments._sg6(spark, sf).select("cluster", F.col("summary").alias("segment_summary"))
    return meaning.join(_dr5(spark, sf).select("cluster", F.col("recommendations").alias("segment_recommendations")), "cluster")


def _dr11(spark, sf):
    from tessera.plans.q_segments import clustered, keys
    a = actions_df(spark, sf)
    _, a_te, _ = clustered(spark, sf)
    k = SG.segment_display(keys(spark, sf), ORDER_SEGMENT_LABELS, ORDER_SEGMENT_COLORS)
    j = a.join(a_te.select("row_id", "cluster"), "row_id").join(k, "cluster")
    j = R.personalisation_note(R.stage_texts(R.combined_note(j, RS), RS), RS, len(S.features))
    j = j.join(F.broadcast(_segment_texts(spark, sf)), "cluster", "left")
    lists = [F.array_join(c, " | ").alias(c) for c in ("actions", "meaning", "guidance", "next_steps")]
    return j.select("row_id", "predicted", "confidence", "runner_up", "gap", "cluster", "cluster_name", "segment_key",
                    "combined_note", "personalisation_note", F.size("actions").alias("n_actions"), *lists,
                    "segment_summary", "segment_recommendations")


def _dr11_sql():
    from tessera.plans.q_segments import DISPLAY_SQL
    body = DISPLAY_SQL.split("WITH ", 1)[1]
    acts = ACTIONS_SQL.split("WITH ", 1)[1]
    # both start with the same order_profile / split CTEs; keep the cluster chain and append actions
    extra = acts.split("med AS", 1)[1]
    sub = acts.split("scored AS", 1)[1].split("med AS", 1)[0]
    rec = _dr5_sql().split("rr AS", 1)[1].split(") SELECT", 1)[0] + ")"
    summ = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RS.segment_summaries.items())
    lists = ", ".join(f"array_to_string({e}, ' | ') AS {n}" for n, e in (
        ("actions", "a.actions"), ("meaning", _stage_list("meaning")), ("guidance", _stage_list("guidance")),
        ("next_steps", _stage_list("next_steps"))))
    return (f"WITH {body}, scored AS {sub} med AS {extra}, rr AS {rec}"
            f" SELECT a.row_id, a.predicted, a.confidence, a.runner_up, a.gap, {_pn} AS personalisation_note, {lists}, "
            f"COALESCE(CASE d.segment_key {summ} END, '{RS.segment_summary_default}') AS segment_summary, "
            f"array_to_string(CASE WHEN len(rr.a) = 0 THEN ['{RS.segment_default}'] ELSE rr.a END, ' | ') AS segment_recommendations, t.cluster, d.cluster_name, d.segment_key, "
            f"{_case_map(chr(39) + chr(39) + ' || a.predicted || ' + chr(39) + '|' + chr(39) + ' || COALESCE(d.segment_key, ' + chr(39) + chr(39) + ')', _exact, _case_map('a.predicted', _bycls, repr(RS.combined_notes[('*', '*')])))} AS combined_note, "
            f"len(a.actions) AS n_actions FROM act2 a JOIN assigned_test t USING (row_id) JOIN disp d ON d.cluster = t.cluster "
            f"LEFT JOIN rr ON rr.cluster = t.cluster")


reg("dr11_recommendation_record", _dr11_sql())(_dr11)


# SC1-SC10 -------------------------------------------------------------------
def _sc(spark, sf):
    d = op(spark, sf)
    arr = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in S.features] +
                           [F.when(F.col("has_return") == 1, F.lit("has_return")),
                            F.when(F.col("has_open") == 1, F.lit("has_open")),
                            F.when(F.col("neg_balance") == 1, F.lit("neg_balance")),
                            F.when(F.col("tax_sum") > 0.3, F.lit("tax_sum")),
                            F.when(F.col("disc_sum") > 0.3, F.lit("disc_sum"))]), lambda x: x.isNotNull())
    return d.select(
        "row_id",
        SC.feature_label(F.concat(F.lower("segment"), F.lit("_"), F.lit("a1b"))).alias("sc1_label"),
        SC.contains_ci("priority", "URGENT").alias("sc2_contains"),
        SC.strip_prefix("priority", "1-").alias("sc3_strip"),
        SC.format_value(F.col("part_size_max"), integer=False).alias("sc4_value"),
        SC.abbreviate_list(arr, 4).alias("sc5_list"),
        SC.thousands(F.col("line_count") * 1000 + F.col("row_id")).alias("sc6_thousands"),
        SC.percent_1dp(F.col("has_open") * 12.5).alias("sc6_percent"),
        SC.clamp(F.col("acct_bal"), 0.0, 5000.0).alias("sc7_clamp"),
        F.array_join(SC.argsort_desc(F.array("disc_sum", "tax_sum", F.col("has_open").cast("double"))), ",").alias("sc9_argsort"),
        SC.slug(F.col("segment")).alias("sc10_slug"),
    )


_feat_list = "list_filter([" + ", ".join([f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in S.features] + [
    "CASE WHEN has_return = 1 THEN 'has_return' END", "CASE WHEN has_open = 1 THEN 'has_open' END",
    "CASE WHEN neg_balance = 1 THEN 'neg_balance' END", "CASE WHEN tax_sum > 0.3 THEN 'tax_sum' END",
    "CASE WHEN disc_sum > 0.3 THEN 'disc_sum' END"]) + "], lambda x: x IS NOT NULL)"
reg("sc1_sc10_scalar_functions", f"""WITH {OP_CTE}, b AS (SELECT *, {_feat_list} AS arr FROM order_profile)
SELECT row_id,
  (SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(substr(s, i - 1, 1), '^[A-Za-z]$') THEN upper(substr(s, i, 1)) ELSE lower(substr(s, i, 1)) END, '' ORDER BY i)
   FROM (SELECT replace(lower(segment) || '_a1b', '_', ' ') AS s) x, generate_series(1, length(x.s)) g(i)) AS sc1_label,
  contains(lower(priority), 'urgent') AS sc2_contains,
  CASE WHEN starts_with(priority, '1-') THEN substr(priority, 3) ELSE priority END AS sc3_strip,
  CASE WHEN part_size_max IS NULL OR isnan(part_size_max) THEN 'Imputed' ELSE printf('%.2f', part_size_max) END AS sc4_value,
  CASE WHEN len(arr) = 0 THEN 'None' ELSE array_to_string(arr[1:4] || CASE WHEN len(arr) > 4 THEN ['+' || CAST(len(arr) - 4 AS VARCHAR) || ' more'] ELSE [] END, ', ') END AS sc5_list,
  format('{{:,}}', line_count * 1000 + row_id) AS sc6_thousands,
  printf('%.1f%%', has_open * 12.5) AS sc6_percent,
  LEAST(GREATEST(acct_bal, 0.0), 5000.0) AS sc7_clamp,
  (SELECT string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY v DESC, i) FROM (SELECT UNNEST([disc_sum, tax_sum, CAST(has_open AS DOUBLE)]) AS v, UNNEST([1, 2, 3]) AS i) z) AS sc9_argsort,
  replace(lower(segment), ' ', '_') AS sc10_slug
FROM b""")(_sc)


# DR9 (all feature kinds) ---------------------------------------------------------
def _dr9_all(spark, sf):
    tr = op_split(spark, sf).where(F.col("split") == "train")
    pre = FE.fit_preprocessor(tr, S)
    fill = pre.encode(tr, strict=True).agg(
        *[F.avg(c).alias(c) if c in S.numeric else F.mode(c, True).alias(c) for c in S.features]).first().asDict()
    return R.fallback_texts(S, fill, fill, pre.nominal, spark)


def _dr9_all_sql():
    from tessera.plans.q_features import _encoded_sql
    parts = []
    for c in S.features:
        if c in S.numeric:
            parts.append(f"SELECT '{c}' AS feature, 'Average if blank: ' || printf('%.2f', (SELECT AVG({c}) FROM etr)) AS fallback_text")
            continue
        mode = f"(SELECT {c} FROM etr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
        if c in S.binary:
            parts.append(f"SELECT '{c}', 'Default if blank: ' || CASE WHEN round({mode}) = 1 THEN 'Yes' ELSE 'No' END")
            continue
        if c in S.ordinal_levels:
            cats = "[" + ", ".join(f"'{x}'" for x in S.ordinal_levels[c]) + "]"
        else:
            cats = f"(SELECT list_sort(list(DISTINCT {c})) FROM split WHERE split = 'train' AND {c} IS NOT NULL)"
        parts.append(f"SELECT '{c}', CASE WHEN CAST(round({mode}) AS INTEGER) BETWEEN 0 AND len({cats}) - 1 "
                     f"THEN 'Default if blank: ' || {cats}[CAST(round({mode}) AS INTEGER) + 1] "
                     f"ELSE 'Default if blank: most common value' END")
    return (f"WITH {OP_CTE},{split_ctes()}, enc AS ({_encoded_sql('order_profile')}), "
            f"etr AS (SELECT e.* FROM enc e JOIN split s USING (row_id) WHERE s.split = 'train') "
            + " UNION ALL ".join(parts))


reg("dr9_fallback_texts", _dr9_all_sql())(_dr9_all)
