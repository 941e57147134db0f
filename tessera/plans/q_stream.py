"""Registered queries: ST1 (raw rows streamed through a published model) and FE6 (saved pipeline)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import bundle as B
from tessera.operators import features as FE
from tessera.operators import rules as R
from tessera.operators import segments as SG
from tessera.operators.explain import literal_tree
from tessera.plans import q_explain, q_features, q_rules
from tessera.plans.fixtures import STAGES, rule_scored_sql
from tessera.plans.order_rules import ORDER_SEGMENT_COLORS, ORDER_SEGMENT_LABELS
from tessera.plans.q_core import op_split
from tessera.plans.spec import ORDER_SPEC
from tessera.session import checkpoint_dir
from tessera.streaming.scoring import complete_epochs, score_stream

QUERIES: dict = {}
SQL: dict = {}
S = ORDER_SPEC
RS = q_rules.RS


def _shares(values: list[float]) -> list[float]:
    return [v / sum(values) for v in values]


def order_bundle(spark, sf, tree: str = "tree_a") -> B.Bundle:
    """Encoders, scaler and fill values of the train split, a literal tree of class shares, the segments and their texts."""
    from tessera.plans.q_segments import PROF, clustered, keys
    pre = FE.fit_preprocessor(op_split(spark, sf).where(F.col("split") == "train"), S)
    splits, leaves = q_explain.TREES[tree]
    at = [S.features.index(f) for f in q_explain.FEATS]  # the tree's features among all
    model = literal_tree({n: (at[f], t, a, b) for n, (f, t, a, b) in splits.items()}, {n: _shares(v) for n, v in leaves.items()}, len(STAGES))
    shown = SG.segment_display(keys(spark, sf), ORDER_SEGMENT_LABELS, ORDER_SEGMENT_COLORS).select("cluster", "cluster_name", "segment_key")
    texts = shown.join(q_rules._segment_texts(spark, sf), "cluster").select(
        "cluster", "cluster_name", "segment_key", "segment_summary", "segment_recommendations")
    notes = {"medians": q_rules.medians(spark, sf), "segments": [list(r) for r in texts.collect()]}  # one row a cluster
    return B.Bundle(pre, tree, model, clustered(spark, sf)[2], [f"{c}_scaled" for c in PROF], notes)


def record(raw, bundle: B.Bundle, types: dict[str, str]):
    """The recommendation record (DR11) of raw rows, all of whose columns are texts."""
    blank = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in S.features}
    entered = F.struct(*[blank[c].try_cast(types[c]).alias(c) for c in S.features])
    scored = bundle.score(raw.select(F.col("row_id").try_cast("long").alias("row_id"), entered.alias("entered"), *S.features))
    # rules speak of values as they were entered
    df = scored.select("row_id", "entered.*", "probability", "missing_columns", "cluster")
    df = R.patient_actions(R.stage_result(df, STAGES), RS, bundle.notes["medians"])
    segments = df.sparkSession.createDataFrame(
        [tuple(r) for r in bundle.notes["segments"]],
        "cluster int, cluster_name string, segment_key string, segment_summary string, segment_recommendations string")
    df = df.join(F.broadcast(segments), "cluster")
    df = R.personalisation_note(R.stage_texts(R.combined_note(df, RS), RS), RS, len(S.features))
    lists = [F.array_join(c, " | ").alias(c) for c in ("actions", "meaning", "guidance", "next_steps")]
    return df.select("row_id", "predicted", "confidence", "runner_up", "gap", "cluster", "cluster_name", "segment_key",
                     "combined_note", "personalisation_note", F.size("actions").alias("n_actions"), *lists,
                     "segment_summary", "segment_recommendations")


def raw_rows(spark, sf):
    """Test orders as texts, as they might be entered; and the features' types."""
    te = op_split(spark, sf).where(F.col("split") == "test").select("row_id", *S.features)
    return te.select(*[F.col(c).cast("string").alias(c) for c in te.columns]), dict(te.dtypes)


def st1(spark, sf):
    """The test orders arrive in four files, a micro-batch each; the model is published and read back for each."""
    base = os.path.join(checkpoint_dir(spark), "stream", uuid.uuid4().hex)
    raw, types = raw_rows(spark, sf)
    raw.repartition(4, "row_id").write.parquet(os.path.join(base, "source"))
    models = os.path.join(base, "models")
    B.publish(order_bundle(spark, sf), models)
    query = score_stream(spark, os.path.join(base, "source"), raw.schema, lambda batch, v: record(batch, B.load(spark, models, S, v), types),
                         lambda: B.newest(spark, models), os.path.join(base, "sink"), os.path.join(base, "checkpoint"), files=1)
    query.awaitTermination()
    return complete_epochs(spark, os.path.join(base, "sink")).drop("epoch", "model_version")


def _st1_sql() -> str:
    """The record of all test orders at once, the tree written out."""
    splits, leaves = q_explain.TREES["tree_a"]

    def value(n: int, c: int) -> str:
        if n in leaves:
            return repr(_shares(leaves[n])[c])
        f, t, a, b = splits[n]
        return f"(CASE WHEN {q_explain.FEATS[f]} <= {t!r} THEN {value(a, c)} ELSE {value(b, c)} END)"
    test = "(SELECT * FROM split WHERE split = 'test')"
    shares = ", ".join(f"CAST({value(0, c)} AS DOUBLE)" for c in range(len(STAGES)))
    names = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
    tree = (f"SELECT *, {names}[list_position(probability, list_max(probability))] AS prediction, stage AS label "
            f"FROM (SELECT *, [{shares}] AS probability FROM {test}) r")
    return q_rules._dr11_sql().replace(rule_scored_sql("centre_rule", test), tree)


QUERIES["st1_stream_scoring"] = st1
SQL["st1_stream_scoring"] = _st1_sql()


def _fe6(spark, sf):
    """FE8 by a pipeline that was published and loaded."""
    root = os.path.join(checkpoint_dir(spark), "bundles", uuid.uuid4().hex)
    version = B.publish(order_bundle(spark, sf), root)
    pre = B.load(spark, root, S, version).pre
    raw = op_split(spark, sf).where(F.col("split") == "test").select("row_id", *S.features)
    out = FE.scoring_features(raw, pre)
    return out.select("row_id", F.concat_ws(",", "missing_columns").alias("missing_columns"),
                      *S.features, *[c + "_scaled" for c in S.features])


QUERIES["fe6_fitted_pipeline"] = _fe6
SQL["fe6_fitted_pipeline"] = q_features.SQL["fe8_scoring_features"]
