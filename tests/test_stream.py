"""ST1: the streamed record equals the batch record; epochs keep the model they were scored with."""

import os

from pyspark.sql import functions as F

from tessera.operators import bundle as B
from tessera.plans import q_stream
from tessera.plans.spec import ORDER_SPEC
from tessera.sources.io import create_text, list_names, read_text
from tessera.streaming.scoring import complete_epochs, score_stream, write_epoch

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    streamed = q_stream.st1(spark, SF)
    raw, types = q_stream.raw_rows(spark, SF)
    batch = q_stream.record(raw, q_stream.order_bundle(spark, SF), types)
    a = sorted(map(tuple, streamed.select(*batch.columns).collect()))
    b = sorted(map(tuple, batch.collect()))
    assert a == b and len(a) > 0


def test_a_newer_model_leaves_old_epochs_alone(spark, tmp_path):
    root, sink, source = (f"file://{tmp_path}/{n}" for n in ("models", "sink", "source"))
    raw, types = q_stream.raw_rows(spark, SF)
    first, second = (q_stream.order_bundle(spark, SF, t) for t in ("tree_a", "tree_b"))
    assert B.publish(first, root) == 1

    def score(batch, version):
        return q_stream.record(batch, B.load(spark, root, ORDER_SPEC, version), types)
    raw.coalesce(1).write.parquet(source)

    def run():
        score_stream(spark, source, raw.schema, score, lambda: B.newest(spark, root), sink, f"{tmp_path}/checkpoint").awaitTermination()
    run()
    before = {tuple(r) for r in complete_epochs(spark, sink).collect()}
    assert B.publish(second, root) == 2
    assert write_epoch(raw, 0, score, lambda: 2, sink) == 1  # replayed: the epoch stays as it was
    assert {tuple(r) for r in complete_epochs(spark, sink).collect()} == before
    raw.limit(7).coalesce(1).write.mode("append").parquet(source)
    run()
    counts = {(r["epoch"], r["model_version"]): r["count"] for r in complete_epochs(spark, sink).groupBy("epoch", "model_version").count().collect()}
    assert counts == {(0, 1): raw.count(), (1, 2): 7}
    # rows written without a manifest are not there
    complete_epochs(spark, sink).limit(3).drop("epoch").write.parquet(os.path.join(sink, "rows", "epoch=9"))
    assert complete_epochs(spark, sink).where("epoch = 9").count() == 0


def test_published_once_and_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert read_text(spark, path) is None
    assert create_text(spark, path, "{}") and not create_text(spark, path, "other")
    assert read_text(spark, path) == "{}" and list_names(spark, f"file://{tmp_path}/a") == ["b.json"]


def test_every_kind_of_model_scores_alike_after_loading(spark, tmp_path):
    from tessera.operators import models as ML
    from tessera.plans.q_core import op_split
    raw = op_split(spark, SF).where(F.col("split") == "train").select("row_id", "stage", *ORDER_SPEC.features)
    for name, more in (("Decision Tree", {"max_depth": 4}), ("Random Forest", {"n_trees": 3}), ("XGBoost", {"rounds": 2}),
                       ("Extra Trees", {"n_trees": 3})):
        fitted = B.PipelineEstimator(ORDER_SPEC, name, **more).fit(raw)
        root = f"file://{tmp_path}/{name.replace(' ', '_')}"
        loaded = B.load(spark, root, ORDER_SPEC, B.publish(fitted, root))
        test = raw.limit(200)
        a, b = ({r["row_id"]: (r["probability"], r["prediction"]) for r in x.score(test).collect()} for x in (fitted, loaded))
        assert a == b and len(a) == 200 and loaded.name == name == ML.normalise_model_name(name)
