"""The driver keeps one model of the toxicity fit, and components come out as before with repeated edges."""

from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from tessera.llm import jaccard, toxicity


def test_the_calibration_model_is_freed(spark, monkeypatch):
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: gone.append(self) or destroy(self, *a, **k))
    rows = [(i, f"word{i % 7} stays {'awful thing' if i % 3 == 0 else 'plain thing'} number{i % 11} end{i}", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs)
    assert len(gone) == 1 and gone[0] is not model.shared.sent
    scored = model.score(docs)
    assert scored.where(F.col("predicted") == F.col("toxic")).count() > 270


def test_components_of_repeated_and_dense_edges(spark):
    dense = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    edges = dense + dense[::2] + [(i + 1, i) for i in range(20, 40)] + [(50, 50), (61, 60), (60, 61)]
    got = {r["a"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(12)} | {i: 20 for i in range(20, 41)} | {60: 60, 61: 60}
    assert got == want
