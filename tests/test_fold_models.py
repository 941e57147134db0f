"""Tables that a cross-validation leaves in the shared folder."""

import os

from tessera.operators import models as ML
from tessera.session import checkpoint_dir


def test_models_of_folds_are_deleted_once_they_have_scored_their_fold(spark):
    rows = [(i, float(i % 7), float(i * i % 13), (i % 7 > 3) + 0, i // 7 % 3) for i in range(420)]
    data = spark.createDataFrame(rows, "row_id long, a double, b double, label int, fold int").cache()

    def tables():
        at = checkpoint_dir(spark).removeprefix("file:")
        return {os.path.join(d, x) for d, names, _ in os.walk(at) for x in names if x.startswith("extra_trees")}
    before = tables()
    model, counts = ML.fit_and_validate("Extra Trees", data, ["a", "b"], 2, k=3, n_trees=4)
    own = ML.fit("Extra Trees", data.where("fold != 1"), ["a", "b"], n_trees=4)
    want = ML.predict(own, data.where("fold = 1"), ["a", "b"], 2).groupBy("label", "prediction").count().collect()
    assert len(tables() - before) == 2 and os.path.isdir(model.path.removeprefix("file:"))
    got = counts.where("fold = 1").collect()
    assert sorted((int(r["actual"]), int(r["predicted"]), r["n"]) for r in got) == sorted((r["label"], int(r["prediction"]), r["count"]) for r in want)
    assert ML.predict(model, data, ["a", "b"], 2).count() == 420
