"""Golden numbers: the reference's stored confusion matrices replayed through ME1-ME8
must give its stored comparison metrics; ME13 must rank the models the same way."""

import pytest

from tessera.operators import metrics as M

CLASSES = ["Gestational", "No Diabetes", "Pre-Diabetes", "Type 1", "Type 2"]
# Stored confusion matrices (rows actual, columns predicted).
MATRICES = {
    "Decision Tree": [[14, 6, 15, 7, 11], [61, 1439, 10, 27, 11], [468, 0, 5280, 431, 24],
                      [5, 4, 7, 4, 3], [922, 247, 1150, 670, 8644]],
    "Random Forest": [[7, 8, 22, 2, 14], [3, 1517, 28, 0, 0], [91, 0, 6043, 68, 1],
                      [0, 4, 14, 0, 5], [452, 263, 1300, 132, 9486]],
    "XGBoost": [[4, 7, 23, 2, 17], [3, 1529, 10, 1, 5], [129, 0, 5994, 73, 7],
                [1, 4, 13, 0, 5], [244, 266, 1255, 85, 9783]],
}
# Stored comparison metrics.
EXPECTED = {
    "XGBoost": dict(macro_f1=0.5460959509001222, accuracy=0.8895169578622816,
                    balanced_accuracy=0.5740948154843235, mcc=0.8166986700047594,
                    macro_precision=0.5350632696026172, weighted_precision=0.9250044754992768),
    "Random Forest": dict(macro_f1=0.5433994222281437, accuracy=0.8763103802672148,
                          balanced_accuracy=0.5803388998069042, mcc=0.7995593020900619,
                          macro_precision=0.5345888687610455, weighted_precision=0.9239648904701),
    "Decision Tree": dict(macro_f1=0.5193551906492507, accuracy=0.7903905447070915,
                          balanced_accuracy=0.592382024460026, mcc=0.6837314009257738,
                          macro_precision=0.5345900835846882, weighted_precision=0.9223954564708016),
}
WEIGHTED_AUC = {"XGBoost": 0.9467575206802915, "Random Forest": 0.9461255470035665,
                "Decision Tree": 0.9249539752432738}


def counts_frame(spark, m):
    rows = [(CLASSES[i], CLASSES[j], m[i][j]) for i in range(5) for j in range(5) if m[i][j]]
    return spark.createDataFrame(rows, "actual string, predicted string, n long")


@pytest.mark.parametrize("model", list(MATRICES))
def test_label_metrics_match_stored(spark, model):
    got = M.label_metrics(counts_frame(spark, MATRICES[model])).first().asDict()
    for k, v in EXPECTED[model].items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_total_test_rows(spark):
    for m in MATRICES.values():
        assert sum(map(sum, m)) == 19460


def test_confusion_long_and_wide(spark):
    c = counts_frame(spark, MATRICES["XGBoost"])
    long = M.confusion_matrix_long(c, CLASSES)
    assert long.count() == 25
    wide = {r["actual"]: r for r in M.confusion_matrix_wide(c, CLASSES).collect()}
    assert wide["Type 2"]["Type 2"] == 9783 and wide["Type 1"]["Type 1"] == 0


def test_classification_report_rows(spark):
    rep = M.classification_report(counts_frame(spark, MATRICES["XGBoost"]), CLASSES).collect()
    by = {r["label"]: r for r in rep}
    assert set(by) == set(CLASSES) | {"accuracy", "macro avg", "weighted avg"}
    assert by["accuracy"]["precision"] == pytest.approx(EXPECTED["XGBoost"]["accuracy"], abs=1e-12)
    assert by["Type 1"]["precision"] == 0.0 and by["Type 1"]["recall"] == 0.0


def test_compare_models_order(spark):
    rows = []
    for name, m in MATRICES.items():
        r = M.label_metrics(counts_frame(spark, m)).withColumn("model", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(name))
        from pyspark.sql import functions as F
        rows.append(r.withColumn("weighted_auc", F.lit(WEIGHTED_AUC[name])))
    order = [r["model"] for r in M.compare_models(rows).orderBy("rank").collect()]
    assert order == ["XGBoost", "Random Forest", "Decision Tree"]


def test_auc_ties_and_absent_class(spark):
    from pyspark.sql import functions as F
    # scores with ties; class 'c' never predicted; AUC by brute force
    data = [("a", [0.6, 0.3, 0.1]), ("a", [0.5, 0.4, 0.1]), ("b", [0.5, 0.4, 0.1]),
            ("b", [0.2, 0.7, 0.1]), ("c", [0.4, 0.4, 0.2]), ("c", [0.6, 0.2, 0.2])]
    df = spark.createDataFrame(data, "label string, probability array<double>")
    got = {r["cls"]: r["auc"] for r in M.ovr_auc(df, ["a", "b", "c"]).collect()}
    for k, cls in enumerate(["a", "b", "c"]):
        pos = [p[k] for l, p in data if l == cls]
        neg = [p[k] for l, p in data if l != cls]
        exp = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
        assert got[cls] == pytest.approx(exp, abs=1e-12)
