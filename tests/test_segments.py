"""SG1 golden on the stored cluster profiles; k-means step and silhouette invariants."""

from tessera.operators import segments as SG
from tessera.plans.patient_rules import PATIENT_SEGMENT_COLORS, PATIENT_SEGMENT_LABELS, PATIENT_SEGMENTS
from tessera.plans.spec import PATIENT_SPEC

# Stored cluster profiles.
PROFILES = [(0, 105.49, 6.06, 24.78, 121.52, 7.25, 22961),
            (1, 134.52, 6.28, 23.87, 101.21, 5.9, 29436),
            (2, 113.77, 5.59, 28.38, 113.14, 6.58, 25440)]
COLS = [c for c, _ in PATIENT_SPEC.profile]


def test_segment_keys_golden(spark):
    df = spark.createDataFrame(PROFILES, ["cluster", *COLS, "cluster_size"])
    got = {r["cluster"]: r for r in SG.segment_keys(df, list(PATIENT_SPEC.profile), PATIENT_SEGMENTS).collect()}
    assert got[1]["segment_key"] == "healthy"
    assert got[0]["segment_key"] == "elevated_glucose"
    assert got[2]["segment_key"] == "unhealthy"
    assert (got[0]["health_rank_sum"], got[1]["health_rank_sum"], got[2]["health_rank_sum"]) == (13, 5, 12)
    assert sum(r[-1] for r in PROFILES) == 77837


def test_segment_keys_first_index_tie(spark):
    rows = [(0, 1.0, 1.0, 1.0, 1.0, 1.0, 5), (1, 1.0, 1.0, 1.0, 1.0, 1.0, 5), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, ["cluster", *COLS, "cluster_size"])
    got = {r["cluster"]: r["segment_key"] for r in SG.segment_keys(df, list(PATIENT_SPEC.profile), PATIENT_SEGMENTS).collect()}
    assert got == {0: "healthy", 1: "elevated_glucose", 2: "unhealthy"}


def test_display_fallback(spark):
    df = spark.createDataFrame([(0, "healthy"), (7, None)], "cluster int, segment_key string")
    got = {r["cluster"]: r for r in SG.segment_display(df, PATIENT_SEGMENT_LABELS, PATIENT_SEGMENT_COLORS).collect()}
    assert got[0]["cluster_name"] == "Healthy Patient Cluster"
    assert got[7]["cluster_name"] == "Cluster 7" and got[7]["color"] == "#91a196"


def test_silhouette_matches_brute_force(spark):
    import random
    random.seed(3)
    pts = [(i, i % 3 if i != 9 else 3, random.random(), random.random()) for i in range(10)]
    df = spark.createDataFrame(pts, "id int, cluster int, x double, y double")
    got = {r["id"]: r["silhouette"] for r in SG.silhouette_sq(df, ["x", "y"]).collect()}
    for i, c, x, y in pts:
        same = [(x - a) ** 2 + (y - b) ** 2 for j, d, a, b in pts if d == c and j != i]
        if not same:
            assert got[i] == 0.0
            continue
        a_ = sum(same) / len(same)
        b_ = min(sum((x - a) ** 2 + (y - b) ** 2 for j, d, a, b in pts if d == o) /
                 sum(1 for _, d, _, _ in pts if d == o) for o in {p[1] for p in pts} if o != c)
        assert abs(got[i] - (b_ - a_) / max(a_, b_)) < 1e-9


def test_lloyd_cost_non_increasing(spark):
    import random
    random.seed(5)
    pts = [(i, random.random(), random.random()) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    init = SG.first_rows_as_centroids(df, ["x", "y"], "id", 3)

    def cost(c):
        return sum(min((x - a) ** 2 + (y - b) ** 2 for a, b in c) for _, x, y in pts)
    c1, _ = SG.lloyd(df, ["x", "y"], init, steps=1)
    c2, _ = SG.lloyd(df, ["x", "y"], c1, steps=1)
    assert cost(c2) <= cost(c1) + 1e-12 <= cost(init) + 1e-12
