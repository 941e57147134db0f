"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is fully executed with the no-op sink (all rows computed, nothing
collected). Times are wall-clock seconds per query; ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = [
    "ag3_conditional_distribution",
    "sm1_stratified_split",
    "me1_confusion_matrix",
    "me2_7_label_metrics_centre_rule",
    "me8_classification_report",
    "me9_ovr_auc_centre_rule",
    "me13_compare_models",
    "ag12_correlation_matrix",
    "me14_silhouette",
    "sm5_jn5_smotenc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = catalog.queries()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
