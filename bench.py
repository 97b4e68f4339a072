"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is built and fully executed (noop sink) four times; the first run warms up and the
median of the others counts. `setup` is the one-off cost of the shared feature table, split,
preprocessing constants and trained models; `cold` is set-up and first runs together, from an empty session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from holdfast.plans.registry import all_queries
from holdfast.plans.workspace import workspace
from holdfast.session import local_session

HEADLINE = (
    "feature_store", "feature_store_five_tables", "churn_summary", "session_features", "lag_gap", "recount_audit", "constraint_audit",
    "feature_means", "stratified_split", "median_imputation", "linear_score", "roc_auc", "model_comparison",
    "global_importance", "local_explanations", "retention_decision", "impact_rows", "portfolio_summary",
    "dashboard_frame", "user_lookup", "tree_shap_values", "tree_importance", "lr_scores", "gbt_scores",
)
RUNS = 3


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    queries = all_queries()

    setup = {}
    shared = workspace(spark, sf_dir)
    for name in ("features", "encoded", "preprocessor", "background", "lr_model", "gbt_model", "leaves"):
        began = time.perf_counter()
        getattr(shared, name)
        setup[name] = round(time.perf_counter() - began, 3)

    seconds, first = {}, 0.0
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run(queries[name](spark, sf_dir))
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
        first += took[0]

    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "setup": setup, "cold": round(sum(setup.values()) + first, 3), "sf": Path(sf_dir).name, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
