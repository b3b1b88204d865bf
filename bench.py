"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3: best of three after
one warm-up query), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.registry import QUERIES  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "q01_dashboard", "q02_customer_profile", "q03_geographic", "q04_merchant", "q05_time_patterns",
    "q06_model_performance", "q07_feature_importance", "q08_system_metrics", "q09_score_distribution",
    "q10_segmentation", "q11_daily_summary", "q12_dq_assessments", "q13_dq_transactions", "q14_system_health",
    "q15_statistics", "score_batch", "batch_process", "engineer_features", "trailing_features", "active_model_asof",
    "dq_profile", "quantiles", "ewma", "auc_exact", "drift_psi", "bias_groups",
    "online_features", "dq_box_stats", "feature_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__sql__files__maxPartitionBytes="16m")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("q12_dq_assessments")
    seconds = {name: round(min(run(name) for _ in range(repeat)), 3) for name in names}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
