"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the number of local cores. Each
query is planned and fully computed once; the result goes to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkattest.plans.queries import load_all  # noqa: E402
from sparkattest.session import local_session  # noqa: E402

HEADLINE = [
    "certificate_fields", "runtime_features", "training_features", "document_wording", "content_fingerprints",
    "consistency_findings", "decision_report", "history_filters", "newest_verifications", "dashboard_metrics",
    "value_distributions", "feedback_error_analysis", "engine_vs_model", "prior_duplicates", "exact_copies",
    "template_rotation_split", "stratified_split", "cross_split_counts", "quality_report", "drift_report",
    "nearest_rank_percentiles", "ranking_metrics", "threshold_sweep", "daily_event_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"))
    queries, _ = load_all()
    queries["top_issuers"](spark, sf_dir).collect()  # start the engine before the clock
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cores)}))


if __name__ == "__main__":
    main()
