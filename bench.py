"""Benchmark: time the headline checks at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query is executed completely (noop sink), after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_lineitem",
    "issues_lineitem_messy",
    "prepare_report_lineitem",
    "top_categories_orders",
    "stratified_folds_lineitem",
    "binary_metrics_lineitem",
    "multiclass_metrics_lineitem",
    "regression_metrics_orders",
    "cluster_summary_lineitem",
    "column_tags_catalog",
    "rule_baseline_orders_totalprice",
    "rule_baseline_documents_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.registry import spark_queries
    from quarry.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = spark_queries()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    # warm-up: JVM, parquet footers, codegen caches
    qs["class_distribution_returnflag"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
