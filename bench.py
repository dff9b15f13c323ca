"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the registry's bench set).
Each query is executed in full with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "drift_windows_shifted",   # ST1, A1, A2, P10: window centroids + drift
    "drift_windows_sliding",   # ST2 with pane pre-aggregation
    "work_backfill",           # J2-J4 work list
    "knn_top10",               # J11 exact top-10
    "pair_ranking_metrics",    # E1 ranking metrics
    "vocab_chi2",              # A6
    "keyword_topics",          # A9
    "linguistic_backfill",     # L2/L3 full reports
    "rollback_decisions",      # ST7 rolling error rate
    "latency_report",          # A13
    "throttle_alerts",         # ST8
    "embed_documents",         # U1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from embdrift.plans.catalog import registry, runner
    from embdrift.session import get_spark
    os.environ.setdefault("EMBDRIFT_DRIVER_MEMORY", "16g")  # local mode: the driver's heap is the executors'
    spark = get_spark(f"local[{cpus}]", "embdrift-bench", shuffle_partitions=int(cpus) * 2)
    spark.conf.set("embdrift.text.tasks", str(int(cpus) * 2))
    reg = registry()
    # JVM / Python worker warm-up outside the timed section.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        # Timed from the DataFrame build: driver-side counts and checkpoints count too.
        t0 = time.perf_counter()
        df = runner(reg[name])(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
