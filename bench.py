"""Benchmark: the request-log ETL and the analytics over the written log.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

* ``etl_build``: building the J8 plan in Python (incl. the bounded price
  snapshot and dimension size checks); a one-off cost per job.
* ``etl``: executing exchanges (from all of ``events``) -> J8 -> write of the
  date-partitioned Parquet log (S7), fresh directory each time.
* every other entry: one registered query of ``__spark_entry__`` computed in
  full (``noop`` sink), median of warm runs. Analytics read the log the ETL
  wrote, as they would in production.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

QUERIES = [
    "spend_by_model", "daily_spend", "spend_by_api_key", "spend_by_metadata", "user_cost_in_feature",
    "cost_by_step", "spend_by_proxy_key", "recent_by_proxy_key", "latest_request", "unpriced_models",
    "requests_in_range", "metadata_contains", "metadata_key_stats", "merge_key_stats", "register_metadata_keys",
    "api_key_usage", "usage_metrics", "resolve_proxy_keys", "upsert_mappings", "create_keys", "revoke_keys",
    "translate_requests", "translate_responses",
]


def _median_time(fn, runs: int) -> float:
    times = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t)
    return statistics.median(times)


def main() -> None:
    os.environ.setdefault("BENCH_CPUS", CPUS)
    from tokenledger.plans import catalog
    from tokenledger.session import get_session, scratch_path
    from tokenledger.sources import request_log as log_io

    spark = get_session("tokenledger-bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    results: dict[str, float] = {}

    plan = {}

    def build():
        plan["df"] = catalog.full_log(spark, SF_DIR)

    def etl():
        log_io.write_request_log(plan["df"], scratch_path(spark, "bench-log"), mode="overwrite")

    build()
    etl()  # warm-up: JIT, code generation
    results["etl_build"] = round(_median_time(build, RUNS), 3)
    results["etl"] = round(_median_time(etl, RUNS), 3)
    catalog.materialized_log(spark, SF_DIR)  # the log the analytics read

    qs = catalog.QUERIES
    for name in QUERIES:
        def run(name=name):
            qs[name](spark, SF_DIR).write.mode("overwrite").format("noop").save()
        run()
        results[name] = round(_median_time(run, RUNS), 3)

    print(json.dumps({
        "metric": "total_sec", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "cpus": int(CPUS), "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
