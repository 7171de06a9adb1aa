"""Bench: the headline pipelines on $BENCH_SF_DIR (default /root/testdata/sf0.1).

Runs on local[$BENCH_CPUS]; each query is built and fully executed (written to a
no-op sink) once to warm up, then timed over $BENCH_RUNS runs (default 5, median reported).
Shuffle partitions default to 64 with AQE coalescing: window stages partition by a
handful of lane values, and 16 lanes hashed into 16 partitions collide badly.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pipeline_basic", "pipeline_f2f", "pipeline_multi", "pipeline_window", "pipeline_fish", "pipeline_all",
    "pipeline_receiver", "pipeline_round_trip", "throughput_by_count", "transfer_latency",
]


def main() -> None:
    from hopline.session import local_session
    from hopline.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "64")), app="hopline-bench")
    qs = catalog.queries()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def once(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # every column, every row
        return time.perf_counter() - t0

    per_query, rows_out = {}, {}
    for name in names:
        rows_out[name] = qs[name](spark, sf_dir).count()  # warm-up
        per_query[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(per_query.values()), 3)
    print(json.dumps({
        "metric": "headline_pipelines_total_sec",
        "value": total,
        "unit": "sec",
        "queries": per_query,
        "rows_out": rows_out,
        "input_events": events,
        "events_per_sec": {k: round(events / v, 1) for k, v in per_query.items() if v > 0},
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "runs": runs,
        "driver_memory": spark.sparkContext.getConf().get("spark.driver.memory", "default"),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
