"""Wall time of the end-to-end queries: one warm-up run each, then the median of up to three."""

from __future__ import annotations

import json
import os
import statistics
import time

from apidrift.operators import usage
from apidrift.plans import pipelines
from apidrift.plans.catalog import QUERIES, Bench
from apidrift.session import fresh_path, local_session
from apidrift.sources import readers, writers

# A query that has used this much measured time is not repeated again.
SECONDS_PER_QUERY = 30
HEADLINE = {
    "q1_breaking_changes": "breaking_changes",
    "q2_client_usage": "client_usage",
    "q3_dependency_graph": "dependency_graph",
    "q4_downstream_clients": "downstream_clients",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    measured: dict[str, int] = {}

    def measure(label: str, build) -> None:
        """One warm-up and up to ``runs`` measured runs of all rows of ``build()``."""
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
            if sum(seconds[1:]) > SECONDS_PER_QUERY:
                break
        measured[label] = len(seconds) - 1
        timings[label] = round(statistics.median(seconds[1:]), 3)

    for label, name in HEADLINE.items():
        measure(label, lambda name=name: QUERIES[name](spark, sf_dir))
    # The last two start from stored changes and their report; storing them, computed whole, is timed as a step of its own.
    bench, changes_path, report_path = Bench(spark, sf_dir), fresh_path(spark, "changes"), fresh_path(spark, "report")
    start = time.perf_counter()
    bench.breaking.write.parquet(changes_path)
    stored = spark.read.parquet(changes_path)
    writers.write_change_report(stored, report_path, 0)
    timings["changes_stored"], measured["changes_stored"] = round(time.perf_counter() - start, 3), 1
    used = usage.third_party_usage(bench.views.identifier, bench.views.client_version)
    measure("q5_breaking_change_usage", lambda: pipelines.breaking_change_usage(stored, bench.edges, used))
    measure("q6_minor_patch_breaks", lambda: pipelines.minor_patch_breaks(readers.read_change_report(spark, report_path)))
    print(
        json.dumps(
            {
                "metric": "api_compatibility_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "measured_runs": measured,
                "cores": cores,
                "memory": spark.conf.get("spark.driver.memory", None),
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
