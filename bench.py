"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 1).
Each query is forced to completion with the ``noop`` sink (no driver collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqyield.plans import files as runfiles  # noqa: E402
from seqyield.plans import queries as Q  # noqa: E402
from seqyield.plans.queries import QUERIES  # noqa: E402
from seqyield.session import build_session, clean_scratch  # noqa: E402

# Tables that several queries read are built, and timed, on their own first.
SHARED = {"shared_merged": Q.reads, "shared_trimmed": Q.trimmed, "shared_pairs": Q.sample}

HEADLINE = [
    "merge_reads", "trim_reads", "running_yield", "running_yield_by_channel", "running_count_by_pass",
    "yield_curve_by_quality", "reads_curve_by_quality", "flowcell_grid", "describe_length",
    "nx_compat", "nx_standard", "weighted_histogram", "length_histogram", "quality_kde",
    "quality_ridges", "events_ratio_trend", "speed_quality_hexbin", "pair_sample", "run_report",
    "pair_kde_2d", "lineitem_running_quantity", "unmatched_reads", "fastq_headers", "tidy_first_run",
    "stream_yield", "stream_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    # The checkpoint root comes from the session (spark.checkpoint.dir); build_session
    # picks a folder of its own only when none is configured.
    spark = build_session(f"local[{cpus}]", app="seqyield-bench", shuffle_partitions=cpus, conf=conf)
    # Warm-up of the JVM (join, window, aggregate, parquet write) on tiny tables no
    # headline query uses, so that its start-up is not timed.
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    for _ in range(2):
        (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
         .withColumn("rk", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")))
         .groupBy("r_name").agg(F.max("rk").alias("m"))
         .write.format("noop").mode("overwrite").save())
    # Run folders are inputs that the table set does not have: written before the clock starts.
    for folder in (runfiles.fastq_folders, runfiles.run_folder, runfiles.event_stream_folder,
                   lambda s, d: runfiles.run_folder(s, d, True), lambda s, d: runfiles.event_stream_folder(s, d, True)):
        folder(spark, sf_dir)
    times: dict[str, float] = {}
    for name, build in SHARED.items():
        t0 = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - t0, 3)
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    clean_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
