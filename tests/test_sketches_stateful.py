"""Sketches of batches against exact numbers; streams with state of their own against batch results."""
from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqyield.operators import sketches, trim
from seqyield.session import scratch_path
from seqyield.streaming import jobs, stateful


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(4)
    n = 30000
    rows = list(zip(range(n), (rng.integers(0, 7, n)).tolist(), np.round(rng.lognormal(8, 1, n)).tolist(),
                    (1.7e9 + np.sort(rng.uniform(0, 9e5, n))).tolist()))
    df = spark.createDataFrame(rows, "read long, batch long, length double, time double")
    return rows, df.withColumn("length", F.when(F.col("read") % 500 == 0, float("nan")).otherwise(F.col("length")))


def test_merged_sketches_match_exact_numbers(spark, reads):
    rows, df = reads
    stored = sketches.batch_sketches(df, "batch", ["length", "time"], k=1024)
    length = np.array([r[2] for r in rows if r[0] % 500])
    time = np.array([r[3] for r in rows])
    got = {(r.column, r.stat): r.value for r in sketches.sketched_describe(stored).collect()}
    for name, v in (("length", length), ("time", time)):
        assert got[name, "count"] == len(v) and got[name, "min"] == v.min() and got[name, "max"] == v.max()
        assert np.isclose(got[name, "mean"], v.mean(), rtol=1e-12) and np.isclose(got[name, "std"], v.std(ddof=1), rtol=1e-8)
        for p in (0.1, 0.5, 0.9):
            assert abs((v <= got[name, f"{p * 100:g}%"]).mean() - p) < 2 * sketches.rank_error(1024) + 1e-3


def test_any_set_of_batches_and_a_replaced_one(reads):
    rows, df = reads
    stored = sketches.batch_sketches(df, "batch", ["length"])
    some = stored.where("batch in (1, 4)")
    again = sketches.batch_sketches(df.where("batch = 4"), "batch", ["length"])
    want = np.array([r[2] for r in rows if r[0] % 500 and r[1] in (1, 4)])
    for t in (some, some.where("batch = 1").unionByName(again)):
        q = {r.p: r.q for r in sketches.sketched_quantiles(t, [0.25, 0.999]).collect()}
        for p, v in q.items():
            assert abs((want <= v).mean() - p) < 2 * sketches.rank_error() + 1 / len(want)


def test_trim_bounds_from_sketches(reads):
    rows, df = reads
    exact = trim.trim_bounds(df.withColumn("since", F.col("time") - min(r[3] for r in rows)), "length", "since")
    found = sketches.sketched_trim_bounds(sketches.batch_sketches(df, "batch", ["length", "time"]), "length", "time")
    length = np.sort([r[2] for r in rows if r[0] % 500])
    assert abs((length < found.length_max).mean() - 0.999) < 0.0015
    assert abs(found.time_min - exact.time_min) < 9e5 * 0.002 and abs(found.time_max - exact.time_max) < 9e5 * 0.002
    assert found.ratio_max == exact.ratio_max


def test_empty_batches(reads):
    none = sketches.batch_sketches(reads[1].where("false"), "batch", ["length", "time"])
    assert sketches.sketched_describe(none).count() == 0
    assert sketches.sketched_trim_bounds(none, "length", "time") == trim.TrimBounds(None, 20, None, None)


SCHEMA = "read_id string, run_id string, channel int, time timestamp, length long, arrival timestamp"


def put(spark, folder, name, rows, at):
    """One Parquet file that arrived at second ``at``."""
    raw = scratch_path(spark, "raw").removeprefix("file:")
    spark.createDataFrame(rows, "read_id string, run_id string, channel int, time long, length long").select(
        "read_id", "run_id", "channel", F.timestamp_seconds("time").alias("time"), "length").coalesce(1).write.parquet(raw)
    part = next(f for f in os.listdir(raw) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{raw}/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).drop("arrival").schema
    return jobs.file_stream(spark, folder, schema, files_per_trigger=1)


def run(spark, df, out, ckpt):
    with stateful.rocksdb_state(spark), jobs.state_partitions(spark, 2):
        jobs.run_to_table(df, out, ckpt).awaitTermination()
    return spark.read.parquet(out)


def test_running_reads_wait_for_the_watermark(spark, tmp_dir):
    """Files out of order within the delay; results in time order; state empties when the run ends."""
    rng = random.Random(6)
    rows = [(f"r{i}", "x", rng.randrange(3), 1000 + rng.randrange(400), rng.choice([None, 5, 7])) for i in range(120)]
    rows.sort(key=lambda r: r[3] + rng.randrange(60))
    for k in range(4):
        put(spark, f"{tmp_dir}/in", f"f{k}", rows[30 * k:30 * k + 30], 10 + k)

    def read():
        r = stateful.running_reads(stream(spark, f"{tmp_dir}/in"), "time", length_col="length", watermark="60 seconds")
        return run(spark, r, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")

    def want(upto):
        out = {}
        for c in range(3):
            total = 0
            mine = sorted((r for r in rows if r[2] == c and r[3] <= upto), key=lambda r: (r[3], r[0]))
            for n, r in enumerate(mine, 1):
                total += r[4] or 0
                out[r[0]] = (c, r[3] * 1_000_000, n, total)
        return out
    first = {r.read_id: (r.channel, r.time_us, r.channel_count, r.channel_yield) for r in read().collect()}
    assert first == want(max(r[3] for r in rows) - 60) and len(first) < 120
    put(spark, f"{tmp_dir}/in", "end", [(None, None, None, 10**6, None)], 100)
    last = {r.read_id: (r.channel, r.time_us, r.channel_count, r.channel_yield) for r in read().collect()}
    assert last == want(10**6) and len(last) == 120
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_dir}/ckpt")
    assert waiting.count() == 0
    totals = spark.read.format("statestore").option("stateVarName", "totals").load(f"{tmp_dir}/ckpt")
    assert totals.count() == 3


def test_unmatched_reads_leave_once(spark, tmp_dir):
    def row(i):
        return (f"r{i}", "x", 1, i, 1)
    put(spark, f"{tmp_dir}/s", "a", [row(i) for i in range(10)], 10_000)
    put(spark, f"{tmp_dir}/f", "a", [row(i) for i in range(2, 8)], 10_100)
    put(spark, f"{tmp_dir}/f", "b", [row(8), row(50)], 10_000 + 7200)
    for side in "sf":
        put(spark, f"{tmp_dir}/{side}", "end", [(None, None, None, 10**6, None)], 200_000)
    u = stateful.unmatched_stream(stream(spark, f"{tmp_dir}/s"), stream(spark, f"{tmp_dir}/f"))
    got = [(r.read_id, r.side) for r in run(spark, u, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").collect()]
    assert sorted(got) == sorted([("r0", "summary"), ("r1", "summary"), ("r8", "summary"), ("r9", "summary"),
                                  ("r8", "fastq"), ("r50", "fastq")])


def test_dedup_over_micro_batches(spark, tmp_dir):
    rows = [(f"r{i}", "x", 1, i, 1) for i in range(20)]
    put(spark, f"{tmp_dir}/in", "a", rows, 10_000)
    put(spark, f"{tmp_dir}/in", "b", rows[5:] + [("new", "x", 1, 1, 1)], 10_600)
    d = stateful.dedup_stream(stream(spark, f"{tmp_dir}/in")).select("read_id")
    got = [r.read_id for r in run(spark, d, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").collect()]
    assert sorted(got) == sorted([r[0] for r in rows] + ["new"])


def test_streamed_checksums_of_large_and_empty_files(spark, tmp_dir):
    """Files of several pieces, an empty one, names with blanks."""
    import hashlib

    from seqyield.operators import batches
    files = {"large.fast5": os.urandom(1 << 20) * 19, "empty.fast5": b"", "a name.fast5": b"x" * 1000}
    for name, content in files.items():
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(content)
    listing = spark.createDataFrame([(f"file:{tmp_dir}/{n}", k) for k, n in enumerate(files)], "path string, number int")
    got = {r.file: (r.number, r.md5) for r in batches.streamed_checksums(listing, "number").collect()}
    assert got == {n: (k, hashlib.md5(c).hexdigest()) for k, (n, c) in enumerate(files.items())}
    assert batches.streamed_checksums(listing.where("false"), "number").count() == 0


def test_live_manifest_of_a_growing_run(spark, tmp_dir):
    """Batches leave when they have come to rest; a late file completes its batch; others never count as whole."""
    run_dir, out, ckpt = (f"{tmp_dir}/{x}" for x in ("run", "out", "ckpt"))

    def arrive(at, *names):
        for name in names:
            os.makedirs(os.path.dirname(f"{run_dir}/{name}"), exist_ok=True)
            with open(f"{run_dir}/{name}", "w") as f:
                f.write("x")
            os.utime(f"{run_dir}/{name}", (at, at))

    def now():
        with jobs.state_partitions(spark, 2):
            jobs.run_to_table(stateful.live_manifest(stateful.run_files(spark, run_dir), "60 seconds", "0 seconds"), out, ckpt).awaitTermination()
        return sorted(r.number for r in stateful.finished_batches(spark.read.parquet(out)).collect())
    arrive(1000, "sequencing_summary_1.txt", "fastq_1.fastq", "reads/1/a.fast5", "notes.txt", "fastq_2.fastq")
    arrive(1030, "reads/1/b.fast5")
    assert now() == []
    arrive(2000, "sequencing_summary_2.txt", "sequencing_summary_3.txt", "fastq_3.fastq", "reads/3/a.fast5", "fastq_4.fastq")
    assert now() == [1]
    arrive(3000, "reads/2/a.fast5", "sequencing_summary_5.txt")
    assert now() == [1, 3]
    arrive(4000, "fastq_5.fastq")
    assert now() == [1, 2, 3]
