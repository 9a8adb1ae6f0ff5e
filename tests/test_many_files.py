"""Runs of many small files: folders written, listed, read and archived by tasks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from seqyield.operators import batches
from seqyield.plans import files as runfiles
from seqyield.sources import fastq_source, listing

SUMMARY = ["filename", "read_id", "run_id", "channel", "start_time", "duration", "num_events", "template_start",
           "num_events_template", "template_duration", "sequence_length_template", "mean_qscore_template", "strand_score_template"]


def _put(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as fh:
        fh.write(data)


def _run(folder, numbers):
    for n in numbers:
        cells = ["f", f"r{n}", "run", "5", "1.5", "2", "10", "1.5", "10", "1", "100", "9.5", "0"]
        _put(f"{folder}/sequencing_summary_{n}.txt", "\t".join(SUMMARY) + "\n" + "\t".join(cells) + "\n")
        _put(f"{folder}/fastq_{n}.fastq", f"@r{n} a=b\nACGT\n+\n!!!!\n@s{n} a=b\nAC\n+\n!!\n")
        _put(f"{folder}/reads/{n}/PC_7_FAH_0_ch_0_strand.fast5", f"five{n}")


def test_listing_is_that_of_the_file_index(spark, tmp_dir):
    _run(tmp_dir, range(3))
    _put(f"{tmp_dir}/reads/1/deep er/x.fast5", "x")
    for hidden in ("_no.fast5", ".no.fast5", "empty.fast5"):
        _put(f"{tmp_dir}/reads/2/{hidden}", "" if hidden[0] == "e" else "x")
    for folders, glob, recursive in ((tmp_dir, "fastq_*.fastq", False), (f"{tmp_dir}/reads", "*.fast5", True), (tmp_dir, None, True),
                                     ([f"{tmp_dir}/reads/0", f"{tmp_dir}/reads/1"], "*.fast5", False)):
        got = listing.list_files(spark, folders, glob, recursive).collect()
        assert got and sorted(got) == sorted(listing._indexed(spark, folders, glob, recursive).collect())


def test_lines_are_those_of_the_text_source(spark, tmp_dir):
    data = b"a\tb\r\n\nno \xff utf-8\rc\r\r\nlast"
    _put(f"{tmp_dir}/x.txt", data, "wb")
    whole = spark.read.text(tmp_dir).select(F.col("_metadata.file_path").alias("file"), "value").collect()
    files = listing.list_files(spark, tmp_dir)
    for piece in (1, 2, 3, 5, 1 << 20):
        got = listing.lines(files, piece).collect()
        assert [r["value"] for r in got] == [r["value"] for r in whole]
    assert listing.texts(files).head()["value"] == data.decode("utf-8", "replace")


def test_many_small_batches_share_partitions(spark, tmp_dir):
    run, out = f"{tmp_dir}/run", f"{tmp_dir}/archive"
    _run(run, range(300))
    assert batches.tidy(spark, run, run, f"{run}/reads", out, "FAB").where("action = 'write'").count() == 3 * 299
    for kind, rows in (("fast5", 1), ("fastq", 2), ("summary", 1)):
        assert len([d for d in os.listdir(f"{out}/{kind}/{batches.RANGE}=2") if d.startswith("range=")]) == 150
        held = {r["number"]: r["count"] for r in spark.read.parquet(f"{out}/{kind}").groupBy("number").count().collect()}
        assert held == {n: rows for n in range(299)}
    # Two batches later: the range that a new batch shares with an archived one keeps both, and nothing is there twice.
    _run(run, [300, 301])
    _put(f"{run}/fastq_298.fastq", "@changed a=b\nA\n+\n!\n")
    plan = batches.tidy(spark, run, run, f"{run}/reads", out, "FAB")
    assert {r["number"] for r in plan.where("action = 'write'").collect()} == {299, 300}
    for kind, rows in (("fast5", 1), ("fastq", 2), ("summary", 1)):
        held = {r["number"]: r["count"] for r in spark.read.parquet(f"{out}/{kind}").groupBy("number").count().collect()}
        assert held == {n: rows for n in range(301)}
    sums = spark.read.parquet(f"{out}/checksums")
    assert sums.count() == 2 * 301 and sums.select("kind", "number").distinct().count() == 2 * 301
    # Written again: batch 298 has one record now.
    batches.tidy(spark, run, run, f"{run}/reads", out, "FAB", overwrite=True)
    held = {r["number"]: r["count"] for r in spark.read.parquet(f"{out}/fastq").groupBy("number").count().collect()}
    assert held == {n: 1 if n == 298 else 2 for n in range(301)} and spark.read.parquet(f"{out}/checksums").count() == 2 * 301


def test_large_batches_stay_partitions_of_their_own(spark):
    many = spark.range(10_000).select(F.col("id").alias("number"), F.lit(1 << 10).cast("long").alias("length"))
    assert batches.batches_per_range(many) == 40
    assert batches.batches_per_range(many.withColumn("length", F.lit(1 << 30).cast("long"))) == 1
    assert batches.batches_per_range(many.where("number < 200")) == 1 == batches.batches_per_range(many.limit(0))


def test_cuts_of_small_files_travel_together(spark, tmp_dir):
    for n in range(400):
        _put(f"{tmp_dir}/fastq_{n}.fastq", "".join(f"@r{n}-{i} a=b\nACGT\n+\n@a=b\n" for i in range(50)))
    reader = fastq_source.FastqReader({"path": tmp_dir, "partitionBytes": "256", "minTasks": "8"})
    parts = reader.partitions()
    assert 8 <= len(parts) <= 16
    cover = sorted(f for p in parts for f in p.files)
    ends = {}
    for path, size, start, end in cover:   # every byte of every file is in one cut
        assert start == ends.get(path, 0)
        ends[path] = end
    assert len(ends) == 400 and all(ends[path] == size for path, size, _, _ in cover)
    rows = fastq_source.fastq_reader(spark, tmp_dir, partition_bytes=256).load()
    assert fastq_source.records(rows).select("header").distinct().count() == 400 * 50 == fastq_source.records(rows).where("framing_ok").count()


def test_files_are_written_by_tasks(spark, tmp_dir):
    rows = spark.range(40).select((F.col("id") % 4).alias("file"), (-F.col("id")).alias("read"),
                                  F.concat(F.lit("é"), F.col("id").cast("string")).alias("value"))
    runfiles._write_files(rows, ["file"], tmp_dir, lambda k: f"d{k % 2}/f_{k}.txt", head=lambda k: f"head {k}", arrival=lambda k: 1000 * (k + 1))
    for k in range(4):
        path = f"{tmp_dir}/d{k % 2}/f_{k}.txt"
        assert open(path, encoding="utf-8").read().split("\n") == [f"head {k}", *[f"é{i}" for i in range(36 + k, -1, -4)], ""]
        assert int(os.stat(path).st_mtime) == k + 1
    assert sorted(os.listdir(f"{tmp_dir}/d0")) == ["f_0.txt", "f_2.txt"]


def test_streams_list_their_files_in_few_tasks(spark, tmp_dir):
    from seqyield.streaming import jobs, stateful
    _run(tmp_dir, range(120))
    before = spark.conf.get(jobs.LISTING)
    tracker, group = spark.sparkContext.statusTracker(), "listing of a growing run"
    spark.sparkContext.setJobGroup(group, group)
    files = stateful.run_files(spark, tmp_dir)
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(jobs.LISTING) == before
    sessions = jobs.run_once(stateful.live_manifest(files, "1 second", "0 seconds"), spark, "few")
    assert spark.conf.get(jobs.LISTING) == before and sessions.columns
