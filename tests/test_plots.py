from __future__ import annotations

from pyspark.sql import functions as F

from seqyield.plans import files as runfiles
from seqyield.plans.plots import plot_tables, read_table, write_tables

from .conftest import SF001


def test_plot_tables_from_files(spark, tmp_dir):
    """Summary TSVs and gzip FASTQ written from `events`, then the whole plot dataflow."""
    summary_dirs, fastq_dirs = runfiles.summary_folders(spark, SF001), runfiles.fastq_folders(spark, SF001)
    reads = read_table(spark, summary_dirs, fastq_dirs)
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert 0 < reads.count() < n            # malformed records drop their reads from the join
    tables = plot_tables(reads)
    rc = tables["reads"]
    last = rc.agg(F.max("yield"), F.sum("sequence_length_template"), F.max("read_count"), F.count(F.lit(1))).collect()[0]
    assert last[0] == last[1] and last[2] == last[3]
    assert tables["flowcellmap"].count() == 3000
    rep = {(r["stage"], r["section"], r["label"]) for r in tables["report"].collect()}
    assert ("filtered", "nx", "N50") in rep and ("unfiltered", "total", "bases") in rep
    paths = write_tables({k: tables[k] for k in ("yield", "report", "venn")}, tmp_dir, "run1")
    write_tables({"report": tables["report"]}, tmp_dir, "run1")       # report appends
    assert spark.read.parquet(paths[1]).count() == 2 * tables["report"].count()


def test_run_plots_writes_every_table_and_leaves_no_scratch(spark, tmp_dir):
    import os

    from seqyield.plans.plots import run_plots
    from seqyield.session import ensure_checkpoint_dir
    paths = run_plots(spark, runfiles.summary_folders(spark, SF001), runfiles.fastq_folders(spark, SF001), tmp_dir, "all")
    assert all(spark.read.parquet(p).columns for p in paths) and len(paths) == 30
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert [d for d in os.listdir(root) if d.startswith(("buckets-", "merged-", "trimmed-"))] == []
