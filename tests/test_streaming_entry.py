from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from seqyield.plans.queries import QUERIES

from .conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"series", "time_bin", "time_s", "yield_in_bin", "yield"}


def test_registry_consistent():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    from seqyield.plans.oracle import ORACLE_SQL
    assert set(QUERIES) == set(ORACLE_SQL)            # every query of this package has its SQL


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["trim_reads", "running_yield_by_channel", "nx_compat", "weighted_histogram",
                                  "stream_yield", "stream_merge", "stream_channel_totals", "fastq_headers",
                                  "archive_plan", "run_report", "pearson_test", "tidy_rerun_new_batch", "summary_scan_reordered",
                                  "bad_fastq_files", "compact_batches"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = _norm(tuple(r[c] for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(cols)
    idx = [ocols.index(c) for c in sorted(cols)]
    exp = _norm(tuple(r[i] for i in idx) for r in res.fetchall())
    assert got == exp


def test_stream_restart_is_idempotent(spark, tmp_dir):
    """A rerun from the same checkpoint finds no new files and leaves the totals unchanged."""
    import os

    from pyspark.sql import functions as F

    from seqyield.plans.tables import reads_view
    from seqyield.streaming import jobs

    src = os.path.join(tmp_dir, "src")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.where("event_id < 500").write.parquet(src)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")

    def run():
        s = jobs.enrich_stream(reads_view(jobs.file_stream(spark, src, ev.schema, files_per_trigger=1)))
        jobs.running_yield_batches(s, out, ckpt).awaitTermination()
        return {r["pass"]: (r["quality_yield"], r["quality_count"])
                for r in jobs.running_yield_totals(spark, out).groupBy("pass").agg(
                    F.max("quality_yield").alias("quality_yield"), F.max("quality_count").alias("quality_count")).collect()}
    first = run()
    assert run() == first
    # a new file arrives: only it is processed, totals grow by exactly its rows
    ev.where("event_id >= 500 and event_id < 800").write.mode("append").parquet(src)
    third = run()
    assert sum(c for _, c in third.values()) == 800
