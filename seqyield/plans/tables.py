"""Read tables derived from the driver's parquet tables.

No sequencing data ships with the task, so ``events`` plays the read table:
one event is one read.  The mapping (same arithmetic in the oracle SQL):

=========================  ==========================================================
read_id                    event_id as text
run_id                     event_type
sample_id                  constant ``S1``
read                       event_id
channel                    user_id mod 3000 + 1
start_time_utc             ts
start_time_float           seconds of ts since the epoch
sequence_length_template   round(value * 100), half up
num_events                 100 * k from ``props`` ``{"k": n}``
template_duration          (event_id mod 97) / 10 — zero every 97th read
mean_qscore_template       (event_id * 7919 mod 1500) / 100, missing every 211th read
=========================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqyield.functions.expr import micros
from seqyield.operators.reads import elapsed_time, enrich_reads, merge_reads

SUMMARY_COLS = ["read_id", "run_id", "channel", "start_time_float", "num_events",
                "template_duration", "sequence_length_template", "mean_qscore_template"]
FASTQ_COLS = ["read_id", "run_id", "sample_id", "read", "channel", "start_time_utc"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a merged read table (one row per read)."""
    return reads_view(table(spark, sf_dir, "events"))


def reads_view(ev: DataFrame) -> DataFrame:
    """Read columns from an ``events``-shaped frame (batch or stream)."""
    ts_type = ev.schema["ts"].dataType
    eid = F.col("event_id")
    q = (F.pmod(eid * 7919, F.lit(1500)).cast("double") / F.lit(100.0))
    extra = [F.col("arrival")] if "arrival" in ev.columns else []
    return ev.select(
        *extra,
        eid.cast("string").alias("read_id"),
        F.col("event_type").alias("run_id"),
        F.lit("S1").alias("sample_id"),
        eid.alias("read"),
        (F.pmod(F.col("user_id"), F.lit(3000)) + 1).cast("int").alias("channel"),
        F.col("ts").alias("start_time_utc"),
        (micros("ts", ts_type).cast("double") / 1e6).alias("start_time_float"),
        (F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long") * 100).alias("num_events"),
        (F.pmod(eid, F.lit(97)).cast("double") / F.lit(10.0)).alias("template_duration"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("sequence_length_template"),
        F.when(F.pmod(eid, F.lit(211)) == 0, F.lit(None).cast("double")).otherwise(q)
        .alias("mean_qscore_template"),
    )


def events_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary side of the read table (every event)."""
    return events_reads(spark, sf_dir).select(*SUMMARY_COLS)


def events_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ-header side: every event, but every 13th read carries a foreign id
    (``<id>-x``) so the join has reads missing from each side."""
    r = events_reads(spark, sf_dir)
    rid = F.when(F.pmod(F.col("read"), F.lit(13)) == 0, F.concat("read_id", F.lit("-x"))) \
        .otherwise(F.col("read_id"))
    return r.select(rid.alias("read_id"), "run_id", "sample_id", "read", "channel", "start_time_utc")


def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summary ⋈ FASTQ headers (the join only)."""
    return merge_reads(events_summary(spark, sf_dir), events_fastq(spark, sf_dir))


def derive(merged: DataFrame) -> DataFrame:
    """Time origin and derived columns on top of a (written) merged table."""
    return enrich_reads(elapsed_time(merged))


def documents_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a second read table: n_chars is the length, labels.quality the pass flag."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("read_id"),
        F.col("n_chars").alias("sequence_length_template"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("pass"),
        F.col("lang").alias("sample_id"))
