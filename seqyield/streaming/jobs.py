"""Structured Streaming jobs for a run that is still being written.

The reference re-runs its whole dataflow from scratch; here the incremental
parts run as streaming queries over the instrument's folders:

* ``stream_reads`` — file source of summary rows (fixed schema, one or a few
  files per trigger) with the derived columns;
* ``stream_merge`` — stream–stream inner join of summary and FASTQ-header rows
  on the read keys.  The summary side only has run-relative seconds, so both
  sides use *arrival time* (the file's modification time) as event time, with a
  watermark each and a bounded arrival gap: join state is released by arrival,
  and ``given_up`` lists the pairs whose halves came further apart;
* ``stream_yield`` — yield and read count per event-time window and pass class,
  with a watermark on the read start time; each micro-batch writes the windows
  it changed (update mode), so the watermark releases finished windows' state;
* ``stream_channel_totals`` — running total per channel;
* ``stream_running_yield`` — running totals per pass class, kept as one row per
  micro-batch in an idempotent ``foreachBatch`` table (keyed by batch id), so a
  replayed batch overwrites itself instead of counting twice.

Exact quantile trimming and the moving time origin need the whole run, so
they stay batch jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.functions.expr import guarded_ratio, micros, pass_flag, qualitative
from seqyield.session import scratch_path

READ_KEYS = ("read_id", "run_id", "channel")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, files_per_trigger: int | None = None, **options) -> DataFrame:
    """A file-source stream with a fixed schema and the file's arrival time as ``arrival``."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    df = r.load(path)
    return df.withColumn("arrival", F.col("_metadata.file_modification_time"))


def enrich_stream(df: DataFrame, length_col: str = "sequence_length_template",
                  quality_col: str = "mean_qscore_template", duration_col: str = "template_duration",
                  events_col: str = "num_events") -> DataFrame:
    """Row-wise derived columns — the same expressions as the batch ``enrich_reads``."""
    return (df.withColumn("pass", pass_flag(quality_col))
            .withColumn("qualitative_pass", qualitative("pass"))
            .withColumn("pore_speed", guarded_ratio(length_col, duration_col))
            .withColumn("events_ratio", guarded_ratio(events_col, length_col)))


def stream_merge(summary: DataFrame, fastq: DataFrame, keys: Sequence[str] = READ_KEYS,
                 watermark: str = "1 hour", max_gap: str = "1 hour") -> DataFrame:
    """Inner join of two streams on the read keys; arrival within ``max_gap`` of each other."""
    s = summary.withColumnRenamed("arrival", "s_arrival").withWatermark("s_arrival", watermark)
    f = fastq.withColumnRenamed("arrival", "f_arrival").withWatermark("f_arrival", watermark)
    cond = [s[k] == f[k] for k in keys]
    gap = F.expr(f"INTERVAL {max_gap}")
    cond.append(f["f_arrival"].between(s["s_arrival"] - gap, s["s_arrival"] + gap))
    j = s.join(f, cond, "inner")
    others = [c for c in f.columns if c not in keys]
    return j.select(*[s[k] for k in keys], *[s[c] for c in s.columns if c not in keys],
                    *[f[c] for c in others])


def given_up(summary: DataFrame, fastq: DataFrame, merged: DataFrame, keys: Sequence[str] = READ_KEYS) -> DataFrame:
    """Keys that are on both sides (batch frames of the streams' inputs) but not in the merged table."""
    keys = list(keys)
    both = summary.select(*keys).join(fastq.select(*keys), keys, "left_semi")
    return both.join(merged.select(*keys), keys, "left_anti").distinct()


def stream_yield(reads: DataFrame, time_col: str = "start_time_utc", window: str = "10 minutes",
                 watermark: str = "1 hour", length_col: str = "sequence_length_template",
                 quality_col: str = "qualitative_pass") -> DataFrame:
    """Bases and reads per tumbling event-time window and pass class.

    A TIMESTAMP_NTZ time column is read as UTC (watermarks need TIMESTAMP).
    """
    dtype = reads.schema[time_col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        reads = reads.withColumn(time_col, F.timestamp_micros(micros(time_col, dtype)))
    return (reads.withWatermark(time_col, watermark)
            .groupBy(F.window(time_col, window).alias("w"), F.col(quality_col).alias("qualitative_pass"))
            .agg(F.sum(F.col(length_col).cast("long")).alias("bases"), F.count(F.lit(1)).alias("reads")))


def stream_channel_totals(reads: DataFrame, channel_col: str = "channel",
                          length_col: str = "sequence_length_template") -> DataFrame:
    return reads.groupBy(F.col(channel_col).alias("channel")).agg(
        F.sum(F.col(length_col).cast("long")).alias("channel_yield"), F.count(F.lit(1)).alias("reads"))


def _write_batch(path: str):
    """Store a micro-batch as partition ``batch_id=N``; a replayed one replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 available_now: bool = True, processing_time: str | None = None):
    """Start a streaming write.

    ``append``: Parquet file sink (exactly-once through its commit log).
    ``update``: each micro-batch stores the rows it changed as partition
    ``batch_id=N``; ``latest`` reads the newest row of every key.
    """
    w = df.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    if mode == "append":
        return w.outputMode("append").format("parquet").option("path", path).start()
    if mode == "update":
        return w.outputMode("update").foreachBatch(_write_batch(path)).start()
    raise ValueError("mode must be 'append' or 'update'")


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of an ``update`` table (map-side combined, no window)."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, "batch_id")]
    newest = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")


def running_yield_batches(reads: DataFrame, path: str, checkpoint: str, pass_col: str = "pass",
                          length_col: str = "sequence_length_template", available_now: bool = True):
    """Per micro-batch totals by pass class, stored as partition ``batch_id=N`` (overwrite = idempotent).

    Running totals up to batch N are the sums over partitions ≤ N (see
    :func:`running_yield_totals`); order holds between micro-batches, not inside one.
    """
    store = _write_batch(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch.groupBy(F.col(pass_col).alias("pass")).agg(
            F.sum(F.col(length_col).cast("long")).alias("bases"), F.count(F.lit(1)).alias("reads")), batch_id)
    w = reads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_yield_totals(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative bases and reads per pass class after each micro-batch (bounded: batches × 2 rows)."""
    from pyspark.sql import Window
    t = spark.read.parquet(path)
    w = Window.partitionBy("pass").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("pass", "batch_id", F.sum("bases").over(w).alias("quality_yield"),
                    F.sum("reads").over(w).alias("quality_count"))


#: Tasks that list the files of a folder or of a micro-batch: by default one for each folder or file, up to 10,000.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing_tasks(spark: SparkSession):
    """Folders are listed by a few tasks per core; a stream lists its files again in every micro-batch."""
    old = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LISTING) if old is None else spark.conf.set(LISTING, old)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Size the state-store partitions of a new streaming query to the cluster's cores.

    Stateful operators keep ``spark.sql.shuffle.partitions`` state partitions
    for the life of their checkpoint, and streaming shuffles are not coalesced
    by AQE; a batch-oriented setting (often hundreds) would mean that many
    small state tasks per micro-batch.
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n or spark.sparkContext.defaultParallelism))
    try:
        with listing_tasks(spark):
            yield
    finally:
        spark.conf.set(key, old)


def run_once(df: DataFrame, spark: SparkSession, name: str, mode: str = "append",
             keys: Sequence[str] | None = None) -> DataFrame:
    """Run a stream to completion on the data present now; return the result table."""
    out = scratch_path(spark, f"stream-{name}")
    ckpt = scratch_path(spark, f"stream-{name}-ckpt")
    with state_partitions(spark):
        q = run_to_table(df, out, ckpt, mode=mode)
        q.awaitTermination()
    if q.exception():
        raise q.exception()
    return latest(spark, out, keys or []) if mode == "update" else spark.read.parquet(out)


def _text_stream(spark: SparkSession, folders: Sequence[str], glob: str, files_per_trigger: int | None,
                 recursive: bool = False, whole: bool = False) -> DataFrame:
    """Lines (or whole files) of all folders as they arrive; ``files_per_trigger`` files of each to a micro-batch."""
    streams = []
    for folder in folders:
        r = spark.readStream.format("text").option("pathGlobFilter", glob).option("wholetext", str(whole).lower())
        if files_per_trigger:
            r = r.option("maxFilesPerTrigger", files_per_trigger)
        if recursive:
            r = r.option("recursiveFileLookup", "true")
        streams.append(r.load(folder).select(F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.file_modification_time").alias("arrival"), "value"))
    return reduce(DataFrame.union, streams)


def stream_summary(spark: SparkSession, dirs, glob: str = "*sequencing_summary*.txt",
                   files_per_trigger: int | None = 4) -> DataFrame:
    """Summary TSV files of all folders as they arrive: columns by header name and renames as in the batch scan.

    A file is one row until its lines meet its header, so a file of any number
    of splits is read alike (below 2 GB, Spark's limit of a value).
    """
    from seqyield.operators.reads import summary_time_columns
    from seqyield.sources.summary import SUMMARY_SCHEMA, cells_to_rows, split_dirs, whole_file_cells

    files = _text_stream(spark, split_dirs(dirs), glob, files_per_trigger, whole=True)
    return summary_time_columns(cells_to_rows(whole_file_cells(files, carried=["arrival"]), SUMMARY_SCHEMA, ["arrival"]))


def stream_fastq_headers(spark: SparkSession, dirs, glob: str = "*.fastq.gz",
                         files_per_trigger: int | None = 4, recursive: bool = False) -> DataFrame:
    """FASTQ header rows of all folders as files arrive (record-level quarantine: malformed records are dropped)."""
    from seqyield.sources.fastq import HEADER_COLUMNS, frame_records, parse_fastq, quarantine
    from seqyield.sources.summary import split_dirs

    lines = _text_stream(spark, split_dirs(dirs), glob, files_per_trigger, recursive)
    return quarantine(parse_fastq(frame_records(lines, ("file", "arrival")))).select("arrival", *HEADER_COLUMNS)
