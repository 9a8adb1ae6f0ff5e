"""Streaming jobs that keep state of their own: running values per read, unmatched reads, duplicates.

* ``running_reads`` — every read with its ordinal and running yield within its
  channel, in time order.  Reads wait in list state until the watermark has passed
  their time, as an earlier read may still come; an event-time timer at the
  earliest waiting read wakes a channel, which sends what is due in order and
  keeps two numbers.  State holds the reads of the watermark's delay.
* ``unmatched_stream`` — full outer join of the summary and the FASTQ stream: a
  read without its other half leaves once, when the watermark says that the half can no longer
  come.
* ``live_manifest`` — the batches of a growing run folder, each when no file of it
  has come for a while.
* ``dedup_stream`` — the first of equal keys; keys are forgotten after the
  watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqyield.functions.expr import basename, micros
from seqyield.operators.batches import FAST5_DIR, FASTQ_NAME, SUMMARY_NAME
from seqyield.streaming.jobs import READ_KEYS, listing_tasks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """New streaming queries keep their state in RocksDB, which list and value state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class RunningReads(StatefulProcessor):
    """Reads of one channel in time order, with what came before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "reads long, bases long")
        self.waiting = handle.getListState("waiting", "time_us long, read_id string, length long")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, time_us: int) -> None:
        """At the first whole millisecond at which the read is due; earlier timers may ring in vain."""
        ms = -(-time_us // 1000)
        if not self.due.exists() or ms < self.due.get()[0]:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["time_us"], r["read_id"], r["length"]) for r in rows if r["read_id"] is not None]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        reads, bases = self.totals.get() if self.totals.exists() else (0, 0)
        for time_us, read_id, length in due:
            reads, bases = reads + 1, bases + (length or 0)
            yield Row(channel=key[0], read_id=read_id, time_us=time_us, channel_count=reads, channel_yield=bases)
        if due:
            self.totals.update((reads, bases))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if self.due.exists() and self.due.get()[0] * 1000 <= now:
            self.due.clear()
            if later:
                self._wake(later[0][0])

    def close(self) -> None:
        pass


def running_reads(reads: DataFrame, time_col: str = "start_time_utc", channel_col: str = "channel",
                  id_col: str = "read_id", length_col: str = "sequence_length_template",
                  watermark: str = "1 hour") -> DataFrame:
    """``(channel, read_id, time_us, channel_count, channel_yield)`` of a stream, in time order within a channel.

    Ties in time go by id.  A row without an id only moves the watermark (the
    end of a run can be told so).  Reads that come after the watermark passed their time are dropped.
    """
    dtype = reads.schema[time_col].dataType
    us = micros(time_col, dtype)
    if isinstance(dtype, T.TimestampNTZType):
        reads = reads.withColumn(time_col, F.timestamp_micros(us))
        us = F.unix_micros(time_col)
    kind = reads.schema[channel_col].dataType.simpleString()
    narrow = reads.withWatermark(time_col, watermark).select(
        F.col(channel_col).alias("channel"), time_col, us.alias("time_us"), F.col(id_col).alias("read_id"),
        F.col(length_col).cast("long").alias("length"))
    return narrow.groupBy("channel").transformWithState(
        RunningReads(), f"channel {kind}, read_id string, time_us long, channel_count long, channel_yield long",
        "Append", "EventTime")


def unmatched_stream(summary: DataFrame, fastq: DataFrame, keys: Sequence[str] = READ_KEYS,
                     watermark: str = "1 hour", max_gap: str = "1 hour") -> DataFrame:
    """``(*keys, side)``: reads whose other half did not arrive within ``max_gap``, each once.

    Both streams have a column ``arrival``.  What this gives in the end are the
    batch audit's rows, and both halves of the pairs that came further apart.
    """
    s = summary.select(*keys, F.col("arrival").alias("s_arrival")).withWatermark("s_arrival", watermark)
    f = fastq.select(*keys, F.col("arrival").alias("f_arrival")).withWatermark("f_arrival", watermark)
    gap = F.expr(f"INTERVAL {max_gap}")
    on = [s[k] == f[k] for k in keys] + [f["f_arrival"].between(s["s_arrival"] - gap, s["s_arrival"] + gap)]
    both = s.join(f, on, "full_outer")
    alone = both.where(F.col("s_arrival").isNull() | F.col("f_arrival").isNull())
    return alone.select(*[F.coalesce(s[k], f[k]).alias(k) for k in keys],
                        F.when(F.col("f_arrival").isNull(), "summary").otherwise("fastq").alias("side"))


def dedup_stream(reads: DataFrame, keys: Sequence[str] = READ_KEYS, time_col: str = "arrival",
                 watermark: str = "1 hour") -> DataFrame:
    """The first arrival of every read; what arrives again within the watermark's delay is dropped."""
    return reads.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(list(keys))


def run_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """``(path, modificationTime)`` of the files below a run folder as they arrive; contents are not read."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    with listing_tasks(spark):
        return reader.load(folder).select("path", "modificationTime")


def live_manifest(files: DataFrame, quiet: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """``(number, sequencing_summary_file, fastq_file, fast5_dir, files, ended)``: batches that have come to rest.

    The files of a batch are one session by arrival; it ends when none has come
    for ``quiet``, and leaves when the watermark has passed that.  Until then the batch is
    active and its few numbers are all the state there is.  A file that comes
    after that opens another session of the batch (see :func:`finished_batches`).
    """
    def number(pattern: str, of: Column) -> Column:
        return F.nullif(F.regexp_extract(of, pattern, 1), F.lit("")).cast("long")
    path = F.col("path")
    base, parent = basename(path), F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    kinds = {"sequencing_summary_file": (number(SUMMARY_NAME, base), path), "fastq_file": (number(FASTQ_NAME, base), path),
             "fast5_dir": (F.when(base.endswith(".fast5"), number(FAST5_DIR, basename(parent))), parent)}
    named = files.withWatermark("modificationTime", watermark).select(
        "modificationTime", F.coalesce(*[n for n, _ in kinds.values()]).alias("number"),
        *[F.when(n.isNotNull(), value).alias(c) for c, (n, value) in kinds.items()])
    sessions = named.groupBy(F.session_window("modificationTime", quiet).alias("w"), "number").agg(
        *[F.max(c).alias(c) for c in kinds], F.count(F.lit(1)).alias("files"))
    return sessions.where("number is not null").select("number", *kinds, "files", F.col("w.end").alias("ended"))


def finished_batches(sessions: DataFrame) -> DataFrame:
    """The manifest rows of stored sessions: batches of which all three kinds have come."""
    kinds = ["sequencing_summary_file", "fastq_file", "fast5_dir"]
    whole = sessions.groupBy("number").agg(*[F.max(c).alias(c) for c in kinds], F.sum("files").alias("files"))
    return whole.where(" and ".join(f"{c} is not null" for c in kinds))
