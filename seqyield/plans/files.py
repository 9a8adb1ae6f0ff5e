"""Run folders written by Spark from the driver's tables, for the source and file operators.

``events`` is cut into files of ``READS_PER_FILE`` reads, so the number of
files, and of tasks that write and read them, follows the table.  Every folder
is written once per session under the checkpoint root, with the names an
instrument gives its files:

* summary TSV files in two folders; the second has its columns in reverse order;
* gzip FASTQ files in two folders: every third file has malformed headers,
  another third has records with a short quality line, and one file is empty;
* gzip FASTQ files, four of five of them damaged or made of several members;
* a run folder with plain FASTQ, summary files and folders of ``.fast5`` files;
* Parquet files of ``events`` with increasing modification times, as a stream.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqyield.plans.tables import events_reads, table
from seqyield.session import file_system, materialize, path_stamp, shared_folder
from seqyield.sources.fastq import fastq_record_text
from seqyield.sources.fastq_source import file_system as arrow_file_system

# Fixed values of the synthetic run folder.
FLOWCELL_ID = "FAB00000"
RNUMBER = 4242
READS_PER_FILE = 500
FAST5_PER_BATCH = 5
#: Arrival of the first streamed file, and how late every fourth file of the second stream is.
FIRST_ARRIVAL_MS, LATE_MS = 1_700_000_000_000, 2 * 3600 * 1000


def _key(spark: SparkSession, kind: str, sf: str, name: str) -> tuple:
    return (kind, sf.rstrip("/"), path_stamp(spark, f"{sf.rstrip('/')}/{name}.parquet"))


def chunk(read: str = "read") -> Column:
    """Number of the file a read is in."""
    return F.floor(F.col(read) / READS_PER_FILE).cast("long")


class _Text:
    """A text file that is being written: one line a value, after ``head``; packed if its name ends in ``.gz``."""

    def __init__(self, out, name: str, head: str = ""):
        self.out, self.packed = out, None
        if name.endswith(".gz"):
            self.packed = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0)
        if head:
            self._put(head.encode() + b"\n")

    def _put(self, data: bytes) -> None:
        (self.packed or self.out).write(data)

    def write(self, rows: pa.RecordBatch) -> None:
        self._put("".join([(v or "") + "\n" for v in rows.column(0).to_pylist()]).encode())

    def close(self) -> None:
        if self.packed:
            self.packed.close()


class _Parquet:
    def __init__(self, out, name: str, head: str = ""):
        self.out, self.made = out, None

    def write(self, rows: pa.RecordBatch) -> None:
        self.made = self.made or pq.ParquetWriter(self.out, rows.schema)
        self.made.write_batch(rows)

    def close(self) -> None:
        self.made.close()


def _write_files(rows: DataFrame, numbers: Sequence[str], root: str, name: Callable[..., str], kind=_Text,
                 head: Callable[..., str] | None = None, arrival: Callable[..., int] | None = None,
                 order: str = "read") -> None:
    """One file ``name(*numbers)`` below ``root`` for every value of the number columns, its rows by ``order``.

    Tasks write the files themselves, one open at a time: a file appears under
    its name once it is whole, with ``arrival(*numbers)`` (ms) as its time.
    """
    spark = rows.sparkSession
    fs, place = file_system(spark, root)
    root = fs.makeQualified(place).toString()
    fs.mkdirs(place)
    kept = ["value"] if kind is _Text else [c for c in rows.columns if c not in numbers]
    sorted_ = rows.repartition(*numbers).sortWithinPartitions(*numbers, order).select(*numbers, *kept)
    n = len(numbers)

    def write(batches):
        store, base = arrow_file_system(root)
        folders, key, out, made, target, hidden = set(), None, None, None, "", ""
        late = []

        def finish():
            made.close()
            out.close()
            store.move(hidden, target)
            if arrival:
                ms = arrival(*key)
                if isinstance(store, pa.fs.LocalFileSystem):
                    os.utime(target, ns=(ms * 1_000_000, ms * 1_000_000))
                else:
                    late.append((f"{root}/{name(*key)}", ms))
        for batch in batches:
            if not batch.num_rows:
                continue
            if any(batch.column(i).null_count for i in range(n)):
                raise ValueError(f"a row without {' or '.join(numbers)}")
            values = [np.asarray(batch.column(i)) for i in range(n)]
            changes = np.zeros(batch.num_rows, bool)
            for v in values:
                changes[1:] |= v[1:] != v[:-1]
            starts = [0, *np.nonzero(changes)[0].tolist(), batch.num_rows]
            body = pa.RecordBatch.from_arrays(batch.columns[n:], schema=pa.schema([batch.schema.field(i) for i in range(n, batch.num_columns)]))
            for a, b in zip(starts, starts[1:]):
                own = tuple(int(v[a]) for v in values)
                if own != key:
                    if key is not None:
                        finish()
                    key, target = own, f"{base}/{name(*own)}"
                    folder, file = target.rsplit("/", 1)
                    if folder not in folders:
                        store.create_dir(folder, recursive=True)
                        folders.add(folder)
                    hidden = f"{folder}/.{file}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(hidden, compression=None)
                    made = kind(out, file, head(*own) if head else "")
                made.write(body.slice(a, b - a))
        if key is not None:
            finish()
        if late:
            yield pa.RecordBatch.from_pylist([{"path": p, "ms": ms} for p, ms in late],
                                             schema=pa.schema([("path", pa.string()), ("ms", pa.int64())]))
    # Only a store whose times Python cannot set gives rows.
    for r in materialize(sorted_.mapInArrow(write, "path string, ms long"), "arrivals").toLocalIterator():
        own, target = file_system(spark, r["path"])
        own.setTimes(target, r["ms"], -1)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """(file, read, value): one FASTQ record per event."""
    r = events_reads(spark, sf).withColumn("file", chunk())
    eid = F.col("read")
    iso = F.date_format(F.col("start_time_utc").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rest = F.format_string("runid=%s sampleid=%s read=%d ch=%d start_time=%s",
                           "run_id", "sample_id", eid, "channel", iso)
    one, two = F.pmod("file", F.lit(3)) == 1, F.pmod("file", F.lit(3)) == 2
    rest = F.when(one & (F.pmod(eid, F.lit(77)) == 0), F.lit("flag")).when(
        one & (F.col("run_id") == "error") & (F.pmod(eid, F.lit(7)) == 0), F.concat(rest, F.lit(" flag"))).otherwise(rest)
    n = (F.pmod(eid, F.lit(50)) + 1).cast("int")
    seq = F.substring(F.repeat(F.lit("ACGT"), 13), 1, n)
    short = two & (F.pmod(eid, F.lit(101)) == 0)
    qual = F.substring(F.repeat(F.lit("@I!#"), 13), 1, F.when(short, n - 1).otherwise(n))
    return r.select("file", "read", fastq_record_text(F.col("read_id"), rest, seq, qual).alias("value"))


def fastq_folders(spark: SparkSession, sf: str) -> str:
    """Two folders (comma list) of ``fastq_<n>.fastq.gz``, odd numbers in the second."""
    def write(path):
        _write_files(_records(spark, sf), ["file"], path, lambda k: f"{'ab'[k % 2]}/fastq_{k}.fastq.gz")
        fs, empty = file_system(spark, f"{path}/a/fastq_999999.fastq.gz")
        out = fs.create(empty)
        out.write(bytearray(gzip.compress(b"")))
        out.close()
        file_system(spark, path)[0].mkdirs(file_system(spark, f"{path}/b")[1])
    root = shared_folder(spark, _key(spark, "fastq", sf, "events"), write, "fastq")
    return f"{root}/a,{root}/b"


def damaged_archive(records: list[bytes], kind: int) -> bytes:
    """A gzip file of records: 0 one member, 1 several, 2 cut off after the first half, 3 two members, the first
    with a wrong check sum, 4 the first half and then something else."""
    half = len(records) // 2
    one, two = b"".join(records[:half]), b"".join(records[half:])
    if kind == 1:
        return b"".join(gzip.compress(b"".join(records[i:i + 100])) for i in range(0, len(records), 100))
    if kind == 2:
        made = zlib.compressobj(wbits=31)
        whole = made.compress(one) + made.flush(zlib.Z_FULL_FLUSH)
        return whole + (made.compress(two) + made.flush())[:5]
    if kind == 3:
        first = bytearray(gzip.compress(one))
        first[-8] ^= 0xFF
        return bytes(first) + gzip.compress(two)
    return gzip.compress(one) + b"no member" if kind == 4 else gzip.compress(one + two)


def damaged_folder(spark: SparkSession, sf: str) -> str:
    """``fastq_<n>.fastq.gz`` of ``events``, damaged by their number modulo 5 (see :func:`damaged_archive`)."""
    def write(path):
        file_system(spark, path)[0].mkdirs(file_system(spark, path)[1])

        def encode(key, table):
            number = key[0].as_py()
            records = [v.as_py().encode() + b"\n" for v in table.sort_by("read").column("value")]
            fs, target = arrow_file_system(f"{path}/fastq_{number}.fastq.gz")
            with fs.open_output_stream(target, compression=None) as out:
                out.write(damaged_archive(records, number % 5))
            return pa.table({"file": pa.array([number], pa.int64())})
        _records(spark, sf).groupBy("file").applyInArrow(encode, "file long").write.format("noop").mode("overwrite").save()
    return shared_folder(spark, _key(spark, "damaged", sf, "events"), write, "damaged")


def _summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = events_reads(spark, sf)
    broken = F.pmod(F.col("read"), F.lit(333)) == 0
    return r.select(
        chunk().alias("file"), "read",
        F.concat(F.lit("batch_"), F.col("run_id"), F.lit(".fast5")).alias("filename"),
        "read_id", "run_id", "channel", F.col("start_time_float").alias("start_time"),
        F.col("template_duration").alias("duration"), "num_events",
        F.col("start_time_float").alias("template_start"),
        F.col("num_events").alias("num_events_template"),
        F.when(broken, F.lit("?")).otherwise(F.col("template_duration").cast("string")).alias("template_duration"),
        "sequence_length_template", F.coalesce(F.col("mean_qscore_template").cast("string"), F.lit("nan")).alias("mean_qscore_template"),
        F.lit(-0.0003).alias("strand_score_template"))


def _summary_lines(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, read, value): the rows as lines of a summary file."""
    return rows.select("file", "read", F.to_csv(F.struct(*names), {"sep": "\t"}).alias("value"))


def _summary_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("file", "read")]


def summary_folders(spark: SparkSession, sf: str) -> str:
    """Two folders (comma list) of ``sequencing_summary_<n>.txt``; the second has the columns reversed."""
    def write(path):
        rows = _summary_rows(spark, sf)
        names = _summary_names(rows)
        for k, (folder, order) in enumerate((("a", names), ("b", names[::-1]))):
            file_system(spark, path)[0].mkdirs(file_system(spark, f"{path}/{folder}")[1])
            top = "\t".join(order)
            _write_files(_summary_lines(rows.where(F.pmod("file", F.lit(2)) == k), order), ["file"], f"{path}/{folder}",
                         lambda n: f"sequencing_summary_{n}.txt", head=lambda n, top=top: top)
    root = shared_folder(spark, _key(spark, "summary", sf, "events"), write, "summary")
    return f"{root}/a,{root}/b"


def run_folder(spark: SparkSession, sf: str, first_half: bool = False) -> str:
    """``run/`` with summaries, plain FASTQ and ``reads/<n>/*.fast5``; ``first_half`` has the lower batch numbers."""
    def write(path):
        records, rows = _records(spark, sf), _summary_rows(spark, sf)
        members = events_reads(spark, sf).select(
            chunk().alias("file"), F.pmod("read", F.lit(FAST5_PER_BATCH)).alias("member"), "read",
            F.concat_ws("|", "read_id", "run_id", "channel").alias("value"))
        if first_half:
            last = events_reads(spark, sf).agg(F.max(chunk())).head()[0] or 0
            records, rows, members = (d.where(F.col("file") <= last // 2) for d in (records, rows, members))
        names = _summary_names(rows)
        top = "\t".join(names)
        arrival = lambda k, *_: FIRST_ARRIVAL_MS + 60_000 * k  # noqa: E731  a batch a minute
        _write_files(records, ["file"], path, lambda k: f"fastq_{k}.fastq", arrival=arrival)
        _write_files(_summary_lines(rows, names), ["file"], path, lambda k: f"sequencing_summary_{k}.txt",
                     head=lambda k: top, arrival=arrival)
        _write_files(members, ["file", "member"], path,
                     lambda k, m: f"reads/{k}/PC_{RNUMBER}_FAH_{m}_ch_{m}_strand.fast5", arrival=arrival)
    return shared_folder(spark, _key(spark, "run-half" if first_half else "run", sf, "events"), write, "run")


def event_stream_folder(spark: SparkSession, sf: str, late: bool = False, closing: bool = False) -> str:
    """``events_<n>.parquet`` one second apart; with ``late`` every fourth arrives two hours later.

    With ``closing`` a last file follows two days later, with one row of a far
    time and a negative number: the end of the run, which only moves the watermarks.
    """
    def write(path):
        ev = table(spark, sf, "events")
        _write_files(ev.withColumn("file", chunk("event_id")), ["file"], path, lambda k: f"events_{k:08d}.parquet", _Parquet,
                     arrival=lambda k: FIRST_ARRIVAL_MS + 1000 * k + (LATE_MS if late and k % 4 == 3 else 0), order="event_id")
        if closing:
            values = {"event_id": F.lit(-1), "ts": F.lit("2200-01-01 00:00:00")}
            end = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ev.schema],
                                        F.lit(99_999_999).alias("file"))
            _write_files(end, ["file"], path, lambda k: f"events_{k}.parquet", _Parquet,
                         arrival=lambda k: FIRST_ARRIVAL_MS + 48 * 3600 * 1000, order="event_id")
    kind = "events" + "-late" * late + "-closing" * closing
    return shared_folder(spark, _key(spark, kind, sf, "events"), write, "events")


def batch_names(spark: SparkSession, sf: str):
    """Name listings of a run folder, from ``part`` (summary, FASTQ) and ``lineitem`` (FAST5)."""
    part = table(spark, sf, "part")
    li = table(spark, sf, "lineitem")
    summ = part.select(F.format_string("run/sequencing_summary_%d.txt", "p_partkey").alias("path")).unionByName(
        part.where("p_size = 1").select(F.format_string("run/sequencing_summary_%d.txt.bak", "p_partkey").alias("path")))
    fq = part.where("p_size <= 40").select(F.format_string("run/fastq_%d.fastq", "p_partkey").alias("path"))
    f5_files = li.select(F.format_string("run/reads/%d/run_%d_fc_%d_ch_%d_strand.fast5", "l_partkey", F.lit(RNUMBER),
                                         "l_linenumber", "l_suppkey").alias("path"))
    f5_dirs = li.select(F.format_string("run/reads/%d", "l_partkey").alias("path")).distinct()
    return summ, fq, f5_dirs, f5_files
