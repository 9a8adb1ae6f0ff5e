"""FASTQ sources: records framed from text, headers parsed and judged record by record.

Framing.  A gzip file is never split, so its lines reach one task in order and
are grouped by four as Arrow batches pass through; plain files are read whole,
one row per file (below 2 GB each).  A record is well framed when its header
starts with ``@``, its separator with ``+``, and its sequence and quality are
equally long; what is left over at a file's end is a badly framed record.

Header parsing follows the reference: the id is the first token without
leading ``@``; every further whitespace token must split on ``=`` into exactly
two parts; duplicate keys keep the last value; ``read`` and ``ch`` are
integers, ``start_time`` an ISO instant.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.sources.summary import split_dirs

FASTQ_GLOB = "*.fastq.gz"
# Header keys of the reference and the columns they become.
HEADER_KEYS = {"runid": "run_id", "sampleid": "sample_id", "read": "read", "ch": "channel",
               "start_time": "start_time_utc"}
HEADER_COLUMNS = ("read_id", "run_id", "sample_id", "read", "channel", "start_time_utc")


def header_value(h: Column, key: str) -> Column:
    """Value of ``key=`` in a header; the last occurrence wins; NULL when absent."""
    pattern = r"(?:^|\s)" + key + r"=([^=\s]*)(?=\s|$)"
    return F.try_element_at(F.regexp_extract_all(h, F.lit(pattern), 1), F.lit(-1))


def header_tokens_bad(h: Column) -> Column:
    """True when a token after the id does not split on '=' into exactly two parts."""
    tokens = F.split(F.regexp_replace(h, r"\s+$", ""), r"\s+")
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.exists(rest, lambda t: F.size(F.split(t, "=")) != 2)


def parse_fastq_header(df: DataFrame, header_col: str = "header") -> DataFrame:
    """Add the six header columns and ``bad_header`` (malformed token, missing key,
    non-numeric ``read``/``ch`` or unparsable ``start_time``)."""
    h = F.col(header_col)
    out = df.withColumn("read_id", F.regexp_extract(h, r"^@+(\S*)", 1))
    raw = {k: header_value(h, k) for k in HEADER_KEYS}
    out = (out.withColumn("run_id", raw["runid"]).withColumn("sample_id", raw["sampleid"])
           .withColumn("read", raw["read"].try_cast("long"))
           .withColumn("channel", raw["ch"].try_cast("int"))
           .withColumn("start_time_utc", F.try_to_timestamp(raw["start_time"])))
    missing = None
    for k in HEADER_KEYS:
        e = raw[k].isNull()
        missing = e if missing is None else missing | e
    bad = (header_tokens_bad(h) | missing | F.col("read").isNull() | F.col("channel").isNull()
           | F.col("start_time_utc").isNull())
    return out.withColumn("bad_header", F.coalesce(bad, F.lit(True)))


def fastq_record_text(read_id: Column, header_rest: Column, seq: Column, qual: Column) -> Column:
    """One 4-line FASTQ record as a single text value (for writing test folders)."""
    return F.concat_ws("\n", F.concat(F.lit("@"), read_id, F.lit(" "), header_rest), seq, F.lit("+"), qual)


RECORD_SCHEMA = "file string, ordinal long, header string, seq string, plus string, qual string"


class _Framer:
    """Groups of four lines per file, as whole Arrow arrays; at most three lines wait for the next batch."""

    def __init__(self):
        self.head, self.waiting, self.ordinal = None, None, 0

    def _group(self, lines: pa.Array, whole: bool):
        """(head, ordinals, the four columns) of the lines of the present file; the rest waits unless ``whole``."""
        if self.waiting is not None and len(self.waiting):
            lines = pa.concat_arrays([self.waiting, lines])
        n = len(lines) // 4 * 4
        self.waiting = lines.slice(n)
        if whole and len(self.waiting):   # what is left at a file's end is a record that lacks lines
            missing = pa.nulls(4 - len(self.waiting), pa.string())
            lines, n, self.waiting = pa.concat_arrays([lines, missing]), n + 4, None
        count = n // 4
        if count:
            ordinals = np.arange(self.ordinal, self.ordinal + count)
            self.ordinal += count
            yield self.head, ordinals, [lines.take(pa.array(np.arange(p, n, 4))) for p in range(4)]

    def feed(self, heads: list[pa.Array], values: pa.Array):
        """Lines (or texts of several lines) with the columns that are constant within a file, the file first."""
        split = pc.split_pattern(values, "\n")
        ends = np.cumsum(np.asarray(pc.list_value_length(split)))
        lines, files = split.flatten(), heads[0]
        changes = np.asarray(pc.fill_null(pc.not_equal(files.slice(0, len(files) - 1), files.slice(1)), True))
        starts = np.concatenate([[0], np.nonzero(changes)[0] + 1])
        for row, after in zip(starts, np.append(starts[1:], len(files))):
            head = [h[int(row)] for h in heads]
            if self.head is None or self.head[0] != head[0]:
                yield from self.end()
                self.head, self.ordinal = head, 0
            first = int(ends[row - 1]) if row else 0
            yield from self._group(lines.slice(first, int(ends[after - 1]) - first), whole=False)

    def end(self):
        if self.waiting is not None and len(self.waiting):
            yield from self._group(pa.array([], pa.string()), whole=True)
        self.waiting = None


def frame_records(lines: DataFrame, carried: Sequence[str] = ("file",), value_col: str = "value") -> DataFrame:
    """Records ``(*carried, ordinal, header, seq, plus, qual, framing_ok)`` of text rows in file order.

    ``carried`` are columns that are constant within a file, the file first.
    """
    fields = [lines.schema[c] for c in carried]
    out = T.StructType([*fields, T.StructField("ordinal", T.LongType()),
                        *[T.StructField(c, T.StringType()) for c in ("header", "seq", "plus", "qual")]])
    names, kept = out.names, len(fields)

    def frame(batches):
        framer = _Framer()

        def rows(groups):
            for head, ordinals, four in groups:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(h, len(ordinals)) for h in head], pa.array(ordinals, pa.int64()), *four], names=names)
        for batch in batches:
            if batch.num_rows:
                yield from rows(framer.feed([batch.column(i) for i in range(kept)], batch.column(kept)))
        yield from rows(framer.end())

    framed = lines.select(*carried, value_col).mapInArrow(frame, out)
    # A line end at the end of a plain file leaves one empty line, which is no record.
    framed = framed.where(~((F.col("header") == "") & F.col("seq").isNull()))
    ok = (F.col("header").startswith("@") & F.col("plus").startswith("+")
          & (F.length("seq") == F.length("qual")))
    return framed.withColumn("framing_ok", F.coalesce(ok, F.lit(False)))


def _reader(reader, glob: str, recursive: bool):
    reader = reader.option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true") if recursive else reader


def scan_fastq_records(spark: SparkSession, dirs: str | Sequence[str], glob: str = FASTQ_GLOB,
                       recursive: bool = False, whole_files: bool | None = None) -> DataFrame:
    """Whole records of all files with a framing flag.

    ``whole_files`` reads one row per file; by default where the names do not end in ``.gz``.
    """
    whole = not glob.endswith(".gz") if whole_files is None else whole_files
    reader = _reader(spark.read, glob, recursive).option("wholetext", str(whole).lower())
    text = reader.text(split_dirs(dirs)).select(F.col("_metadata.file_path").alias("file"), "value")
    return frame_records(text)


def parse_fastq(records: DataFrame) -> DataFrame:
    """Records with the header columns, ``bad_header`` and ``bad_record`` (header or framing)."""
    parsed = parse_fastq_header(records)
    return parsed.withColumn("bad_record", F.col("bad_header") | ~F.col("framing_ok"))


def scan_fastq(spark: SparkSession, dirs: str | Sequence[str], glob: str = FASTQ_GLOB,
               mode: str = "record", recursive: bool = False) -> DataFrame:
    """Header table ``(read_id, run_id, sample_id, read, channel, start_time_utc)``.

    ``mode='record'`` drops malformed records only; ``mode='file'`` drops every
    row of a file that has one, in its header or its framing.
    """
    return quarantine(parse_fastq(scan_fastq_records(spark, dirs, glob, recursive)), mode).select(*HEADER_COLUMNS)


def bad_fastq_files(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Files that are not wholly well formed: ``(file, bad_headers, bad_framing, records)``.

    With ``files`` (a listing with column ``path``), files without any record are reported too.
    """
    found = parsed.groupBy("file").agg(F.count_if("bad_header").alias("bad_headers"),
                                       F.count_if(~F.col("framing_ok")).alias("bad_framing"),
                                       F.count(F.lit(1)).alias("records"))
    if files is not None:
        zero = F.lit(0).cast("long")
        found = files.select(F.col("path").alias("file")).join(found, "file", "left").select(
            "file", *[F.coalesce(c, zero).alias(c) for c in ("bad_headers", "bad_framing", "records")])
    return found.where("bad_headers > 0 or bad_framing > 0 or records = 0")


def quarantine(parsed: DataFrame, mode: str = "record") -> DataFrame:
    if mode == "record":
        return parsed.where(~F.col("bad_record"))
    if mode == "file":
        # One row per bad file: a small anti-join side, broadcast by AQE when it is small.
        return parsed.join(bad_fastq_files(parsed).select("file"), "file", "left_anti")
    raise ValueError("mode must be 'record' or 'file'")


def list_files(spark: SparkSession, dirs: str | Sequence[str], glob: str = FASTQ_GLOB,
               recursive: bool = False) -> DataFrame:
    """``(path, length)`` of the files through Spark's file index; contents are not read."""
    return _reader(spark.read.format("binaryFile"), glob, recursive).load(split_dirs(dirs)).select("path", "length")
