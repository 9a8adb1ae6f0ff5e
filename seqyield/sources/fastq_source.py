"""FASTQ files read in pieces: damaged archives, files of any size, a ``fastq`` data source.

*Archives* are inflated member by member, a bounded piece at a time, and
records are framed as the text comes.  A member that is cut off, broken or
does not match its check sum ends with an error; every whole record up to
there is still given, and after a wrong check sum the next member is read on.
Nothing here fails a job because of what a file holds.

*Plain files* are cut at byte offsets.  A task starts at the first record
border at or after its offset and ends where the next task starts, so the
records do not depend on the cuts.  A border is a line that starts with ``@``,
followed by three lines of which the second starts with ``+`` and the first and
third are equally long; a quality line that starts with ``@`` is no border, as
a sequence does not start with ``+``.

Every file gives its records (``file, offset, header, seq, plus, qual,
framing_ok``; ``offset`` is the place in the text) and, for every task, one row with
``bytes_read`` (bytes of the file) and ``error``.  A file's last lines that are no whole record are
a badly framed record, or nothing where the file is damaged.

Two ways in, with the same rows: :func:`scan_content` takes the bytes from
Spark's ``binaryFile`` (any store that Spark reads, files below 2 GB; Spark
leaves out files of zero bytes), and the data
source opens the files itself through ``pyarrow.fs`` (local and shared
folders, HDFS, S3, GCS; any size; plain files cut into several tasks; batch and stream).
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from seqyield.sources.summary import split_dirs

#: Bytes of a file taken at a time, and of text framed at a time.
PIECE, TEXT = 1 << 20, 1 << 22
#: Bytes of a plain file that are cut off at a time, and of all files that a task of the data source reads.
PARTITION_BYTES = 64 << 20
#: Bytes that opening a file counts for, when files are dealt over tasks.
OPEN_BYTES = 1 << 12
ROWS = ("file string, offset long, header string, seq string, plus string, qual string, framing_ok boolean, "
        "bytes_read long, error string")
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("header", pa.string()), ("seq", pa.string()),
                    ("plus", pa.string()), ("qual", pa.string()), ("framing_ok", pa.bool_()), ("bytes_read", pa.int64()),
                    ("error", pa.string())])


def _header_size(held: bytes) -> int | None:
    """Bytes of the gzip member header that ``held`` begins with; None: not all there; -1: none."""
    if not b"\x1f\x8b\x08".startswith(held[:3]):
        return -1
    if len(held) < 10:
        return None
    flags, at = held[3], 10
    if flags & 4:
        if len(held) < at + 2:
            return None
        at += 2 + struct.unpack_from("<H", held, at)[0]
    for flag in (8, 16):  # name, comment
        if flags & flag:
            end = held.find(b"\0", at)
            if end < 0:
                return None
            at = end + 1
    at += 2 * bool(flags & 2)
    return at if len(held) >= at else None


def inflated(read: Callable[[int], bytes], errors: list[str]) -> Iterator[bytes]:
    """The text of a gzip file in pieces; what is wrong with it goes to ``errors``."""
    held, member = b"", 0
    while True:
        while (size := _header_size(held)) is None or not held:
            more = read(PIECE)
            if not more:
                if held or not member:
                    errors.append(f"member {member}: " + ("cut off" if held else "nothing there"))
                return
            held += more
        if size < 0:
            rest = held
            while member and not rest.strip(b"\0") and (rest := read(PIECE)):
                pass  # zeros may fill up the end of an archive
            if rest.strip(b"\0") or not member:
                errors.append(f"member {member}: not gzip")
            return
        held, check, length = held[size:], 0, 0
        member_data, full = zlib.decompressobj(-zlib.MAX_WBITS), False
        while not member_data.eof:
            if not held and not full:
                held = read(PIECE)
                if not held:
                    errors.append(f"member {member}: cut off")
                    return
            try:
                text = member_data.decompress(held, TEXT)
            except zlib.error:
                errors.append(f"member {member}: broken")
                return
            held, full = member_data.unconsumed_tail, len(text) == TEXT
            check, length = zlib.crc32(text, check), length + len(text)
            if text:
                yield text
        held = member_data.unused_data
        while len(held) < 8:
            more = read(PIECE)
            if not more:
                errors.append(f"member {member}: cut off")
                return
            held += more
        if struct.unpack_from("<II", held) != (check, length & 0xFFFFFFFF):
            errors.append(f"member {member}: wrong check sum")
        held, member = held[8:], member + 1


def _strings(lines: pa.Array) -> pa.Array:
    try:
        return lines.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 become replacement characters, as in Spark's text source
        return pa.array([x.decode("utf-8", "replace") for x in lines.to_pylist()], pa.string())


def _batch(file: str, offsets, four: Sequence[pa.Array]) -> pa.RecordBatch:
    header, seq, plus, qual = four
    n = len(header)
    ok = pc.and_(pc.and_(pc.starts_with(header, "@"), pc.starts_with(plus, "+")),
                 pc.equal(pc.utf8_length(seq), pc.utf8_length(qual)))
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array(offsets, pa.int64()), header, seq, plus, qual, pc.fill_null(ok, False),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], schema=_ARROW)


def _ending(file: str, bytes_read: int, errors: Sequence[str]) -> pa.RecordBatch:
    row = {"file": file, "bytes_read": bytes_read, "error": "; ".join(errors) or None}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def framed(file: str, texts: Iterator[bytes], at: int, errors: list[str]) -> Iterator[pa.RecordBatch]:
    """Records of the text pieces of one file, as batches; the text begins at offset ``at``."""
    held = b""
    for text in texts:
        held = held + text if held else text
        ends = np.flatnonzero(np.frombuffer(held, np.uint8) == 10)
        n = len(ends) // 4 * 4
        if not n:
            continue
        body, held, ends = held[:ends[n - 1]], held[ends[n - 1] + 1:], ends[:n]
        lines = pc.split_pattern(pa.array([body], pa.binary()), pattern=b"\n").values
        if b"\r" in body:
            lines = pa.array([x[:-1] if x.endswith(b"\r") else x for x in lines.to_pylist()], pa.binary())
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield _batch(file, at + starts[::4], [_strings(lines.take(pa.array(np.arange(p, n, 4)))) for p in range(4)])
        at += int(ends[-1]) + 1
    rest = [x[:-1] if x.endswith(b"\r") else x for x in held.split(b"\n")]
    while rest and rest[-1] == b"":
        rest.pop()
    if rest and (not errors or len(rest) == 4 and len(rest[1]) == len(rest[3])):
        yield _batch(file, [at], [_strings(pa.array([rest[p] if p < len(rest) else None], pa.binary())) for p in range(4)])


def read_archive(file: str, read: Callable[[int], bytes]) -> Iterator[pa.RecordBatch]:
    """Records and ending of a gzip FASTQ file."""
    errors, taken = [], 0

    def counted(n):
        nonlocal taken
        piece = read(n)
        taken += len(piece)
        return piece
    yield from framed(file, inflated(counted, errors), 0, errors)
    yield _ending(file, taken, errors)


def border(source, size: int, offset: int) -> int:
    """The first record border of a plain file at or after ``offset`` (its size if there is none)."""
    if offset <= 0:
        return 0
    if offset >= size:
        return size
    window = 1 << 16
    while True:
        source.seek(offset - 1)
        text = source.read(window)
        whole = offset - 1 + len(text) >= size
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10).tolist()
        lines = [a + 1 for a in ends]  # the starts of the lines that begin in the window
        stops = [*ends[1:], *([len(text)] if whole and text and text[-1:] != b"\n" else [])]
        for k in range(len(stops) - 3):
            a, b, c, d = (text[lines[k + i]:stops[k + i]].rstrip(b"\r") for i in range(4))
            if a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d):
                return offset - 1 + lines[k]
        if whole:
            return size
        window *= 4


def read_plain(file: str, source, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Records whose borders lie in [start, end) of a plain FASTQ file, and an ending."""
    first, last = border(source, size, start), border(source, size, end)

    def pieces():
        source.seek(first)
        left = last - first
        while left > 0:
            text = source.read(min(TEXT, left))
            if not text:
                return
            left -= len(text)
            yield text
    yield from framed(file, pieces(), first, [])
    yield _ending(file, last - first, [])


def scan_content(spark: SparkSession, dirs: str | Sequence[str], glob: str = "*.fastq.gz",
                 recursive: bool = False) -> DataFrame:
    """Rows of all files that Spark's ``binaryFile`` gives; each file is decoded by one task, a piece at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        files = files.option("recursiveFileLookup", "true")

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = pa.BufferReader(content.as_buffer())
                if path.endswith(".gz"):
                    yield from read_archive(path, source.read)
                else:
                    yield from read_plain(path, source, source.size(), 0, source.size())
    return files.load(split_dirs(dirs)).select("path", "content").mapInArrow(decode, ROWS)


# --- the data source ----------------------------------------------------------------

def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


class Slice(InputPartition):
    """Bytes [start, end) of files, ``(path, size, start, end)``: the cuts of plain files that one task reads."""

    def __init__(self, files: Sequence[tuple[str, int, int, int]]):
        self.files = files


class _Files:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.dirs = split_dirs(options["path"])
        self.globs = options.get("glob", "*.fastq.gz,*.fastq").split(",")
        self.step = max(int(options.get("partitionbytes", PARTITION_BYTES)), 1)
        self.tasks = max(int(options.get("mintasks", 1)), 1)

    def listing(self) -> list[tuple[int, str, int]]:
        """(modification time in ns, path, bytes) of the files, oldest first."""
        found = []
        for folder in self.dirs:
            fs, root = file_system(folder)
            for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and any(fnmatch.fnmatch(f.base_name, g) for g in self.globs):
                    found.append((f.mtime_ns or 0, folder.rstrip("/") + "/" + f.base_name, f.size))
        return sorted(found)

    def slices(self, files: Sequence[tuple[int, str, int]]) -> list[Slice]:
        """The files dealt over tasks: a task reads whole cuts of ``step`` bytes, as many as make up its share.

        Its share is PARTITION_BYTES, or less where the files are too few for ``tasks`` tasks; an archive is one
        cut.  No more cuts than ``tasks`` are a task each.
        """
        cuts = sum(1 if path.endswith(".gz") else max(-(-size // self.step), 1) for _, path, size in files)
        share = 1 if cuts <= self.tasks else max(self.step, min(PARTITION_BYTES, -(-sum(max(size, OPEN_BYTES) for _, _, size in files) // self.tasks)))
        found, held, room = [], [], share
        for _, path, size in files:
            at = 0
            while True:
                if room <= 0:
                    found.append(Slice(held))
                    held, room = [], share
                cuts = max(room // self.step, 1)
                end = size if path.endswith(".gz") else min(at + cuts * self.step, size)
                held.append((path, size, at, end))
                room, at = room - max(end - at, OPEN_BYTES), end
                if at >= size:
                    break
        return [*found, Slice(held)] if held else found

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for name, size, start, end in part.files:
            fs, path = file_system(name)
            with fs.open_input_file(path) as source:
                if path.endswith(".gz"):
                    yield from read_archive(name, source.read)
                    continue
                for at in range(start, end, self.step) if end > start else [start]:
                    yield from read_plain(name, source, size, at, min(at + self.step, end))


class FastqReader(_Files, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return self.slices(self.listing()) or [Slice([])]


class FastqStreamReader(_Files, DataSourceStreamReader):
    """Files in the order of their modification times; an offset is the last file's (time, path)."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listing()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.slices([f for f in self.listing() if after < f[:2] <= upto])

    def commit(self, end: dict) -> None:
        """Spark's own offsets say all there is to know."""


class FastqDataSource(DataSource):
    """``spark.read.format("fastq")`` and ``spark.readStream.format("fastq")``.

    Options: ``path`` (folders, by commas), ``glob`` (name patterns, by commas;
    names ending in ``.gz`` are archives), ``partitionBytes`` (a cut of a plain
    file), ``minTasks`` (small files travel together, in as many tasks at least).
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)

    def streamReader(self, schema) -> FastqStreamReader:
        return FastqStreamReader(self.options)


def fastq_reader(spark: SparkSession, dirs: str | Sequence[str], glob: str = "*.fastq.gz,*.fastq",
                 partition_bytes: int = PARTITION_BYTES, stream: bool = False):
    """The configured reader of the data source; ``load()`` gives the rows."""
    spark.dataSource.register(FastqDataSource)
    reader = spark.readStream if stream else spark.read
    return (reader.format("fastq").option("path", ",".join(split_dirs(dirs))).option("glob", glob)
            .option("partitionBytes", str(partition_bytes)).option("minTasks", str(4 * spark.sparkContext.defaultParallelism)))


# --- from rows to records and reports -------------------------------------------------

def records(rows: DataFrame) -> DataFrame:
    """The records of the rows."""
    return rows.where("bytes_read is null").drop("bytes_read", "error")


def file_report(rows: DataFrame) -> DataFrame:
    """``(file, records, bad_framing, bytes_read, error)``: what was read of every file, and what is wrong with it."""
    record = F.col("bytes_read").isNull()
    return rows.groupBy("file").agg(
        F.count_if(record).alias("records"), F.count_if(record & ~F.col("framing_ok")).alias("bad_framing"),
        F.sum("bytes_read").alias("bytes_read"), F.max("error").alias("error"))


def sound_records(rows: DataFrame, mode: str = "record") -> DataFrame:
    """Well framed records; with ``mode='file'`` only those of files without any fault."""
    good = records(rows).where("framing_ok")
    if mode == "record":
        return good
    if mode == "file":
        # One row a damaged file, joined by name; Spark broadcasts it when it is small.
        faulty = file_report(rows).where("error is not null or bad_framing > 0").select("file")
        return good.join(faulty, "file", "left_anti")
    raise ValueError("mode must be 'record' or 'file'")
