"""Files listed and read by tasks: folders of hundreds of thousands of small files.

Spark's file index lists on the driver and keeps a status of every file there,
again for every read.  Here tasks list a folder each, level by level, and the
listing is a table: it is made once, joined like any other, and the tasks that
get its rows open the files themselves.  Folders that Python cannot open
(another store, name patterns) go through Spark's file index as before.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.session import file_system, literal_rows, materialize
from seqyield.sources.fastq_source import file_system as arrow_file_system

LISTED = "path string, length long, modificationTime timestamp, folder boolean"
#: Bytes of files that a task reads at most, and of contents that are handed on at a time.
TASK_BYTES, HELD = 256 << 20, 16 << 20


def _indexed(spark: SparkSession, folders: str | Sequence[str], glob: str | None, recursive: bool) -> DataFrame:
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(folders).select("path", "length", "modificationTime")


def _own_folders(spark: SparkSession, folders: Sequence[str], glob: str | None) -> list[str] | None:
    """The folders with their store; None if tasks cannot list them."""
    if any(c in (glob or "") for c in "{[\\"):
        return None
    found = []
    for folder in folders:
        if any(c in folder for c in "*?[{\\"):
            return None
        fs, path = file_system(spark, folder)
        path = fs.makeQualified(path)
        if not fs.exists(path):
            return None  # Spark's reader says so
        try:
            arrow_file_system(path.toString())
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            return None
        found.append(path.toString())
    return found


def _list_level(folders: DataFrame, glob: str | None) -> DataFrame:
    """The files (matching ``glob``) and folders in every folder of the column ``path``."""
    def listed(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, root = arrow_file_system(folder)
                info = fs.get_file_info(root)
                own = info.type == pyarrow.fs.FileType.File
                rows = [[], [], [], []]
                for f in [info] if own else fs.get_file_info(pyarrow.fs.FileSelector(root)):
                    name, is_folder = f.base_name, f.type == pyarrow.fs.FileType.Directory
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                    # As Spark's index: hidden files, and files of zero bytes, are not there.
                    if hidden or not is_folder and (not f.size or glob and not fnmatch.fnmatchcase(name, glob)):
                        continue
                    for to, value in zip(rows, (folder if own else folder.rstrip("/") + "/" + name, None if is_folder else f.size,
                                                (f.mtime_ns or 0) // 1_000_000 * 1000, is_folder)):
                        to.append(value)
                for at in range(0, len(rows[0]), 10_000):
                    path, size, time, is_folder = (r[at:at + 10_000] for r in rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(time, pa.timestamp("us", tz="UTC")),
                         pa.array(is_folder, pa.bool_())], names=["path", "length", "modificationTime", "folder"])
    return folders.select("path").mapInArrow(listed, LISTED)


def list_files(spark: SparkSession, folders: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``(path, length, modificationTime)`` of the files in the folders (with ``recursive`` below them); contents are not read.

    A table that is written once: the rows stand as the folders were at the call.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    own = _own_folders(spark, folders, glob)
    if own is None:
        return _indexed(spark, folders, glob, recursive)
    tasks = 4 * spark.sparkContext.defaultParallelism
    level = literal_rows(spark, [(f,) for f in dict.fromkeys(own)], "path string")
    found = None
    while True:
        listed = materialize(_list_level(level, glob), "listing")
        files = listed.where("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        level = listed.where("folder").select("path")
        if not recursive or level.isEmpty():
            return found
        level = level.repartition(tasks, "path")


def dealt(files: DataFrame, *by: str) -> DataFrame:
    """Listed files (``path``, ``length``) dealt over tasks by ``by``, or one by one."""
    size = files.agg(F.sum("length")).head()[0] or 0
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.repartition(tasks, *(by or ("path",)))


def _read(files: DataFrame, fields: Sequence[T.StructField], rows_of) -> DataFrame:
    """The columns of the files and what ``rows_of(bytes)`` gives, lists of values for the fields, per file."""
    kept = files.columns
    schema = T.StructType([*files.schema.fields, *fields])
    at = kept.index("path")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(at).to_pylist()):
                fs, place = arrow_file_system(path)
                with fs.open_input_file(place) as source:
                    for arrays in rows_of(source):
                        n = len(arrays[0])
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [*[pa.repeat(batch.column(k)[i], n) for k in range(len(kept))], *arrays], names=schema.names)

    def gathered(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in read(batches):
            held.append(b)
            size += b.nbytes
            if size >= HELD or len(held) >= 2000:
                yield from _one(held)
                held, size = [], 0
        if held:
            yield from _one(held)

    def _one(held):
        # Rows of small files travel together; a large content stays a batch of its own.
        if sum(b.nbytes for b in held) > 2 * HELD:
            yield from held
        else:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return files.mapInArrow(gathered, schema)


def contents(files: DataFrame) -> DataFrame:
    """Listed files with their bytes as ``content`` (below 2 GB each)."""
    return _read(files, [T.StructField("content", T.BinaryType())], lambda source: [[pa.array([source.read()], pa.binary())]])


def _text(lines: Sequence[bytes]) -> pa.Array:
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 become replacement characters, as in Spark's text source
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def texts(files: DataFrame) -> DataFrame:
    """``(file, value)``: every listed file as one text."""
    named = files.select(F.col("path"), F.col("path").alias("file"))
    return _read(named, [T.StructField("value", T.StringType())], lambda source: [[_text([source.read()])]]).drop("path")


def lines(files: DataFrame, piece: int = 8 << 20) -> DataFrame:
    """``(file, value)``: the lines of listed files (ended by CR, LF or both), read a piece at a time."""
    def split(source):
        held = b""
        while data := source.read(piece):
            held += data
            # The last line, and a CR that a LF may follow, wait for the next piece.
            cut = max(held.rfind(b"\n"), held.rfind(b"\r", 0, len(held) - 1)) + 1
            if cut:
                yield [_text(held[:cut].splitlines())]
                held = held[cut:]
        if held:
            yield [_text(held.splitlines())]
    named = files.select(F.col("path"), F.col("path").alias("file"))
    return _read(named, [T.StructField("value", T.StringType())], split).drop("path")
