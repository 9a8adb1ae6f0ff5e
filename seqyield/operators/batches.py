"""Run-folder inventory and file jobs: manifest, active batch, plan, compaction, checksums.

A run folder holds per-batch files: ``sequencing_summary_<n>.txt``,
``fastq_<n>.fastq`` and a folder ``<n>/`` of ``.fast5`` files.  Listings come
from Spark's file index (``binaryFile`` with the content column pruned); the
manifest is two inner joins on the batch number.  ``tidy`` archives a run into
tables partitioned by batch: it writes the batches its plan finds due and no
others, each as a partition that is replaced as a whole, so a rerun adds what
has arrived since and repeats nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.functions.expr import basename, batch_name, rnumber_from_fast5
from seqyield.session import file_system, materialize
from seqyield.sources import listing
from seqyield.sources.fastq import frame_records, scan_fastq_records
from seqyield.sources.fastq_source import file_system as arrow_file_system
from seqyield.sources.summary import cells_to_rows, summary_cells

# Batch name patterns, anchored at both ends (the reference's are open-ended).
SUMMARY_NAME = r"^sequencing_summary_(\d+)\.txt$"
FASTQ_NAME = r"^fastq_(\d+)\.fastq$"
FAST5_DIR = r"^(\d+)$"


def _numbered(names: DataFrame, name_col: str, pattern: str, out_col: str) -> DataFrame:
    base = basename(F.col(name_col))
    return (names.where(base.rlike(pattern))
            .select(F.col(name_col).alias(out_col),
                    F.regexp_extract(base, pattern, 1).cast("long").alias("number")))


def summary_batches(names: DataFrame, name_col: str = "path") -> DataFrame:
    return _numbered(names, name_col, SUMMARY_NAME, "sequencing_summary_file")


def fastq_batches(names: DataFrame, name_col: str = "path") -> DataFrame:
    return _numbered(names, name_col, FASTQ_NAME, "fastq_file")


def fast5_batches(dirs: DataFrame, name_col: str = "path") -> DataFrame:
    return _numbered(dirs, name_col, FAST5_DIR, "fast5_dir")


def list_paths(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``(path, length, modificationTime)`` of the files under ``folder`` — content never read.

    Tasks list the folders (see :mod:`seqyield.sources.listing`).
    """
    return listing.list_files(spark, folder, glob, recursive)


def scan_batches(spark: SparkSession, summary_dir: str, fastq_dir: str, fast5_dir: str):
    """The three batch listings of a run folder: summary files, FASTQ files, FAST5 folders.

    FAST5 folders are the distinct parents of ``*.fast5`` files one level down.
    """
    return batch_listings(*run_listings(spark, summary_dir, fastq_dir, fast5_dir))


def run_listings(spark: SparkSession, summary_dir: str, fastq_dir: str, fast5_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files of a run folder: summaries, FASTQ, FAST5 (``path``, ``length``, ``modificationTime``)."""
    return (list_paths(spark, summary_dir, "sequencing_summary_*.txt"), list_paths(spark, fastq_dir, "fastq_*.fastq"),
            list_paths(spark, fast5_dir, "*.fast5", recursive=True))


def batch_listings(summaries: DataFrame, fastqs: DataFrame, f5_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The batch listings of listed files."""
    summ, fq = summary_batches(summaries), fastq_batches(fastqs)
    parents = f5_files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("path")).distinct()
    return summ, fq, fast5_batches(parents)


def check_unique_numbers(df: DataFrame, what: str, limit: int = 20) -> None:
    dup = [r["number"] for r in df.groupBy("number").count().where("count > 1").limit(limit).collect()]
    if dup:
        raise ValueError(f"duplicate batch numbers in {what}: {dup}")


def batch_manifest(summary: DataFrame, fastq: DataFrame, fast5: DataFrame, flowcell_id: str | None,
                   rnumber: int | None, md5_fast5: str, md5_fastq: str, check: bool = True) -> DataFrame:
    """One row per batch number present in all three listings, with run constants."""
    if check:
        for df, what in ((summary, "summary"), (fastq, "fastq"), (fast5, "fast5")):
            check_unique_numbers(df, what)
    m = summary.join(fastq, "number", "inner").join(fast5, "number", "inner")
    return m.select("number", "sequencing_summary_file", "fastq_file", "fast5_dir",
                    F.lit(flowcell_id).cast("string").alias("FlowcellID"),
                    F.lit(rnumber).cast("int").alias("rnumber"),
                    F.lit(md5_fast5).alias("md5_fast5"), F.lit(md5_fastq).alias("md5_fastq"))


def drop_active_batch(manifest: DataFrame) -> DataFrame:
    """Drop the highest batch number: it may still be written by the instrument.

    The maximum is a scalar subquery.
    """
    return manifest.where(F.col("number") < manifest.agg(F.max("number")).scalar())


def run_rnumber(fast5_names: DataFrame, name_col: str = "path") -> int | None:
    """Run number from the first FAST5 name (in name order) that carries one."""
    r = (fast5_names.select(rnumber_from_fast5(basename(F.col(name_col))).alias("r"), F.col(name_col))
         .where("r is not null").orderBy(name_col).limit(1).collect())
    return r[0]["r"] if r else None


def archive_names(manifest: DataFrame) -> DataFrame:
    """Target names per batch: ``<number:05>_<flowcell>_<rnumber>`` plus the kind suffix."""
    base = batch_name("number", "FlowcellID", "rnumber")
    return manifest.withColumn("archive_name", base)


def archive_plan(manifest: DataFrame, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """What a tidy run would do, without doing it: ``(number, kind, source, target, action)``.

    ``existing`` lists target names already present (column ``target``);
    those are skipped unless ``overwrite``.
    """
    named = archive_names(manifest)
    plan = named.select("number", F.explode(F.array(
        F.struct(F.lit("fast5").alias("kind"), F.col("fast5_dir").alias("source"),
                 F.concat("archive_name", F.lit(".fast5.tar.gz")).alias("target")),
        F.struct(F.lit("fastq").alias("kind"), F.col("fastq_file").alias("source"),
                 F.concat(F.lit("fastq/"), "archive_name", F.lit(".fastq.gz")).alias("target")),
        F.struct(F.lit("summary").alias("kind"), F.col("sequencing_summary_file").alias("source"),
                 F.concat(F.lit("sequencing_summary/"), "archive_name",
                          F.lit(".sequencing_summary.txt")).alias("target")))).alias("a"))
    plan = plan.select("number", "a.kind", "a.source", "a.target")
    if existing is None:
        return plan.withColumn("action", F.lit("write"))
    ex = existing.select(F.col("target").alias("__t")).distinct().withColumn("__exists", F.lit(True))
    out = plan.join(ex, plan["target"] == ex["__t"], "left")
    action = F.when(F.col("__exists") & F.lit(not overwrite), F.lit("skip")) \
        .when(F.col("__exists"), F.lit("overwrite")).otherwise(F.lit("write"))
    return out.select("number", "kind", "source", "target", action.alias("action"))


#: Bytes of source files an output file of the compaction aims at, and ranges of batches a table is cut into at least.
COMPACT_BYTES, RANGES = 256 << 20, 256
ARCHIVE_KINDS = ("fast5", "fastq", "summary")
RANGE = "batches_per_range"


def batches_per_range(sizes: DataFrame, file_bytes: int = COMPACT_BYTES) -> int:
    """How many batch numbers share a partition: 1, unless the batches (``number``, ``length``) are many and small."""
    r = sizes.agg(F.sum("length").alias("bytes"), (F.max("number") - F.min("number") + 1).alias("span")).head()
    if not r["span"]:
        return 1
    return max(1, min(-(-r["span"] // RANGES), file_bytes * r["span"] // max(r["bytes"], 1)))


def stored_range(spark: SparkSession, out: str) -> int | None:
    """Batch numbers to a partition of a table that is there; None if none is."""
    fs, path = file_system(spark, out)
    if not fs.exists(path):
        return None
    folders = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith((".", "_"))]
    wide = [int(f.split("=")[1]) for f in folders if f.startswith(RANGE + "=")]
    return wide[0] if wide else 1 if folders else None


def write_batches(rows: DataFrame, out: str, numbers: DataFrame | None = None, per_range: int = 1,
                  keys: Sequence[str] = ("number",)) -> None:
    """Write ``rows`` into a table by batch ``number``; batches that are given are replaced, all others stay.

    A batch (all ``keys``, the number last) is a partition.  With ``per_range`` as many numbers share one: a
    range is written as a whole, with the batches that are not in ``numbers``
    (the keys of all that are given) as they were.
    """
    spark = rows.sparkSession
    write = lambda r, *by: r.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(out)
    per_range = stored_range(spark, out) or per_range
    if per_range == 1:
        return write(rows, *keys)
    of = F.floor(F.col("number") / F.lit(per_range)).cast("long")
    rows = rows.withColumn(RANGE, F.lit(per_range)).withColumn("range", of)
    fs, path = file_system(spark, f"{out}/{RANGE}={per_range}")
    if fs.exists(path):
        # As many values as the table has partitions, of which a run touches few.
        given = numbers.select(*keys).distinct()
        there = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if "=" in s.getPath().getName()}
        touched = [r["range"] for r in given.select(of.alias("range")).distinct().toLocalIterator()]
        shared = [x for x in touched if str(x) in there]
        if shared:
            old = spark.read.parquet(out).where(F.col("range").isin(shared))
            old = old.withColumn(RANGE, F.col(RANGE).cast("int")).withColumn("range", F.col("range").cast("long"))
            rows = rows.unionByName(old.join(given, list(keys), "left_anti"), allowMissingColumns=True)
    write(rows.repartition(4 * spark.sparkContext.defaultParallelism, "range"), RANGE, "range")


def fast5_members(spark: SparkSession, folders: str | Sequence[str] | DataFrame, glob: str = "*.fast5",
                  batch_dir: str = FAST5_DIR, content: bool = True) -> DataFrame:
    """``(number, member, length[, md5, content])`` of the files in batch folders.

    ``folders`` are batch folders or a folder of them, or listed files; ``member`` is ``<folder>/<file>``.
    """
    rows = _members(spark, folders, glob, batch_dir)
    return _member_contents(listing.dealt(rows)) if content else rows.drop("path")


def _members(spark: SparkSession, folders: str | Sequence[str] | DataFrame, glob: str, batch_dir: str) -> DataFrame:
    files = folders if isinstance(folders, DataFrame) else listing.list_files(spark, folders, glob, recursive=True)
    parent = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.where(parent.rlike(batch_dir)).select(
        F.regexp_extract(parent, batch_dir, 1).cast("long").alias("number"),
        F.concat_ws("/", parent, basename(F.col("path"))).alias("member"), "length", "path")


def _member_contents(members: DataFrame) -> DataFrame:
    return listing.contents(members).withColumn("md5", F.md5("content")).drop("path")


def compact_batches(spark: SparkSession, folders: str | Sequence[str] | DataFrame, out: str, glob: str = "*.fast5",
                    batch_dir: str = FAST5_DIR, file_bytes: int = COMPACT_BYTES, per_range: int = 1) -> DataFrame:
    """Small-file compaction: every ``<n>/<glob>`` file into a Parquet table by batch.

    Rows ``(number, member, length, md5, content)``.  The list of the files is
    dealt over tasks, a batch over as many as its bytes ask for, and each task
    reads and writes its files.  Batches that are given are replaced, all others
    are left as they are (``per_range``: see :func:`write_batches`).
    """
    members = _members(spark, folders, glob, batch_dir)
    per_range = stored_range(spark, out) or per_range
    parts = members.groupBy(F.col("number").alias("__n")).agg(
        F.greatest(F.ceil(F.sum("length") / F.lit(file_bytes)), F.lit(1)).cast("long").alias("__parts"))
    split = members.join(parts, members["number"] == parts["__n"]).withColumn(
        "__part", F.pmod(F.xxhash64("member"), F.col("__parts")))
    rows = _member_contents(listing.dealt(split, "number", "__part")).drop("__n", "__parts", "__part")
    write_batches(rows, out, members, per_range)
    return spark.read.parquet(out)


def archived(spark: SparkSession, out: str) -> DataFrame | None:
    """``(kind, number)`` of the batches already in the archive tables under ``out``; None if there is none."""
    found = None
    for kind in ARCHIVE_KINDS:
        fs, path = file_system(spark, f"{out}/{kind}")
        if fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path)):
            own = spark.read.parquet(f"{out}/{kind}").select(F.lit(kind).alias("kind"), F.col("number").cast("long").alias("number")).distinct()
            found = own if found is None else found.unionByName(own)
    return found


def tidy(spark: SparkSession, summary_dir: str, fastq_dir: str, fast5_dir: str, out: str, flowcell_id: str,
         overwrite: bool = False, keep_active: bool = False, fastq_options: dict | None = None) -> DataFrame:
    """Archive a run: inventory, active batch dropped, plan, and the due batches written.

    Under ``out`` come the tables ``fast5``, ``fastq``, ``summary`` and
    ``checksums`` by batch.  Returns the plan that was carried
    out, ``(number, kind, source, target, action)``; with ``overwrite`` batches
    that exist are written again, otherwise they are skipped.  The folder is listed once and
    the due files are rows of that listing: no path passes through the driver.
    """
    found = dict(zip(("summary", "fastq", "fast5"), run_listings(spark, summary_dir, fastq_dir, fast5_dir)))
    summ, fq, f5 = batch_listings(*found.values())
    manifest = batch_manifest(summ, fq, f5, flowcell_id, run_rnumber(found["fast5"]), "checksum.fast5.md5", "checksum.fastq.md5")
    if not keep_active:
        manifest = drop_active_batch(manifest)
    plan, done = archive_plan(manifest), archived(spark, out)
    if done is not None:
        done = done.withColumnsRenamed({"kind": "__kind", "number": "__number"}).withColumn("__done", F.lit(True))
        plan = plan.join(done, (plan["kind"] == F.col("__kind")) & (plan["number"] == F.col("__number")), "left")
        plan = plan.withColumn("action", F.when(F.col("__done"), F.lit("overwrite" if overwrite else "skip")).otherwise("write"))
    plan = materialize(plan.select("number", "kind", "source", "target", "action"), "plan")
    todo = plan.where("action <> 'skip'").select("kind", "number", "source")
    kinds = {r["kind"] for r in todo.select("kind").distinct().collect()}

    def due(kind: str) -> DataFrame:
        """The files of the batches to be written, with their number."""
        own = todo.where(F.col("kind") == kind).select("number", F.col("source").alias("__source"))
        at = F.regexp_extract("path", r"^(.*)/[^/]+$", 1) if kind == "fast5" else F.col("path")
        return found[kind].withColumn("__at", at).join(own, F.col("__at") == F.col("__source")).select("path", "length", "number")
    sums = []
    for kind in (k for k in ARCHIVE_KINDS if k in kinds):
        files, target = materialize(due(kind), f"due-{kind}"), f"{out}/{kind}"
        per_range = batches_per_range(files)
        if kind == "fast5":
            t = compact_batches(spark, files, target, per_range=per_range)
            numbers = files.select(F.col("number").alias("__n")).distinct()
            sums.append((files, t.join(numbers, t["number"] == F.col("__n"), "left_semi").select(
                F.lit(kind).alias("kind"), F.col("number").cast("long").alias("number"), basename(F.col("member")).alias("file"), "md5")))
        elif kind == "fastq":
            records = (scan_fastq_records(spark, [r["path"] for r in files.select("path").toLocalIterator()], "*.fastq", **fastq_options)
                       if fastq_options else frame_records(listing.texts(listing.dealt(files))))
            fastq_table(records, target, files, per_range)
            sums.append((files, streamed_checksums(files.withColumn("kind", F.lit(kind)), "kind", "number")))
        else:
            cells = summary_cells(listing.lines(listing.dealt(files)).where("value <> ''"))
            relocate_summary(cells_to_rows(cells, carried=["file"]), target, files, per_range)
    if sums:
        both = reduce(DataFrame.unionByName, (made for _, made in sums))
        given = plan.where("action <> 'skip' and kind <> 'summary'").select("kind", "number")
        # A line a file, however large the file is.
        size = reduce(DataFrame.unionByName, (files for files, _ in sums)).withColumn("length", F.lit(100))
        write_batches(both, f"{out}/checksums", given, batches_per_range(size), ("kind", "number"))
    return plan


def checksums(files: DataFrame, kind: str, *carried: str) -> DataFrame:
    """``(kind, *carried, file, md5)`` for ``binaryFile`` rows (content held per row: files < 2 GB)."""
    return files.select(F.lit(kind).alias("kind"), *carried, basename(F.col("path")).alias("file"),
                        F.md5("content").alias("md5"))


#: Bytes of a file that are hashed at a time.
PIECE = 8 << 20


def streamed_checksums(files: DataFrame, *carried: str) -> DataFrame:
    """``(*carried, file, md5)`` for listed files (column ``path``) of any size.

    A task opens its files itself and hashes a piece at a time, so no content is
    ever a value of a row; ``carried`` columns of the listing are kept.
    """
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    listed = files.select(*carried, "path").repartition(tasks, F.col("path"))
    names = [*carried, "file", "md5"]
    schema = T.StructType([*[listed.schema[c] for c in carried], T.StructField("file", T.StringType()),
                           T.StructField("md5", T.StringType())])

    def hashed(batches):
        for batch in batches:
            sums = []
            for path in batch.column(len(carried)).to_pylist():
                fs, place = arrow_file_system(path)
                total = hashlib.md5()
                with fs.open_input_file(place) as source:
                    while piece := source.read(PIECE):
                        total.update(piece)
                sums.append(total.hexdigest())
            bases = [p.rsplit("/", 1)[-1] for p in batch.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases, pa.string()), pa.array(sums, pa.string())],
                                             names=names)
    return listed.mapInArrow(hashed, schema)


def append_checksums(sums: DataFrame, out: str) -> None:
    """Append to the checksum table, partitioned by kind (reruns add rows, like the text file)."""
    sums.write.mode("append").partitionBy("kind").parquet(out)


def checksum_lines(sums: DataFrame) -> DataFrame:
    """The ``md5sum`` text form: ``<md5>  <file>``."""
    return sums.select("kind", F.concat_ws("  ", "md5", "file").alias("line"))


def _with_number(rows: DataFrame, pattern: str) -> DataFrame:
    number = F.regexp_extract(basename(F.col("file")), pattern, 1)
    return rows.withColumn("number", F.when(number != "", number.cast("long")))


def fastq_table(records: DataFrame, out: str, numbers: DataFrame | None = None, per_range: int = 1) -> DataFrame:
    """Compressed FASTQ record table by batch number (from ``fastq_<n>`` names); given batches are replaced."""
    write_batches(_with_number(records, r"^fastq_(\d+)\.fastq(?:\.gz)?$"), out, numbers, per_range)
    return records.sparkSession.read.parquet(out)


def relocate_summary(summary: DataFrame, out: str, numbers: DataFrame | None = None, per_range: int = 1) -> DataFrame:
    """Summary rows as a Parquet table by batch number (from the ``file`` column,
    see ``scan_summary(with_file=True)``); given batches are replaced."""
    write_batches(_with_number(summary, r"sequencing_summary_(\d+)"), out, numbers, per_range)
    return summary.sparkSession.read.parquet(out)


def write_manifest(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The manifest as JSON lines in number order, file by file (one object per batch)."""
    manifest.orderBy("number").write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = ("number long, sequencing_summary_file string, fastq_file string, fast5_dir string, "
              "FlowcellID string, rnumber int, md5_fast5 string, md5_fastq string")
    return spark.read.schema(schema).json(path)
