"""Sequencing-summary TSV scan: columns by header name, broken cells counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.functions.expr import nan_to_null
from seqyield.operators.reads import summary_time_columns

SUMMARY_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("read_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("num_events", T.LongType()),
    T.StructField("template_start", T.DoubleType()),
    T.StructField("num_events_template", T.LongType()),
    T.StructField("template_duration", T.DoubleType()),
    T.StructField("sequence_length_template", T.LongType()),
    T.StructField("mean_qscore_template", T.DoubleType()),
    T.StructField("strand_score_template", T.DoubleType()),
])

SUMMARY_GLOB = "*sequencing_summary*.txt"


def split_dirs(dirs: str | Sequence[str]) -> list[str]:
    """Comma-separated directory list (or a list) → paths."""
    if isinstance(dirs, str):
        return [d for d in dirs.split(",") if d]
    return list(dirs)


def _is_header(cells: Column, schema: T.StructType) -> Column:
    """A header line holds the names of the columns, whatever their order."""
    return F.size(F.array_intersect(cells, F.array(*[F.lit(n) for n in schema.names]))) * 2 > len(schema.names)


def summary_cells(lines: DataFrame, schema: T.StructType = SUMMARY_SCHEMA) -> DataFrame:
    """Lines ``(file, value)`` of summary files as ``(file, cells)``: the cells of each row by schema order.

    Every file's own header says where its columns are; the rows meet it by
    file name.  A file that lacks a column makes the job fail with an error
    naming the file and the column.
    """
    split = lines.select("file", F.split("value", "\t").alias("cells"))
    header = _is_header(F.col("cells"), schema)
    headers = split.where(header).groupBy(F.col("file").alias("__file")).agg(F.first("cells").alias("__names"))
    missing = F.array_except(F.array(*[F.lit(n) for n in schema.names]), F.col("__names"))
    places = headers.select("__file", F.when(F.size(missing) > 0, F.raise_error(F.concat(
        F.lit("summary file "), F.col("__file"), F.lit(" has no column "), F.array_join(missing, ", ")))).otherwise(
        F.array(*[F.array_position("__names", n).cast("int") - 1 for n in schema.names])).alias("__at"))
    rows = split.where(~header).join(places, F.col("file") == F.col("__file"), "left")
    at = F.coalesce(F.col("__at"), F.raise_error(F.concat(F.lit("summary file without a header: "), F.col("file"))))
    return rows.select("file", F.transform(at, lambda i: F.get("cells", i)).alias("cells"))


def whole_file_cells(files: DataFrame, schema: T.StructType = SUMMARY_SCHEMA, carried: Sequence[str] = ()) -> DataFrame:
    """:func:`summary_cells` of whole files ``(*carried, file, value)``, one row a file, as a stream gives them.

    A stream cannot join a file with itself; here every row holds its file's
    header, so no line depends on which task reads it.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x != "")
    names = F.split(F.get("__lines", F.lit(0)), "\t")
    missing = F.array_except(F.array(*[F.lit(n) for n in schema.names]), "__names")
    places = F.when(F.size(missing) > 0, F.raise_error(F.concat(
        F.lit("summary file "), F.col("file"), F.lit(" has no column "), F.array_join(missing, ", ")))).otherwise(
        F.array(*[F.array_position("__names", n).cast("int") - 1 for n in schema.names]))
    rows = (files.withColumn("__lines", lines).where(F.size("__lines") > 0).withColumn("__names", names)
            .withColumn("__at", places)
            .select(*carried, "file", "__at", F.explode(F.slice("__lines", F.lit(2), F.size("__lines"))).alias("__line")))
    rows = rows.withColumn("__cells", F.split("__line", "\t"))
    return rows.select(*carried, "file", F.transform("__at", lambda i: F.get("__cells", i)).alias("cells"))


def _value(cell: Column, kind: T.DataType) -> Column:
    """A cell's value: empty cells and ``nan`` are missing, and so is what does not parse."""
    if isinstance(kind, T.StringType):
        return F.nullif(cell, F.lit(""))
    parsed = F.when(F.lower(F.trim(cell)) == "nan", F.lit(None)).otherwise(cell).try_cast(kind)
    return nan_to_null(parsed).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else parsed


def _broken(cell: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit(False)
    blank = cell.isNull() | (F.trim(cell) == "") | (F.lower(F.trim(cell)) == "nan")
    return ~blank & cell.try_cast(kind).isNull()


def read_lines(spark: SparkSession, dirs: str | Sequence[str], glob: str = SUMMARY_GLOB,
               recursive: bool = False) -> DataFrame:
    r = spark.read.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.text(split_dirs(dirs)).select(F.col("_metadata.file_path").alias("file"), "value").where("value <> ''")


def cells_to_rows(cells: DataFrame, schema: T.StructType = SUMMARY_SCHEMA, carried: Sequence[str] = ()) -> DataFrame:
    return cells.select(*carried, *[_value(F.get("cells", F.lit(i)), f.dataType).alias(f.name)
                                    for i, f in enumerate(schema.fields)])


def scan_summary(spark: SparkSession, dirs: str | Sequence[str], glob: str = SUMMARY_GLOB,
                 schema: T.StructType = SUMMARY_SCHEMA, with_time_columns: bool = True,
                 with_file: bool = False, recursive: bool = False) -> DataFrame:
    """All summary files of the given folders (not recursive) as one DataFrame.

    Columns are taken by name from each file's header; ``nan`` and empty cells
    are NULL, and so are cells that do not parse (see ``broken_cells``).  With
    ``with_time_columns`` the two time columns are renamed and added as intervals.
    """
    cells = summary_cells(read_lines(spark, dirs, glob, recursive), schema)
    df = cells_to_rows(cells, schema, ["file"] if with_file else [])
    return summary_time_columns(df) if with_time_columns else df


def broken_cells(spark: SparkSession, dirs: str | Sequence[str], glob: str = SUMMARY_GLOB,
                 schema: T.StructType = SUMMARY_SCHEMA, recursive: bool = False) -> DataFrame:
    """``(file, rows, broken_rows, broken_cells)``: what does not parse, per file."""
    cells = summary_cells(read_lines(spark, dirs, glob, recursive), schema)
    flags = [_broken(F.get("cells", F.lit(i)), f.dataType).cast("long") for i, f in enumerate(schema.fields)]
    counted = cells.select("file", sum(flags[1:], flags[0]).alias("broken"))
    return counted.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("broken") > 0).alias("broken_rows"),
                                       F.sum("broken").alias("broken_cells"))
