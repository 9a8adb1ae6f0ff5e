"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqyield.session import ensure_checkpoint_dir, scratch_path

#: White space of the contracts: blank and the five control characters 0x09-0x0D.
WHITE = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text as a string, null counting as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def id_text(id_col: str) -> Column:
    """The document id as text; null counts as empty."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """Fold 0 .. folds-1 of a document: CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(id_text(id_col).cast("binary")) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, prefixed until no column of ``df`` has it (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def free_names(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [free_name(df, n) for n in names]


def parallelism(spark: SparkSession) -> int:
    """Tasks of a shuffle in this session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def most_frequent(counted: DataFrame, count_col: str, size: int) -> DataFrame:
    """The rows of ``counted`` with the largest counts: at most ``size``, and all down to some count.

    The bound is found from a histogram of the counts on a logarithmic scale
    (some hundred rows), so no task sends its own top rows to the driver.
    """
    step = F.floor(F.log2(F.col(count_col).cast("double")) * 16).cast("int")
    taken, lowest = 0, None
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        taken += r["n"]
        if taken > size:
            break
        lowest = r["step"]
    return counted.where(F.lit(False) if lowest is None else step >= lowest)


def hash_sample(df: DataFrame, key: Column, rows: int, size: int) -> DataFrame:
    """About nine tenths of ``size`` rows of ``df``, chosen by the hash of ``key``; all rows if there are fewer.

    Every task decides on its own rows; ``size`` is only passed with odds nobody will see.
    """
    if rows <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 32)) < F.lit(int((1 << 32) * 0.9 * size / rows)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null equal to null; the result has ``left``'s keys once."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Limit the Arrow batches of the jobs that run inside to ``size`` bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared checkpoint folder, with the writer's options; the frame read back and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables this job wrote itself and that no returned frame reads."""
    root = ensure_checkpoint_dir(spark)
    for path in paths:
        if not path.startswith(root.rstrip("/") + "/"):
            raise ValueError(f"not a scratch table: {path}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
