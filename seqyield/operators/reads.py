"""Read-table operators: join, audit, de-duplication, time axis, derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.functions.expr import (guarded_ratio, micros, pass_flag, qualitative,
                                     seconds_to_interval)

READ_KEYS = ("read_id", "run_id", "channel")


def merge_reads(summary: DataFrame, fastq: DataFrame, keys: Sequence[str] = READ_KEYS) -> DataFrame:
    """Inner equi-join of summary rows and FASTQ header rows; duplicates multiply.

    No strategy hint: AQE picks broadcast or sort-merge from runtime sizes.
    """
    return summary.join(fastq, list(keys), "inner")


def unmatched_reads(summary: DataFrame, fastq: DataFrame, keys: Sequence[str] = READ_KEYS) -> DataFrame:
    """Rows the inner join drops, from both sides: ``(side, *keys)``.

    Both sides are counted by key in one shuffle, combined map-side first, so
    a key with many rows costs one entry per task.  A key with a NULL matches
    nothing, as in the join.
    """
    keys = list(keys)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = summary.select(*keys, one.alias("__s"), none.alias("__f")).unionByName(
        fastq.select(*keys, none.alias("__s"), one.alias("__f")))
    counted = both.groupBy(*keys).agg(F.sum("__s").alias("__s"), F.sum("__f").alias("__f"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.when(no_key | (F.col(other) == 0), F.col(own)).otherwise(0).alias("n"))
                      for side, own, other in (("summary_only", "__s", "__f"), ("fastq_only", "__f", "__s"))])
    found = counted.select(*keys, F.explode(sides).alias("__x")).where("__x.n > 0")
    return found.select(F.col("__x.side").alias("side"), *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__x.n"))).alias("__k")) \
        .drop("__k")


def dedup_reads(df: DataFrame, keys: Sequence[str] = READ_KEYS,
                prefer: Sequence[str] | None = None) -> DataFrame:
    """One row per key.  With ``prefer`` the kept row is the first in that order (deterministic).

    ``min_by`` over the row struct is an aggregate with map-side combine, so a
    key holding a large share of the rows is reduced in every task before
    the shuffle (a window would sort all of its rows in one task).
    """
    if not prefer:
        return df.dropDuplicates(list(keys))
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in prefer])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("__row"))
    return agg.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def elapsed_time(df: DataFrame, time_col: str = "start_time_utc",
                 out_col: str = "start_time_float_by_sample",
                 with_interval: bool = False) -> DataFrame:
    """Seconds since the earliest row of ``df`` (all rows, not per sample).

    The minimum is a scalar subquery (one partial-aggregated value); the rows
    themselves are never ordered or gathered.
    """
    dtype = df.schema[time_col].dataType
    us = micros(time_col, dtype)
    origin = df.agg(F.min(us)).scalar()
    out = df.withColumn(out_col, ((us - origin).cast("double") / 1e6))
    if with_interval:
        out = out.withColumn(out_col.replace("float", "timedelta"), seconds_to_interval(out_col))
    return out


def enrich_reads(df: DataFrame, length_col: str = "sequence_length_template",
                 quality_col: str = "mean_qscore_template",
                 duration_col: str = "template_duration", events_col: str = "num_events",
                 threshold: float = 9.0) -> DataFrame:
    """Add ``pass``, ``qualitative_pass``, ``pore_speed``, ``events_ratio``."""
    return (df.withColumn("pass", pass_flag(quality_col, threshold))
            .withColumn("qualitative_pass", qualitative("pass"))
            .withColumn("pore_speed", guarded_ratio(length_col, duration_col))
            .withColumn("events_ratio", guarded_ratio(events_col, length_col)))


def summary_time_columns(df: DataFrame) -> DataFrame:
    """Rename the run-relative seconds and add them as intervals (P4, P5)."""
    out = df.withColumnsRenamed({"start_time": "start_time_float",
                                 "template_start": "template_time_float"})
    return (out.withColumn("start_time_timedelta", seconds_to_interval("start_time_float"))
            .withColumn("template_start_time_timedelta", seconds_to_interval("template_time_float")))


def check_single_sample(df: DataFrame, sample_col: str = "sample_id", limit: int = 20) -> str:
    """Return the only sample id; raise listing (up to ``limit``) ids otherwise."""
    ids = [r[0] for r in df.select(sample_col).distinct().limit(limit + 1).collect()]
    if len(ids) != 1:
        raise ValueError(f"expected exactly one {sample_col}, found {ids[:limit]}"
                         + (" …" if len(ids) > limit else ""))
    return ids[0]
