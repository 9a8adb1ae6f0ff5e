"""Quantile trimming of outliers and the audit of what it removes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.operators.quantiles import exact_quantiles, quantile_values

# Fixed values of the reference's trim.
LENGTH_Q = 0.999
TIME_Q = (0.001, 0.999)
RATIO_MAX = 20


@dataclass(frozen=True)
class TrimBounds:
    """Bounds after ``%d`` formatting, i.e. truncated toward zero; all strict."""
    length_max: int
    ratio_max: int
    time_min: int
    time_max: int


def _trunc(x: float | None) -> int | None:
    return None if x is None or math.isnan(x) else int(x)


def trim_bounds(df: DataFrame, length_col: str = "sequence_length_template",
                time_col: str = "start_time_float_by_sample", length_q: float = LENGTH_Q,
                time_q: tuple[float, float] = TIME_Q, ratio_max: float = RATIO_MAX) -> TrimBounds:
    # Both columns in one distributed pass: stacked as (column, value) groups.
    stacked = df.select(F.expr(f"stack(2, 'len', cast({length_col} as double), "
                               f"'time', cast({time_col} as double)) as (__k, __v)"))
    probs = sorted({length_q, *time_q})
    rows = exact_quantiles(stacked, "__v", probs, by=["__k"]).collect()
    got = {(r["__k"], r["p"]): r["q"] for r in rows}
    return TrimBounds(_trunc(got.get(("len", length_q))), int(ratio_max),
                      _trunc(got.get(("time", time_q[0]))), _trunc(got.get(("time", time_q[1]))))


def _conditions(b: TrimBounds, length_col: str, ratio_col: str, time_col: str):
    def lit_or_null(x):
        return F.lit(x).cast("long") if x is not None else F.lit(None).cast("long")
    length_ok = F.col(length_col) < lit_or_null(b.length_max)
    ratio_ok = F.col(ratio_col) < F.lit(b.ratio_max)
    time_ok = (F.col(time_col) > lit_or_null(b.time_min)) & (F.col(time_col) < lit_or_null(b.time_max))
    return length_ok, ratio_ok, time_ok


def trim_reads(df: DataFrame, length_col: str = "sequence_length_template",
               ratio_col: str = "events_ratio", time_col: str = "start_time_float_by_sample",
               bounds: TrimBounds | None = None) -> DataFrame:
    """Keep reads with length, events ratio and time strictly inside the bounds.

    The bounds are three exact quantiles computed in one distributed pass each
    and applied as literals; a missing ratio drops the row.
    """
    b = bounds or trim_bounds(df, length_col, time_col)
    length_ok, ratio_ok, time_ok = _conditions(b, length_col, ratio_col, time_col)
    return df.where(length_ok & ratio_ok & time_ok)


def quantile_trim(df: DataFrame, col: str, p: float) -> DataFrame:
    """Keep rows with ``col < int(quantile(col, p))`` (strict, truncated bound)."""
    (q,) = quantile_values(df, col, [p])
    bound = _trunc(q)
    if bound is None:
        return df.where(F.lit(False))
    return df.where(F.col(col) < F.lit(bound))


def trim_exclusions(df: DataFrame, length_col: str = "sequence_length_template",
                    ratio_col: str = "events_ratio", time_col: str = "start_time_float_by_sample",
                    mode: str = "correct", bounds: TrimBounds | None = None) -> DataFrame:
    """Counts for the three-set diagram of the trim.

    ``correct``: one row per combination of exclusion flags
    ``(time_excluded, ratio_excluded, length_excluded, reads)``; the all-false
    row is the kept set.  One pass, one small group-by.

    ``compat``: ``(region, reads)`` of the seven regions the reference draws
    (three digits for time, events ratio and length).  There, a region outside
    the time set is always empty, two regions count the kept reads, and one the
    reads inside time and ratio that are longer than the bound.
    """
    b = bounds or trim_bounds(df, length_col, time_col)
    length_ok, ratio_ok, time_ok = _conditions(b, length_col, ratio_col, time_col)
    if mode == "correct":
        flags = df.select(
            (~F.coalesce(time_ok, F.lit(False))).alias("time_excluded"),
            (~F.coalesce(ratio_ok, F.lit(False))).alias("ratio_excluded"),
            (~F.coalesce(length_ok, F.lit(False))).alias("length_excluded"))
        return flags.groupBy("time_excluded", "ratio_excluded", "length_excluded") \
            .agg(F.count(F.lit(1)).alias("reads"))
    if mode != "compat":
        raise ValueError("mode must be 'correct' or 'compat'")
    # Only two kinds of region can be other than empty: the kept reads, and reads that the
    # length bound alone removes.
    long_only = time_ok & ratio_ok & (F.col(length_col) > F.lit(b.length_max))
    counts = df.agg(F.count_if(F.coalesce(length_ok & ratio_ok & time_ok, F.lit(False))).alias("kept"),
                    F.count_if(F.coalesce(long_only, F.lit(False))).alias("long_only"))
    return counts.selectExpr("stack(7, '100', long_only, '010', 0L, '110', 0L, '001', 0L, '101', kept, '011', 0L, "
                             "'111', kept) as (region, reads)")


def trim_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a trim as a two-row table ``(stage, reads)``."""
    b = before.agg(F.count(F.lit(1)).alias("reads")).select(F.lit("before").alias("stage"), "reads")
    a = after.agg(F.count(F.lit(1)).alias("reads")).select(F.lit("after").alias("stage"), "reads")
    return b.unionByName(a)


def observed_trim(df: DataFrame, bounds: TrimBounds | None = None, **cols):
    """Trim with row counts before/after collected as metrics of the job that uses the result.

    Returns ``(trimmed, before, after)``; read ``before.get`` / ``after.get``
    once an action on ``trimmed`` has run — no extra counting jobs.
    """
    from pyspark.sql import Observation

    before, after = Observation("trim_before"), Observation("trim_after")
    src = df.observe(before, F.count(F.lit(1)).alias("reads"))
    out = trim_reads(src, bounds=bounds or trim_bounds(df, **{k: v for k, v in cols.items()
                                                              if k in ("length_col", "time_col")}), **cols)
    return out.observe(after, F.count(F.lit(1)).alias("reads")), before, after
