"""Running counts / yields and the cumulative curves drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.operators.prefix import running_totals
from seqyield.session import materialize

ORDER = ("start_time_float_by_sample", "read_id")


def running_columns(df: DataFrame, length_col: str = "sequence_length_template",
                    pass_col: str = "pass", channel_col: str = "channel",
                    order: tuple[str, ...] = ORDER, include_channel: bool = True) -> DataFrame:
    """Add ``read_count``, ``yield``, ``quality_yield``, ``quality_count`` and ``channel_yield``.

    Time order with the read id as tie-breaker.  The per-pass-class running
    values need no separate pass: for a row of class c they equal the global
    running sum of ``length * [class = c]`` — so four of the five columns come
    from one pass, and ``channel_yield`` from a second one
    partitioned by channel (range-split, so a hot channel spans many tasks).
    """
    p = F.col(pass_col)
    length = F.col(length_col).cast("long")
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    out = running_totals(df, list(order), {
        "read_count": one,
        "yield": length,
        "__y_pass": F.when(p, length).otherwise(zero),
        "__y_fail": F.when(p, zero).otherwise(length),
        "__c_pass": F.when(p, one).otherwise(zero),
        "__c_fail": F.when(p, zero).otherwise(one),
    })
    out = (out.withColumn("quality_yield", F.when(p, F.col("__y_pass")).otherwise(F.col("__y_fail")))
           .withColumn("quality_count", F.when(p, F.col("__c_pass")).otherwise(F.col("__c_fail")))
           .drop("__y_pass", "__y_fail", "__c_pass", "__c_fail"))
    if include_channel:
        out = running_totals(out, list(order), {"channel_yield": length}, by=[channel_col])
    return out


def running_count(df: DataFrame, by: str | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    name = "read_count" if by is None else "quality_count"
    return running_totals(df, list(order), {name: F.lit(1).cast("long")}, by=[by] if by else None)


def running_yield(df: DataFrame, length_col: str = "sequence_length_template", by: str | None = None,
                  order: tuple[str, ...] = ORDER, name: str | None = None) -> DataFrame:
    name = name or ("yield" if by is None else f"{by}_yield")
    return running_totals(df, list(order), {name: F.col(length_col).cast("long")},
                          by=[by] if by else None)


def _curve(df: DataFrame, measure, time_col: str, bin_seconds: float, series: str | None,
           value_name: str) -> DataFrame:
    """Sums per time bin, cumulated per series; ``series`` adds a curve per value beside "All"."""
    t_bin = F.floor(F.col(time_col) / F.lit(float(bin_seconds))).cast("long")
    keys = [F.col(series).alias("series")] if series else [F.lit("All").alias("series")]
    per_bin = df.groupBy(*keys, t_bin.alias("time_bin")).agg(measure.alias("__v"))
    if series:
        per_bin = materialize(per_bin, "curve")
        per_bin = per_bin.unionByName(per_bin.groupBy("time_bin").agg(F.sum("__v").alias("__v"))
                                      .withColumn("series", F.lit("All")))
    cum = running_totals(per_bin, ["time_bin"], {value_name: "__v"}, by=["series"])
    return cum.select("series", "time_bin",
                      (F.col("time_bin") * F.lit(float(bin_seconds))).alias("time_s"),
                      F.col("__v").alias(f"{value_name}_in_bin"), value_name)


def yield_curve(df: DataFrame, length_col: str = "sequence_length_template",
                time_col: str = "start_time_float_by_sample", bin_seconds: float = 60.0,
                by_quality: bool = False, quality_col: str = "qualitative_pass") -> DataFrame:
    """Cumulative bases at the end of each time bin; ``by_quality`` adds Passed/Failed series."""
    return _curve(df, F.sum(F.col(length_col).cast("long")), time_col, bin_seconds,
                  quality_col if by_quality else None, "yield")


def reads_curve(df: DataFrame, time_col: str = "start_time_float_by_sample",
                bin_seconds: float = 60.0, by_quality: bool = False,
                quality_col: str = "qualitative_pass") -> DataFrame:
    """Cumulative read count at the end of each time bin."""
    return _curve(df, F.count(F.lit(1)), time_col, bin_seconds, quality_col if by_quality else None, "read_count")
