"""Approximate quantiles from stored, mergeable sketches of batches.

Every batch of reads leaves one row per column: a KLL sketch and the moments
that merge exactly (count, mean, sum of squared deviations, minimum, maximum).
Rows of any set of batches merge into quantiles, a description or the trim
bounds without reading a read again; a new batch adds its rows, a replaced one
replaces them.  A sketch has a size that depends on ``k`` alone, and a rank it
gives is off by :func:`rank_error` of the rows at most (with 99 % of draws); a
batch of fewer than ``k`` rows is kept whole.

This is the opt-in beside the exact quantiles, which stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqyield.functions.expr import nan_to_null
from seqyield.operators.stats import DESCRIBE_PERCENTILES
from seqyield.operators.trim import LENGTH_Q, RATIO_MAX, TIME_Q, TrimBounds, _trunc

#: Size parameter of the sketches: the trim asks for the last thousandth, so the error must stay well below.
SKETCH_K = 8192


def rank_error(k: int = SKETCH_K) -> float:
    """The share of all rows by which a KLL sketch of size ``k`` may miss a rank (single-sided, 99 %)."""
    return 2.296 / k ** 0.9021


def batch_sketches(reads: DataFrame, batch: str, columns: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """``(batch, column, n, mean, m2, low, high, sketch)``: a row for each batch and column, from one aggregation."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    stacked = reads.selectExpr(f"`{batch}` as batch", f"stack({len(columns)}, {pairs}) as (column, v)")
    v = nan_to_null(F.col("v"))
    return stacked.select("batch", "column", v.alias("v")).where("v is not null").groupBy("batch", "column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ("column",), k: int = SKETCH_K) -> DataFrame:
    """One row for each ``by`` of the batches given; the moments merge exactly."""
    by = list(by)
    # Means count from the least value: squares of far-off numbers would swallow the deviations.
    origin = sketches.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.min("low").alias("__origin"))
    near = sketches.join(origin, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    offset = F.col("mean") - F.col("__origin")
    grouped = near.groupBy(*by, "__origin").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * offset) / F.sum("n")).alias("__mean"), F.sum("m2").alias("__within"),
        F.sum(F.col("n") * offset * offset).alias("__square"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    between = F.col("__square") - F.col("n") * F.col("__mean") * F.col("__mean")
    return grouped.select(*by, "n", (F.col("__origin") + F.col("__mean")).alias("mean"), "low", "high", "sketch",
                          (F.col("__within") + F.greatest(between, F.lit(0.0))).alias("m2"))


def quantile(p: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(p)))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",)) -> DataFrame:
    """``(*by, p, q)``: quantiles of the batches given."""
    found = F.array(*[F.struct(F.lit(float(p)).alias("p"), quantile(p).alias("q")) for p in probs])
    return merged(sketches, by).select(*by, F.explode(found).alias("x")).select(*by, "x.*")


def sketched_trim_bounds(sketches: DataFrame, length_col: str = "sequence_length_template",
                         time_col: str = "start_time_float", length_q: float = LENGTH_Q,
                         time_q: tuple[float, float] = TIME_Q, ratio_max: float = RATIO_MAX) -> TrimBounds:
    """The trim bounds of the batches given; ``time_col`` may count from any origin, as the run's first read does not
    move within a batch's sketch."""
    rows = {r["column"]: r for r in merged(sketches.where(F.col("column").isin(length_col, time_col))).select(
        "column", "low", quantile(length_q).alias("length"), quantile(time_q[0]).alias("first"),
        quantile(time_q[1]).alias("last")).collect()}
    length, time = rows.get(length_col), rows.get(time_col)
    since = (lambda v: None if time is None else _trunc(v - time["low"]))
    return TrimBounds(None if length is None else _trunc(length["length"]), int(ratio_max),
                      since(time and time["first"]), since(time and time["last"]))


def sketched_describe(sketches: DataFrame, percentiles: Sequence[float] = DESCRIBE_PERCENTILES,
                      by: Sequence[str] = ("column",)) -> DataFrame:
    """``(*by, stat, value)``: count, mean, std, min and max exactly, percentiles from the sketches."""
    m = merged(sketches, by).withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))
    rows = [("count", F.col("n").cast("double")), ("mean", F.col("mean")), ("std", F.col("std")), ("min", F.col("low")),
            *[(f"{p * 100:g}%", quantile(p)) for p in percentiles], ("max", F.col("high"))]
    stats = F.explode(F.array(*[F.struct(F.lit(name).alias("stat"), value.alias("value")) for name, value in rows]))
    return m.select(*by, stats.alias("s")).select(*by, "s.*")
