"""Per-channel yield and its place on the flow-cell map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.operators.quantiles import exact_quantiles

# Fixed layout of the flow cell: 12 blocks of 25 rows × 10 columns = 3000 channels.
BLOCKS, ROWS, BLOCK_WIDTH = 12, 25, 10
CHANNELS = BLOCKS * ROWS * BLOCK_WIDTH
ROBUST_PERCENTILES = (0.02, 0.98)


def channel_yield(df: DataFrame, channel_col: str = "channel",
                  length_col: str = "sequence_length_template") -> DataFrame:
    """Total bases per channel (the maximum of the running channel yield, taken directly)."""
    return df.groupBy(F.col(channel_col).alias("channel")).agg(
        F.sum(F.col(length_col).cast("long")).alias("channel_yield"))


def check_channels(yields: DataFrame, limit: int = 20) -> None:
    bad = [r[0] for r in yields.where((F.col("channel") < 1) | (F.col("channel") > CHANNELS))
           .select("channel").limit(limit).collect()]
    if bad:
        raise ValueError(f"channels outside 1..{CHANNELS}: {bad}")


def grid_cell(channel) -> tuple:
    """(row, col) of a channel; channel ``c*250 + 10*l + w + 1`` sits at row l, column c*10 + w."""
    k = channel - 1
    per_block = ROWS * BLOCK_WIDTH
    row = F.floor((k % per_block) / BLOCK_WIDTH).cast("int")
    col = (F.floor(k / per_block) * BLOCK_WIDTH + k % BLOCK_WIDTH).cast("int")
    return row, col


def flowcell_grid(df: DataFrame, channel_col: str = "channel",
                  length_col: str = "sequence_length_template", check: bool = True) -> DataFrame:
    """All 3000 cells ``(row, col, channel, bases)``; channels without reads have 0.

    The grid is generated (``range``); the yields are one row per channel,
    at most 3000 once ``check_channels`` has passed, so that side is broadcast.
    """
    y = channel_yield(df, channel_col, length_col)
    if check:
        check_channels(y)
    spark = df.sparkSession
    grid = spark.range(1, CHANNELS + 1).select(F.col("id").cast("int").alias("channel"))
    row, col = grid_cell(F.col("channel"))
    grid = grid.select(row.alias("row"), col.alias("col"), "channel")
    bounded = F.broadcast(y) if check else y
    return (grid.join(bounded, "channel", "left")
            .select("row", "col", "channel",
                    F.coalesce(F.col("channel_yield"), F.lit(0).cast("long")).alias("bases")))


def grid_limits(grid: DataFrame, percentiles=ROBUST_PERCENTILES) -> DataFrame:
    """Robust colour limits: the 2nd and 98th percentile of the 3000 cell values."""
    q = exact_quantiles(grid, "bases", percentiles)
    return q.select(F.when(F.col("p") == percentiles[0], "vmin").otherwise("vmax").alias("limit"),
                    F.col("q").alias("bases"))
