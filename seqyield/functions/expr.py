"""Scalar column expressions (all JVM-side built-ins, no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference for identical results.
PASS_QSCORE = 9.0            # pass means mean q-score strictly above this
PASSED, FAILED = "Passed", "Failed"
# Decimal size prefixes used by the human-readable base counts, smallest first.
SIZE_PREFIXES = ["K", "M", "G", "T", "P", "E", "Z", "Y"]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN → NULL so comparisons and aggregates skip missing values like pandas."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def nans_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float/double column of ``df``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def micros(c: str | Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ, independent of session zone."""
    c = col_(c)
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c)
    return F.unix_micros(c)


def seconds_to_interval(c: str | Column) -> Column:
    """Float seconds → DAY TO SECOND interval (microsecond precision)."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                              col_(c).cast("decimal(18,6)"))


def hhmm(c: str | Column) -> Column:
    """Seconds → ``HH:MM`` (hours may exceed 99); exactly zero → ``0``."""
    x = col_(c)
    hours = F.floor(x / 3600).cast("long")
    minutes = F.floor((x % 3600) / 60).cast("long")
    return F.when(x == 0, F.lit("0")).otherwise(F.format_string("%02d:%02d", hours, minutes))


def human_bases(c: str | Column) -> Column:
    """Base count → decimal human text: ``999`` → ``999b``, ``1500`` → ``1.5 Kb``.

    Two decimals, trailing zeros dropped.  Rounding is half-up on the exact
    integer ratio (identical in every engine); the reference formats the binary
    double instead, which can differ on exact ``…5`` ties.
    """
    n = col_(c).cast("long")
    nd = n.cast("decimal(38,0)")
    expr = F.concat(n.cast("string"), F.lit("b"))
    for i, prefix in enumerate(SIZE_PREFIXES[:6]):  # long range ends in E
        d = F.lit(1000 ** (i + 1)).cast("long")
        dd = F.lit(1000 ** (i + 1)).cast("decimal(38,0)")
        half = F.lit(1000 ** (i + 1) // 2).cast("decimal(38,0)")
        hundredths = F.floor((nd * 100 + half) / dd).cast("long")
        whole = F.floor(hundredths / 100).cast("long")
        frac = (hundredths % 100).cast("long")
        text = F.when(frac == 0, whole.cast("string")).when(
            frac % 10 == 0, F.format_string("%d.%d", whole, F.floor(frac / 10).cast("long"))
        ).otherwise(F.format_string("%d.%02d", whole, frac))
        expr = F.when(n >= d, F.concat(text, F.lit(f" {prefix}b"))).otherwise(expr)
    return expr


def zfill(c: str | Column, width: int) -> Column:
    """Python ``str.zfill``: left-pad with zeros, never truncate (``lpad`` truncates)."""
    s = col_(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def batch_name(number: str | Column, flowcell: str | Column | None,
               rnumber: str | Column | None) -> Column:
    """``<number zero-filled to 5>_<flowcell>_<rnumber>``; empty parts are skipped."""
    parts = [zfill(number, 5)]
    for p in (flowcell, rnumber):
        if p is not None:
            pc = col_(p).cast("string")
            parts.append(F.when(F.length(pc) > 0, pc))
    return F.concat_ws("_", *parts)


def pass_flag(q: str | Column, threshold: float = PASS_QSCORE) -> Column:
    """Strictly above the threshold; missing quality counts as a fail."""
    return F.coalesce(nan_to_null(q) > F.lit(threshold), F.lit(False))


def qualitative(pass_col: str | Column) -> Column:
    return F.when(col_(pass_col), F.lit(PASSED)).otherwise(F.lit(FAILED))


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or missing (ANSI division would raise)."""
    d = col_(den).cast("double")
    return F.try_divide(col_(num).cast("double"), F.nullif(d, F.lit(0.0)))


def rnumber_from_fast5(name: str | Column) -> Column:
    """Second of the seven ``_``-separated parts counted from the right, as int."""
    return F.regexp_extract(col_(name), r"_([^_]+)_[^_]+_[^_]+_[^_]+_[^_]+_[^_]+$", 1).try_cast("int")


def basename(path: str | Column) -> Column:
    return F.regexp_extract(col_(path), r"([^/]+)/?$", 1)
