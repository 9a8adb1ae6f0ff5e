"""Run statistics: totals, descriptions, N-values, duration, the report, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.session import literal_rows
from seqyield.functions.expr import human_bases, nan_to_null
from seqyield.operators.prefix import running_totals
from seqyield.operators.quantiles import exact_quantiles

# Fixed values of the reference's report.
DESCRIBE_PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
NX_PERCENTS = (0.1, 0.25, 0.5, 0.75, 0.9)


def total_yield(df: DataFrame, length_col: str = "sequence_length_template") -> DataFrame:
    return df.agg(F.sum(F.col(length_col).cast("long")).alias("total_bases"))


def _pct_label(p: float) -> str:
    return f"{p * 100:g}%"


def describe(df: DataFrame, col: str, percentiles: Sequence[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """``(stat, value)``: count, mean, std, min, percentiles, max — rounded to 2 places.

    Percentiles are exact (interpolated), not ``DataFrame.summary()``'s approximations.
    """
    return describe_columns(df, [col], percentiles).drop("column")


def describe_columns(df: DataFrame, cols: Sequence[str],
                     percentiles: Sequence[float] = DESCRIBE_PERCENTILES,
                     by: Sequence[str] | None = None) -> DataFrame:
    """:func:`describe` for several columns (and groups) at once: ``(*by, column, stat, value)``.

    The columns are stacked into ``(column, value)`` so one aggregate and one
    grouped exact-quantile pass serve all of them.
    """
    by = list(by or [])
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    stacked = df.selectExpr(*[f"`{b}`" for b in by], f"stack({len(cols)}, {pairs}) as (column, __v)") \
        .select(*by, "column", nan_to_null(F.col("__v")).alias("__v"))
    v = F.col("__v")
    keys = [*by, "column"]
    base = stacked.groupBy(*keys).agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    head = base.selectExpr(*[f"`{k}`" for k in keys],
                           "stack(4, 'count', count, 'mean', mean, 'std', std, 'min', min) as (stat, value)")
    tail = base.selectExpr(*[f"`{k}`" for k in keys], "stack(1, 'max', max) as (stat, value)")
    labels = F.create_map(*[x for p in percentiles for x in (F.lit(float(p)), F.lit(_pct_label(p)))])
    q = exact_quantiles(stacked, "__v", percentiles, by=keys).select(
        *keys, labels[F.col("p")].alias("stat"), F.col("q").alias("value"))
    out = head.unionByName(q).unionByName(tail)
    return out.select(*keys, "stat", F.round("value", 2).alias("value"))


def _up_to(before, length, count, target, strict: bool):
    """How many of ``count`` equal lengths, summed on top of ``before``, stay at or (strict) under the target."""
    k = (F.ceil((target - before) / length) - 1) if strict else F.floor((target - before) / length)
    k = k.cast("long")
    total = lambda n: (before + n * length).cast("double")
    fits = (lambda n: total(n) < target) if strict else (lambda n: total(n) <= target)
    # The division may be off by one in the last bit; the comparison on whole numbers decides.
    k = F.when(~fits(k), k - 1).when(fits(k + 1), k + 1).otherwise(k)
    k = F.least(F.greatest(k, F.lit(0).cast("long")), count)
    return F.when(length == 0, F.when(fits(F.lit(0).cast("long")), count).otherwise(F.lit(0).cast("long"))).otherwise(k)


def nx_values(df: DataFrame, length_col: str = "sequence_length_template", mode: str = "compat",
              percents: Sequence[float] = NX_PERCENTS, by: str | None = None) -> DataFrame:
    """``(label, value)`` rows N10 … N90, for each value of ``by`` if given.

    ``standard``: the usual N-statistic — the largest length L such that reads
    of length ≥ L hold at least p of all bases.

    ``compat``: what the reference picks from the lengths in *ascending* order.
    For the next percentage it is the first read after the previous pick whose
    cumulative bases do not exceed the target while the next read's reach it;
    when there is none the list ends (so it can be shorter than five).

    Both work on the histogram of distinct lengths, summed in order once;
    everything after is small aggregates of that table.
    """
    if mode not in ("compat", "standard"):
        raise ValueError("mode must be 'compat' or 'standard'")
    key = F.col(by) if by else F.lit(0)
    hist = (df.select(key.alias("__g"), F.col(length_col).cast("long").alias("len")).where(F.col("len").isNotNull())
            .groupBy("__g", "len").agg(F.count(F.lit(1)).alias("c")))
    length, count = F.col("len"), F.col("c")
    labels = [f"N{round(p * 100):02d}" for p in percents]
    if mode == "standard":
        pref = running_totals(hist.withColumn("__neg", -length), ["__neg"], {"__rc": length * count}, by=["__g"])
        total = pref.groupBy(F.col("__g").alias("__k")).agg(F.sum(length * count).cast("double").alias("__t"))
        rows = pref.join(total, F.col("__g").eqNullSafe(F.col("__k"))).where("__t > 0")
        best = rows.groupBy("__g").agg(*[
            F.max(F.when(F.col("__rc").cast("double") >= F.col("__t") * float(p), length)).alias(f"v{i}")
            for i, p in enumerate(percents)])
        out = best.select("__g", F.explode(F.array(*[
            F.struct(F.lit(n).alias("label"), F.col(f"v{i}").alias("value")) for i, n in enumerate(labels)])).alias("x"))
        out = out.select("__g", "x.label", "x.value").where("value is not null")
        return out.select(*([F.col("__g").alias(by)] if by else []), "label", "value")

    pref = running_totals(hist, ["len"], {"__cum": length * count, "__idx": count}, by=["__g"])
    pref = pref.select("__g", "len", "c", (F.col("__cum") - length * count).alias("before"),
                       (F.col("__idx") - count).alias("first"))
    total = pref.groupBy(F.col("__g").alias("__k")).agg(F.sum(length * count).cast("double").alias("__t"),
                                                        F.sum("c").alias("__n"))
    rows = pref.join(total, F.col("__g").eqNullSafe(F.col("__k")))
    target = lambda p: F.col("__t") * F.lit(float(p))
    counted = rows.groupBy("__g", "__n").agg(*[
        F.sum(_up_to(F.col("before"), length, count, target(p), strict)).alias(f"{name}{i}")
        for name, strict in (("upto", False), ("under", True)) for i, p in enumerate(percents)])
    # The reads that may be picked for a target are consecutive: from the last one under it
    # (and past the previous pick) to the last one not over it, the very last read excepted.
    picks, previous, going = [], F.lit(-1).cast("long"), F.lit(True)
    for i, name in enumerate(labels):
        low = F.greatest(F.col(f"under{i}") - 1, F.lit(0).cast("long"), previous + 1)
        high = F.least(F.col(f"upto{i}") - 1, F.col("__n") - 2)
        going = going & (low <= high)
        picks.append(F.struct(F.lit(name).alias("label"), F.when(going, low).alias("at")))
        previous = low
    picks = counted.select(F.col("__g").alias("__k"), F.filter(F.array(*picks), lambda x: x["at"].isNotNull()).alias("__p"))
    found = pref.join(picks, F.col("__g").eqNullSafe(F.col("__k"))).select("__g", "len", F.explode(F.filter(
        "__p", lambda x: (F.col("first") <= x["at"]) & (x["at"] < F.col("first") + count))).alias("x"))
    return found.select(*([F.col("__g").alias(by)] if by else []), F.col("x.label").alias("label"), F.col("len").alias("value"))


def run_duration(df: DataFrame, time_col: str = "start_time_float_by_sample") -> DataFrame:
    """Longest elapsed time, split into hours, minutes, seconds."""
    d = df.agg(F.max(time_col).alias("duration_s"))
    hours = F.floor(F.col("duration_s") / 3600).cast("double")
    rem = F.col("duration_s") % 3600
    return d.select("duration_s", hours.alias("hours"),
                    F.floor(rem / 60).cast("double").alias("minutes"), (rem % 60).alias("seconds"))


def run_report(stages: dict[str, DataFrame], length_col: str = "sequence_length_template",
               quality_col: str = "mean_qscore_template",
               time_col: str = "start_time_float_by_sample", sample_col: str = "sample_id") -> DataFrame:
    """Rows ``(stage, section, label, value, human)`` for each named stage.

    The duration is the largest time of the rows given: pass trimmed rows with
    their time since the run's start, not since the first read that was kept.
    """
    # All stages in one frame keyed by stage: one aggregate, one describe and one N pass serve them all.
    frames = [df.select(F.lit(stage).alias("stage"), F.col(length_col).alias("__len"),
                        F.col(quality_col).alias("__q"), F.col(time_col).alias("__t"),
                        (F.col(sample_col) if sample_col in df.columns else F.lit(None)).cast("string").alias("__sample"))
              for stage, df in stages.items()]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    one = both.groupBy("stage").agg(F.sum(F.col("__len").cast("long")).alias("total_bases"),
                                    F.max("__t").alias("duration_s"), F.min("__sample").alias("sample"))
    nothing = F.lit(None).cast("double")
    sample = one.select("stage", F.lit("sample").alias("section"), F.lit("id").alias("label"), nothing.alias("value"),
                        F.col("sample").alias("human"))
    tot = one.select(
        "stage", F.lit("total").alias("section"), F.lit("bases").alias("label"),
        F.col("total_bases").cast("double").alias("value"), human_bases("total_bases").alias("human"))
    section = F.create_map(F.lit("__len"), F.lit("length"), F.lit("__q"), F.lit("quality"))
    desc = describe_columns(both, ["__len", "__q"], by=["stage"]).select(
        "stage", section[F.col("column")].alias("section"), F.col("stat").alias("label"), "value",
        F.lit(None).cast("string").alias("human"))
    d = F.col("duration_s")
    rem = d % 3600
    du = one.select(
        "stage", F.lit("duration").alias("section"), F.lit("seconds").alias("label"),
        F.round(d, 1).alias("value"),
        F.format_string("%d hours, %d minutes, %.0f seconds", F.floor(d / 3600).cast("long"),
                        F.floor(rem / 60).cast("long"), rem % 60).alias("human"))
    nx = nx_values(both, "__len", "compat", by="stage").select(
        "stage", F.lit("nx").alias("section"), "label", F.col("value").cast("double").alias("value"),
        human_bases("value").alias("human"))
    return sample.unionByName(tot).unionByName(desc).unionByName(du).unionByName(nx)


#: Degrees of freedom from which the t distribution's tail is taken through the normal's.
NORMAL_FROM = 500


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function, evaluated by convergents."""
    up, up0, down, down0 = 1.0, 0.0, 1.0, 1.0   # convergents up/down of 1/(1+ d1/(1+ d2/(1+ ...
    value = None
    for k in range(1, 100_000):
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        up, up0 = up + d * up0, up
        down, down0 = down + d * down0, down
        scale = 1.0 / down
        up, up0, down, down0 = up * scale, up0 * scale, 1.0, down0 * scale
        if value is not None and abs(up - value) <= 1e-15 * abs(up):
            return up
        value = up
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def pearson_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a Pearson r under the t distribution with n-2 df."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    r = max(-1.0, min(1.0, r))
    if abs(r) == 1.0:
        return 0.0
    df_ = n - 2
    t2 = r * r * df_ / (1.0 - r * r)
    if df_ < NORMAL_FROM:
        return betainc_reg(df_ / 2.0, 0.5, df_ / (df_ + t2))
    # Many degrees of freedom: the normal deviate with the same tail, by its expansion in 1/df.
    a = df_ - 0.5
    b = 48.0 * a * a
    w = math.sqrt(a * math.log1p(t2 / df_))
    z = w + (w ** 3 + 3 * w) / b - (4 * w ** 7 + 33 * w ** 5 + 240 * w ** 3 + 855 * w) / (10 * b * (b + 0.8 * w ** 4 + 100))
    return math.erfc(z / math.sqrt(2.0))


def pearson(df: DataFrame, x: str, y: str, with_p_value: bool = False) -> DataFrame:
    """``(x, y, n, r[, p_value])`` over rows where both values are present."""
    xs, ys = nan_to_null(F.col(x).cast("double")), nan_to_null(F.col(y).cast("double"))
    both = df.select(xs.alias("__x"), ys.alias("__y")).where("__x is not null and __y is not null")
    res = both.agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("r")).select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "r")
    if not with_p_value:
        return res
    row = res.collect()[0]
    p = pearson_p_value(row["r"], row["n"])
    return literal_rows(df.sparkSession, [(x, y, row["n"], row["r"], p)],
                                           "x string, y string, n long, r double, p_value double")
