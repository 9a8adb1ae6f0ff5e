"""Distributions as plot-ready tables: histograms, densities, binned trends, hexbins, samples.

Every operator reduces the rows to a bounded table (bins, grid points, hex
cells) with partial aggregation; per-column scalars (min, max, quartiles) are
one small aggregate whose few numbers come back as literals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqyield.session import literal_rows, materialize
from seqyield.functions.expr import hhmm, nan_to_null
from seqyield.operators.quantiles import exact_quantiles

# Fixed values of the reference's plots.
WEIGHTED_EDGES = 50          # linspace(0, max, 50): 49 bins
MAX_AUTO_BINS = 50           # Freedman–Diaconis bin count is capped at 50
KDE_GRID, KDE_CUT = 100, 3   # density evaluated on 100 points, support ± 3 bandwidths
RIDGE_BINS = 16              # equal-width time bins of the quality ridges
TREND_BINS = 10              # x replaced by the nearest of 10 percentile points
PAIR_SAMPLE = 10_000
PAIR_RATIO_MAX = 5
PAIR_COLUMNS = ("mean_qscore_template", "pore_speed", "sequence_length_template", "events_ratio")
PAIR_BINS = 10
# Shares of a density that its contour levels enclose; the ground below the largest is not shaded.
CONTOUR_MASSES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)
# Display names of the pair view's variables.
PAIR_DISPLAY_NAMES = {"mean_qscore_template": "Mean QScore Template", "pore_speed": "Pore Speed (b/s)",
                      "sequence_length_template": "Read Length", "events_ratio": "Events / base"}


def _num(c: str | Column) -> Column:
    return nan_to_null((F.col(c) if isinstance(c, str) else c).cast("double"))


def _with_bin(df: DataFrame, x: str, mn: str, mx: str, step: str, nb: str, out: str = "bin") -> DataFrame:
    """Add ``out`` = index i with ``e_i <= x < e_(i+1)`` (last bin closed), ``e_i = i*step + mn``,
    ``e_nb = mx`` — the same membership as numpy's histogram for ``linspace`` edges.

    Each step is its own column so no sub-expression is copied into the next.
    """
    X, MN, MX, ST, NB = (F.col(c) for c in (x, mn, mx, step, nb))
    last = NB - 1
    edge = lambda i: F.when(i >= NB, MX).otherwise(i.cast("double") * ST + MN)
    raw = F.least(F.greatest(F.floor((X - MN) / ST).cast("long"), F.lit(0).cast("long")), last)
    df = df.withColumn("__raw", raw)
    r = F.col("__raw")
    df = df.withColumn("__down", F.when((r > 0) & (X < edge(r)), r - 1).otherwise(r))
    d = F.col("__down")
    df = df.withColumn(out, F.when((d < last) & (X >= edge(d + 1)), d + 1).otherwise(d))
    return df.drop("__raw", "__down")


def _edges(i: Column, mn: Column, mx: Column, step: Column, nb: Column):
    left = i.cast("double") * step + mn
    right = F.when(i + 1 >= nb, mx).otherwise((i + 1).cast("double") * step + mn)
    return left, right


def _group_params(stats: DataFrame, by: Sequence[str], cols: Sequence[str]):
    """Function attaching the parameters ``cols`` of each group to a frame.

    Without grouping the one row is fetched and attached as literals.  With
    grouping the table (one row per group) is written once and joined on the
    group; Spark picks the join from its size.
    """
    if by:
        table = materialize(stats.select(*by, *cols), "params")
        return lambda df: df.join(table, list(by), "inner")
    row = stats.select(*cols).first()

    def attach(df: DataFrame) -> DataFrame:
        if row is None:
            return df.where(F.lit(False)).select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
        return df.select("*", *[F.lit(row[c]).alias(c) for c in cols])
    return attach


def equal_width_histogram(df: DataFrame, value: str | Column, bins: int | None = None,
                          weight: str | Column | None = None, by: Sequence[str] | None = None,
                          lower: float | None = None, density: bool = True) -> DataFrame:
    """Histogram with ``bins`` equal-width bins over ``[lower or min, max]`` per group.

    ``bins=None`` picks the Freedman–Diaconis count (at most 50) per group.
    Returns ``(*by, bin, left, right, weight, density)``; every bin appears.
    Per-group parameters (range, bin count, total weight) are one aggregate.
    """
    by = list(by or [])
    v = _num(value).alias("__x")
    w = (F.lit(1.0) if weight is None else _num(weight)).alias("__w")
    data = df.select(*by, v, w).where("__x is not null and __w is not null")
    stats = data.groupBy(*by).agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"),
                                  F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__tw"))
    if bins is None:
        iq = exact_quantiles(data, "__x", [0.25, 0.75], by=by)
        iq = iq.groupBy(*by).agg((F.max(F.when(F.col("p") == 0.75, F.col("q")))
                                  - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("__iqr"))
        stats = stats.join(iq, by, "left") if by else stats.withColumn("__iqr", iq.select("__iqr").scalar())
        h = 2 * F.col("__iqr") / F.pow(F.col("__n").cast("double"), F.lit(1.0 / 3))
        fd = F.when(F.col("__n") < 2, F.lit(1)).when(
            F.coalesce(h, F.lit(0.0)) == 0, F.floor(F.sqrt(F.col("__n").cast("double")))
        ).otherwise(F.ceil((F.col("__mx") - F.col("__mn")) / h))
        stats = stats.withColumn("__nb", F.least(fd.cast("long"), F.lit(MAX_AUTO_BINS).cast("long")))
    else:
        stats = stats.withColumn("__nb", F.lit(int(bins)).cast("long"))
    if lower is not None:
        stats = stats.withColumn("__mn", F.lit(float(lower)))
    # A zero range is widened by ±0.5 like numpy.
    same = F.col("__mx") == F.col("__mn")
    stats = (stats.withColumn("__lo", F.when(same, F.col("__mn") - 0.5).otherwise(F.col("__mn")))
             .withColumn("__hi", F.when(same, F.col("__mx") + 0.5).otherwise(F.col("__mx")))
             .withColumn("__nb", F.greatest(F.col("__nb"), F.lit(1).cast("long")))
             .withColumn("__step", (F.col("__hi") - F.col("__lo")) / F.col("__nb").cast("double")))
    attach = _group_params(stats, by, ["__lo", "__hi", "__step", "__nb", "__tw"])
    lo, hi, step, nb = F.col("__lo"), F.col("__hi"), F.col("__step"), F.col("__nb")
    joined = attach(data)
    binned = _with_bin(joined.where((F.col("__x") >= lo) & (F.col("__x") <= hi)),
                       "__x", "__lo", "__hi", "__step", "__nb").select(*by, "bin", "__w")
    sums = binned.groupBy(*by, "bin").agg(F.sum("__w").alias("weight"))
    # Every bin of every group, generated from the parameters.
    params = attach(sums.select(*by).distinct()) if by else attach(df.sparkSession.range(1).drop("id"))
    all_bins = params.select(*by, "__lo", "__hi", "__step", "__nb", "__tw",
                             F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)).alias("bin"))
    full = all_bins.join(sums, [*by, "bin"], "left")
    left, right = _edges(F.col("bin"), lo, hi, step, nb)
    wt = F.coalesce(F.col("weight"), F.lit(0.0))
    cols = [*by, "bin", left.alias("left"), right.alias("right"), wt.alias("weight")]
    if density:
        cols.append(F.try_divide(wt, F.col("__tw") * step).alias("density"))
    return full.select(*cols)


def weighted_histogram(df: DataFrame, length_col: str = "sequence_length_template",
                       edges: int = WEIGHTED_EDGES) -> DataFrame:
    """Bases per length bin: ``linspace(0, max, 50)`` edges, weight = length.

    ``(bin, left, right, bases, density)``; ``bases`` is what the axis shows.
    """
    h = equal_width_histogram(df, length_col, bins=edges - 1, weight=length_col, lower=0.0)
    return h.select("bin", "left", "right", F.col("weight").alias("bases"), "density")


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Read counts per bin (Freedman–Diaconis count, at most 50) with density."""
    h = equal_width_histogram(df, col, bins=bins)
    return h.select("bin", "left", "right", F.col("weight").cast("long").alias("reads"), "density")


def kde_1d(df: DataFrame, col: str, by: Sequence[str] | None = None, gridsize: int = KDE_GRID,
           cut: float = KDE_CUT) -> DataFrame:
    """Gaussian density on ``gridsize`` points per group: ``(*by, point, x, density)``.

    Bandwidth: Scott's rule ``1.059 * min(sd, IQR/1.349) * n^(-1/5)`` (sd alone
    when the IQR is 0); support ``[min - cut*bw, max + cut*bw]``.  Every row
    adds its kernel to the ``gridsize`` sums of its group, a matrix per Arrow
    batch, so the result is exact at any size and no row is copied.
    """
    by = list(by or [])
    data = df.select(*by, _num(col).alias("__x")).where("__x is not null")
    stats = data.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"),
                                  F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    iq = exact_quantiles(data, "__x", [0.25, 0.75], by=by).groupBy(*by).agg(
        (F.max(F.when(F.col("p") == 0.75, F.col("q")))
         - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("__iqr"))
    stats = stats.join(iq, by, "left") if by else stats.withColumn("__iqr", iq.select("__iqr").scalar())
    a = F.when(F.col("__iqr") > 0, F.least(F.col("__sd"), F.col("__iqr") / 1.349)).otherwise(F.col("__sd"))
    bw = (F.lit(1.059) * a * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    stats = (stats.withColumn("__bw", bw).where("__bw is not null and __bw > 0")
             .withColumn("__lo", F.col("__mn") - cut * F.col("__bw"))
             .withColumn("__hi", F.col("__mx") + cut * F.col("__bw")))
    params = ["__n", "__bw", "__lo", "__hi"]
    rows = _group_params(stats, by, params)(data).select(*by, *params, "__x")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names, steps = [*rows.columns[:-1], "__sums"], np.arange(gridsize, dtype=float)

    def kernels(batches):
        for batch in batches:
            _, bw, lo, hi, x = (np.asarray(batch.column(i), float) for i in range(len(by), batch.num_columns))
            sums = np.exp(-0.5 * (((lo[:, None] + steps * ((hi - lo) / (gridsize - 1))[:, None]) - x[:, None]) / bw[:, None]) ** 2)
            group = np.zeros(len(x), np.int64)
            for i in range(len(by)):
                codes = np.asarray(batch.column(i).dictionary_encode(null_encoding="encode").indices)
                group = np.unique(group * (len(x) + 1) + codes, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            starts = np.concatenate([[0], np.nonzero(np.diff(group[order]))[0] + 1]) if len(x) else order
            sums = np.add.reduceat(sums[order], starts) if len(x) else sums
            first = batch.take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array(list(sums), pa.list_(pa.float64()))],
                                             names=names)

    # Every batch sends one row of sums per group it holds; the grid points are added up from those.
    added = rows.mapInArrow(kernels, kinds + ", __sums array<double>").select(
        *by, *params, F.posexplode("__sums").alias("point", "__s")).groupBy(*by, *params, "point").agg(F.sum("__s").alias("__s"))
    x = F.col("__lo") + F.col("point").cast("double") * ((F.col("__hi") - F.col("__lo")) / (gridsize - 1))
    norm = F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi)
    return added.select(*by, "point", x.alias("x"), (F.col("__s") / norm).alias("density"))


def _round_frac(x: Column, digits: int = 3) -> Column:
    """Break rounding of interval labels: ``digits`` decimals, or ``digits``
    significant digits below 1, half to even (``rint(x * 10^d) / 10^d``)."""
    small = F.floor(F.abs(x)) == 0
    sig = (-F.floor(F.log10(F.abs(x))) - 1 + digits).cast("double")
    scale = F.when(small, F.pow(F.lit(10.0), sig)).otherwise(F.lit(10.0 ** digits))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.rint(x * scale) / scale)


def time_bins(df: DataFrame, time_col: str = "start_time_float_by_sample", bins: int = RIDGE_BINS) -> DataFrame:
    """Add equal-width, right-closed time bins (lowest edge lowered by 0.1 % of the range)
    and their ``HH:MM - HH:MM`` label clipped to ``[0, max]``.

    The time range (two scalars) is fetched once and used as literals; rows
    only get a bin number, and the ``bins`` labels are built once in a
    ``bins``-row table joined on the bin.
    """
    lo_hi = df.agg(F.min(time_col).alias("mn"), F.max(time_col).alias("mx")).first()
    if lo_hi is None or lo_hi["mn"] is None:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("time_bin", "int"), ("time_bin_left", "double"), ("time_bin_right", "double"),
            ("time_bin_label", "string"))]).where(F.lit(False))
    mn, mx = F.lit(float(lo_hi["mn"])), F.lit(float(lo_hi["mx"]))
    step = (mx - mn) / bins
    adj = (mx - mn) * 0.001
    edge = lambda i: F.when(i <= 0, mn - adj).when(i >= bins, mx).otherwise(
        i.cast("double") * step + mn)
    j = df
    t = F.col(time_col)
    raw = F.least(F.greatest(F.ceil((t - mn) / step).cast("int") - 1, F.lit(0)), F.lit(bins - 1))
    j = j.withColumn("__raw", F.when(step == 0, F.lit(0)).otherwise(raw))
    r = F.col("__raw")
    j = j.withColumn("__down", F.when((r > 0) & (t <= edge(r)), r - 1).otherwise(r))
    d = F.col("__down")
    j = j.withColumn("time_bin", F.when((d < bins - 1) & (t > edge(d + 1)), d + 1).otherwise(d)) \
        .drop("__raw", "__down")
    labels = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("time_bin"))
    b = F.col("time_bin")
    labels = (labels.withColumn("__rl", _round_frac(edge(b))).withColumn("__rr", _round_frac(edge(b + 1)))
              .select("time_bin", F.greatest(F.col("__rl"), F.lit(0.0)).alias("time_bin_left"),
                      F.least(F.col("__rr"), mx).alias("time_bin_right")))
    labels = labels.withColumn("time_bin_label",
                               F.concat_ws(" - ", hhmm("time_bin_left"), hhmm("time_bin_right")))
    return j.join(F.broadcast(labels), "time_bin", "inner")


def quality_ridges(df: DataFrame, time_col: str = "start_time_float_by_sample",
                   quality_col: str = "mean_qscore_template", bins: int = RIDGE_BINS) -> DataFrame:
    """Quality density per time bin label (equal labels merge): ``(time_bin_label, point, x, density)``."""
    tb = time_bins(df, time_col, bins)
    return kde_1d(tb, quality_col, by=["time_bin_label"])


#: Replicates of a bootstrap, and the modulus of its draws.
REPLICATES, PRIME = 1000, (1 << 31) - 1


def _md5_number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def poisson_limits(k: int = 10) -> list[int]:
    """A draw r of 0 .. PRIME - 1 has the Poisson(1) weight of how many of these numbers are r or less."""
    return [math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) * PRIME) for j in range(k)]


def poisson_weights(h1: np.ndarray, h2: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (a row per row) of rows with the hashes h1 and h2 in every replicate.

    Replicate b draws (h1 a_b + h2 c_b) mod PRIME; a_b and c_b come from MD5, so a
    row weighs the same wherever and however often it is read.
    """
    a = np.array([_md5_number(f"a:{b}") % (PRIME - 1) + 1 for b in range(replicates)], np.int64)
    c = np.array([_md5_number(f"c:{b}") % (PRIME - 1) + 1 for b in range(replicates)], np.int64)
    drawn = (h1[:, None] * a % PRIME + h2[:, None] * c % PRIME) % PRIME
    weights = np.zeros(drawn.shape, np.int8)
    for limit in poisson_limits():
        weights += drawn >= limit
    return weights


def _placed(df: DataFrame, x_col: str, y_col: str, by: str, bins: int, *carried: Column) -> DataFrame:
    """Rows (group, __x, __y) with the percentile points ``__c`` of x in their group and the nearest one, ``x_centre``."""
    data = df.select(F.col(by).alias("group"), _num(x_col).alias("__x"), _num(y_col).alias("__y"), *carried) \
        .where("__x is not null and __y is not null")
    probs = [k / (bins + 1) for k in range(1, bins + 1)]
    # One row per group: its percentile points in order and the midpoints between them.
    centres = exact_quantiles(data, "__x", probs, by=["group"]).groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("p", "q")))["q"].alias("__c"))
    centres = centres.select(F.col("group").alias("__g"), "__c", F.transform(
        F.sequence(F.lit(0), F.lit(bins - 2)), lambda k: (F.get("__c", k) + F.get("__c", k + 1)) / 2.0).alias("__mid"))
    placed = data.join(centres, data["group"].eqNullSafe(F.col("__g")))
    # Nearest centre, the lower one on a tie: the number of midpoints strictly below x.
    nearest = F.get("__c", F.size(F.filter("__mid", lambda m: m < F.col("__x"))))
    return placed.withColumn("x_centre", nearest).drop("__g", "__mid")


def bootstrap_sums(placed: DataFrame, id_col: str, replicates: int = REPLICATES) -> DataFrame:
    """Poisson bootstrap: ``(group, x_centre, origin, replicate, w, wx, wy, wxx, wxy)``.

    One pass over the rows of :func:`_placed`, no copy of any: every row weighs
    in each replicate by a Poisson(1) number drawn from its id, and a task sends
    the weighted sums of its bins as one matrix per sum.  x counts from
    ``origin``, a percentile point of the group.
    """
    digest = F.md5(F.concat(F.lit("bootstrap-1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    origin = F.get("__c", F.floor((F.size("__c") - 1) / 2).cast("int"))
    rows = placed.select("group", "x_centre", origin.alias("origin"), (F.col("__x") - origin).alias("x"), F.col("__y").alias("y"),
                         part(1).alias("h1"), part(9).alias("h2"))
    kind = placed.schema["group"].dataType.simpleString()

    def sums(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                keys = list(zip(*(some.column(i).to_pylist() for i in range(3))))
                x, y, h1, h2 = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
                found = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                member = np.zeros((len(found), len(keys)))
                member[[found[k] for k in keys], np.arange(len(keys))] = 1.0
                w = poisson_weights(h1, h2, replicates).astype(float)
                got = np.stack([(member * v) @ w for v in (1.0, x, y, x * x, x * y)], axis=-1)
                for k, i in found.items():
                    total[k] = total[k] + got[i] if k in total else got[i]
        for (group, centre, start), m in total.items():
            n = len(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * n), pa.array([centre] * n, pa.float64()), pa.array([start] * n, pa.float64()),
                 pa.array(np.arange(n, dtype=np.int32)), *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(5)]],
                names=["group", "x_centre", "origin", "replicate", "w", "wx", "wy", "wxx", "wxy"])

    schema = f"group {kind}, x_centre double, origin double, replicate int, w double, wx double, wy double, wxx double, wxy double"
    return rows.mapInArrow(sums, schema).groupBy("group", "x_centre", "origin", "replicate").agg(
        *[F.sum(c).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy")])


def trend_and_band(df: DataFrame, x_col: str, y_col: str, by: str = "qualitative_pass", bins: int = TREND_BINS,
                   id_col: str = "read_id", replicates: int = REPLICATES, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """The binned trend and the line's band of one plot, from one pass over the rows (written once, narrow).

    Trend: ``(group, x_centre, reads, y_mean, ci_low, ci_high, slope, intercept, y_axis_max)``, the mean of y
    at the nearest of ``bins`` percentile points of x, per group, with its 95 % bootstrap interval, and the
    least-squares line on the unbinned rows; ``y_axis_max`` is twice the mean of y over all rows, the plot's axis limit.

    Band: ``(group, point, x, y_fit, y_low, y_high)``, the line and the 95 % band of the lines of all
    replicates, at ``points`` places from the group's least to its largest x.  The lines come from the
    weighted sums of the replicates alone, a few numbers each, whatever the number of rows.

    A frame without ``id_col`` draws by group, x and y; equal rows then weigh alike.
    """
    name = F.col(id_col) if id_col in df.columns else F.concat_ws("|", *[F.col(c).cast("string") for c in (by, x_col, y_col)])
    placed = materialize(_placed(df, x_col, y_col, by, bins, name.alias("__id")), "placed")
    sums = materialize(bootstrap_sums(placed, "__id", replicates), "replicates")
    ends = placed.groupBy(F.col("group").alias("__g")).agg(
        F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.regr_slope("__y", "__x").alias("slope"),
        F.regr_intercept("__y", "__x").alias("intercept"))
    # Axis limit: twice the mean of y over all rows (a scalar subquery).
    limit = df.agg(2 * F.avg(_num(y_col))).scalar()
    return _trend(placed, sums, ends, limit), _band(sums, ends, points)


def _trend(placed: DataFrame, sums: DataFrame, ends: DataFrame, limit: Column) -> DataFrame:
    per_bin = placed.groupBy("group", "x_centre").agg(F.count(F.lit(1)).alias("reads"), F.avg("__y").alias("y_mean"))
    mean = F.col("wy") / F.col("w")
    bounds = sums.where("w > 0").groupBy(F.col("group").alias("__b"), F.col("x_centre").alias("__bx")).agg(
        F.percentile(mean, F.lit(0.025)).alias("ci_low"), F.percentile(mean, F.lit(0.975)).alias("ci_high"))
    return (per_bin.join(ends, per_bin["group"].eqNullSafe(F.col("__g")))
            .join(bounds, per_bin["group"].eqNullSafe(F.col("__b")) & (per_bin["x_centre"] == F.col("__bx")), "left")
            .select("group", "x_centre", "reads", "y_mean", "ci_low", "ci_high", "slope", "intercept",
                    limit.alias("y_axis_max")))


def _band(sums: DataFrame, ends: DataFrame, points: int) -> DataFrame:
    whole = sums.groupBy("group", "origin", "replicate").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy")])
    spread = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    tilt = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / spread
    lines = whole.where(spread > 0).withColumn("__tilt", tilt).select(
        "group", "origin", "__tilt", ((F.col("wy") - F.col("__tilt") * F.col("wx")) / F.col("w")).alias("__level"))
    x = F.col("__low") + F.col("point") * ((F.col("__high") - F.col("__low")) / (points - 1))
    at = (lines.join(ends, lines["group"].eqNullSafe(F.col("__g")))
          .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
          .withColumn("__y", F.col("__level") + F.col("__tilt") * (F.col("x") - F.col("origin"))))
    return at.groupBy("group", "point", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y_fit")).agg(
        F.percentile("__y", F.lit(0.025)).alias("y_low"), F.percentile("__y", F.lit(0.975)).alias("y_high"))


def binned_trend(df: DataFrame, x_col: str, y_col: str, **options) -> DataFrame:
    """The trend of :func:`trend_and_band`."""
    return trend_and_band(df, x_col, y_col, **options)[0]


def trend_band(df: DataFrame, x_col: str, y_col: str, **options) -> DataFrame:
    """The band of :func:`trend_and_band`."""
    return trend_and_band(df, x_col, y_col, **options)[1]


def _fd_bins(n: int, iqr: float | None, mn: float, mx: float) -> int:
    if n < 2:
        return 1
    h = 2 * (iqr or 0.0) / (n ** (1 / 3))
    if h == 0:
        return int(math.sqrt(n))
    return int(math.ceil((mx - mn) / h))


def _hex_columns(points: DataFrame, ends) -> int:
    """Hexagons across: the mean of the Freedman–Diaconis bin counts of both axes, each at most ``MAX_AUTO_BINS``."""
    stacked = points.selectExpr("stack(2, 'x', px, 'y', py) as (axis, v)")
    quartiles = {(r["axis"], r["p"]): r["q"] for r in exact_quantiles(stacked, "v", [0.25, 0.75], by=["axis"]).collect()}
    counts = [min(_fd_bins(ends["n"], quartiles[axis, 0.75] - quartiles[axis, 0.25], ends[f"{axis}_low"], ends[f"{axis}_high"]),
                  MAX_AUTO_BINS) for axis in ("x", "y")]
    return int(sum(counts) / 2)


def hexbin(df: DataFrame, x_col: str, y_col: str, gridsize: int | None = None) -> DataFrame:
    """Hexagonal cell counts: ``(lattice, i, j, x_centre, y_centre, reads)``.

    The centres of hexagons are two rectangular lattices, the second shifted by
    half a step both ways; a point belongs to the nearer of its closest centres,
    distances being ``across² + 3·up²`` in steps.  Without ``gridsize`` the number
    across follows from the data, and the number up is smaller by √3.
    """
    points = df.select(_num(x_col).alias("px"), _num(y_col).alias("py")).where("px is not null and py is not null")
    ends = points.agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("x_low"), F.max("px").alias("x_high"),
                      F.min("py").alias("y_low"), F.max("py").alias("y_high")).head()
    if not ends["n"]:
        return literal_rows(df.sparkSession, [], "lattice int, i long, j long, x_centre double, y_centre double, reads long")
    across = max(int(_hex_columns(points, ends) if gridsize is None else gridsize), 1)
    up = max(int(across / math.sqrt(3)), 1)
    left, right = _nonsingular(ends["x_low"], ends["x_high"])
    bottom, top = _nonsingular(ends["y_low"], ends["y_high"])
    margin = 1.0e-9 * (right - left)   # the outermost points lie inside
    left, right = left - margin, right + margin
    width, height = (right - left) / across, (top - bottom) / up
    steps = points.select(((F.col("px") - F.lit(left)) / F.lit(width)).alias("u"),
                          ((F.col("py") - F.lit(bottom)) / F.lit(height)).alias("v"))

    def closest(lattice: int, to_whole, shift: float) -> Column:
        """The lattice's centre that is closest to a point, and its distance."""
        i, j = to_whole("u").cast("long"), to_whole("v").cast("long")
        far = F.pow(F.col("u") - i - shift, F.lit(2)) + 3.0 * F.pow(F.col("v") - j - shift, F.lit(2))
        return F.struct(F.lit(lattice).alias("lattice"), i.alias("i"), j.alias("j"), far.alias("far"))
    both = steps.select(closest(1, F.rint, 0.0).alias("corner"), closest(2, F.floor, 0.5).alias("middle"))
    cells = both.select(F.when(F.col("corner.far") < F.col("middle.far"), F.col("corner")).otherwise(F.col("middle")).alias("c")).select("c.*")
    # The first lattice has one more centre each way than there are steps.
    more = F.when(F.col("lattice") == 1, 1).otherwise(0)
    inside = F.col("i").between(0, across - 1 + more) & F.col("j").between(0, up - 1 + more)
    shift = F.when(F.col("lattice") == 1, F.lit(0.0)).otherwise(F.lit(0.5))
    return cells.where(inside).groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("reads")).select(
        "lattice", "i", "j", (F.lit(left) + (F.col("i").cast("double") + shift) * F.lit(width)).alias("x_centre"),
        (F.lit(bottom) + (F.col("j").cast("double") + shift) * F.lit(height)).alias("y_centre"), "reads")


def _nonsingular(lo: float, hi: float, expander: float = 0.1) -> tuple[float, float]:
    if hi - lo == 0:
        if lo == 0:
            return -expander, expander
        return lo - expander * abs(lo), hi + expander * abs(hi)
    return lo, hi


def sample_key(id_col: str = "read_id", seed: str = "seqyield") -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def pair_sample(df: DataFrame, k: int = PAIR_SAMPLE, seed: str = "seqyield", id_col: str = "read_id",
                ratio_col: str = "events_ratio", ratio_max: float = PAIR_RATIO_MAX,
                columns: Sequence[str] = (*PAIR_COLUMNS, "qualitative_pass")) -> DataFrame:
    """``k`` reads without replacement, repeatable: the first ``k`` by ``md5(seed || id)``.

    Exact and bounded at any scale: rows whose 60-bit hash prefix falls below a
    threshold sized from the row count (≈1.5 k rows, widened until at least k)
    are the only ones ordered; every row before the k-th in hash order is below
    the threshold, so the result equals a global sort-and-take.
    """
    data = df.where(F.col(ratio_col) < F.lit(ratio_max)).select(id_col, *columns)
    key = sample_key(id_col, seed)
    data = data.withColumn("__key", key)
    n = data.count()
    if n > k:
        frac = min(1.0, 1.5 * k / n + 64.0 / n)
        prefix = F.conv(F.substring("__key", 1, 15), 16, 10).cast("long")
        while True:
            bound = int(frac * (1 << 60))
            cand = data.where(prefix < F.lit(bound))
            if frac >= 1.0 or cand.count() >= k:
                data = cand
                break
            frac = min(1.0, frac * 2)
    return data.orderBy("__key", id_col).limit(k).drop("__key")


def pair_histogram(sample: DataFrame, columns: Sequence[str] = PAIR_COLUMNS,
                   weight_col: str = "sequence_length_template", bins: int = PAIR_BINS) -> DataFrame:
    """Per variable: ``bins`` equal-width bins over its own range, weight = length."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    stacked = sample.selectExpr(f"stack({len(columns)}, {pairs}) as (variable, value)",
                                f"cast({weight_col} as double) as __wt")
    h = equal_width_histogram(stacked, "value", bins=bins, weight="__wt", by=["variable"], density=False)
    return h.select("variable", "bin", "left", "right", F.col("weight").alias("bases"))


def kde_2d(df: DataFrame, x_col: str, y_col: str, gridsize: int = KDE_GRID, cut: float = KDE_CUT) -> DataFrame:
    """Bivariate Gaussian density (product kernel, Scott bandwidth per axis) on a
    ``gridsize`` x ``gridsize`` grid: ``(i, j, x, y, density)``."""
    return kde_2d_pairs(df, [(x_col, y_col)], gridsize, cut).drop("x_var", "y_var")


def kde_2d_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], gridsize: int = KDE_GRID,
                 cut: float = KDE_CUT) -> DataFrame:
    """:func:`kde_2d` of several column pairs at once: ``(x_var, y_var, i, j, x, y, density)``.

    One statistics pass serves all pairs.  Then every task sums the exact
    kernel products of its rows, a matrix product per Arrow batch, and sends
    one grid per pair; the grids are added by one small aggregate.
    """
    columns = sorted({c for p in pairs for c in p})
    data = df.select(*[_num(c).alias(c) for c in columns])
    axes = data.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(x).alias("vx"), F.col(y).alias("vy"))
                                           for k, (x, y) in enumerate(pairs)])).alias("a")).select("a.*") \
        .where("vx is not null and vy is not null")
    stats = {r["pair"]: r for r in axes.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("vx").alias("sx"), F.stddev_samp("vy").alias("sy"),
        F.min("vx").alias("x0"), F.max("vx").alias("x1"), F.min("vy").alias("y0"), F.max("vy").alias("y1")).collect()}
    stacked = axes.selectExpr("pair", "stack(2, 'x', vx, 'y', vy) as (axis, v)")
    q = {(r["pair"], r["axis"], r["p"]): r["q"] for r in
         exact_quantiles(stacked, "v", [0.25, 0.75], by=["pair", "axis"]).collect()}

    def scott(sd, iqr, n):
        return 1.059 * (min(sd, iqr / 1.349) if iqr > 0 else sd) * n ** (-0.2)
    grids = {}
    for k, r in stats.items():
        if r["n"] > 1:
            bx = scott(r["sx"], q[k, "x", 0.75] - q[k, "x", 0.25], r["n"])
            by = scott(r["sy"], q[k, "y", 0.75] - q[k, "y", 0.25], r["n"])
            if bx > 0 and by > 0:
                grids[k] = (r["n"], bx, by, r["x0"] - cut * bx, r["x1"] + cut * bx, r["y0"] - cut * by, r["y1"] + cut * by)
    steps = np.arange(gridsize, dtype=float)
    lines = {k: (lx + steps * ((hx - lx) / (gridsize - 1)), ly + steps * ((hy - ly) / (gridsize - 1)))
             for k, (_, _, _, lx, hx, ly, hy) in grids.items()}
    at = {c: i for i, c in enumerate(columns)}

    def sums(batches):
        total = {k: np.zeros((gridsize, gridsize)) for k in grids}
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)]
            for k, (_, bx, by, *_) in grids.items():
                vx, vy = values[at[pairs[k][0]]], values[at[pairs[k][1]]]
                both = ~(np.isnan(vx) | np.isnan(vy))
                ex = np.exp(-0.5 * ((lines[k][0][:, None] - vx[both]) / bx) ** 2)
                ey = np.exp(-0.5 * ((lines[k][1][:, None] - vy[both]) / by) ** 2)
                total[k] += ex @ ey.T
        i, j = np.divmod(np.arange(gridsize * gridsize), gridsize)
        for k, grid in total.items():
            yield pa.RecordBatch.from_pydict({"pair": pa.array(np.full(len(i), k, np.int32)),
                                              "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)),
                                              "s": pa.array(grid.ravel())})

    added = data.mapInArrow(sums, "pair int, i int, j int, s double").groupBy("pair", "i", "j").agg(F.sum("s").alias("s"))
    chosen = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]),
                                         F.col("pair"))
    if not grids:
        return literal_rows(df.sparkSession, [], "x_var string, y_var string, i int, j int, x double, y double, density double")
    on_line = lambda i, lo, hi: chosen({k: float(g[lo]) for k, g in grids.items()}) + F.col(i).cast("double") * (
        chosen({k: float((g[hi] - g[lo]) / (gridsize - 1)) for k, g in grids.items()}))
    norm = chosen({k: float(n * bx * by * 2 * math.pi) for k, (n, bx, by, *_) in grids.items()})
    return added.select(chosen({k: pairs[k][0] for k in grids}).alias("x_var"),
                        chosen({k: pairs[k][1] for k in grids}).alias("y_var"), "i", "j",
                        on_line("i", 3, 4).alias("x"), on_line("j", 5, 6).alias("y"), (F.col("s") / norm).alias("density"))


def pair_kde_2d(sample: DataFrame, columns: Sequence[str] = PAIR_COLUMNS, gridsize: int = KDE_GRID) -> DataFrame:
    """Lower triangle of the pair view: one 2-D density per pair of variables."""
    return kde_2d_pairs(sample, [(columns[b], columns[a]) for a in range(len(columns)) for b in range(a)], gridsize)


def density_levels(grid: DataFrame, masses: Sequence[float] = CONTOUR_MASSES, by: Sequence[str] = ("x_var", "y_var")) -> DataFrame:
    """``(*by, level, mass, density)``: the density down to which the cells of a grid hold each share of the whole.

    Cells are summed from the densest on; grids are small (``gridsize`` squared), so each is one window.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("density"), "i", "j")
    summed = grid.select(*by, "density", F.sum("density").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
                         F.sum("density").over(Window.partitionBy(*by)).alias("__all"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(m)).alias("mass")) for k, m in enumerate(sorted(masses, reverse=True))])
    reached = summed.withColumn("l", F.explode(levels)).where("__upto >= l.mass * __all")
    return reached.groupBy(*by, F.col("l.level").alias("level"), F.col("l.mass").alias("mass")).agg(F.max("density").alias("density"))


def contour_lines(grid: DataFrame, levels: DataFrame, by: Sequence[str] = ("x_var", "y_var")) -> DataFrame:
    """Marching squares: ``(*by, level, i, j, part, x0, y0, x1, y1)``, the pieces of each level's line in the cell
    from grid point (i, j) to (i + 1, j + 1).

    A corner is inside at the level's density or more; a side whose corners
    differ is crossed where the density, taken as linear, meets the level.  Where
    all four sides are crossed the mean of the corners says which corners are
    joined.
    """
    by = list(by)
    right = grid.select(*by, (F.col("i") - 1).alias("i"), "j", F.col("x").alias("x1"), F.col("density").alias("b"))
    up = grid.select(*by, "i", (F.col("j") - 1).alias("j"), F.col("y").alias("y1"), F.col("density").alias("d"))
    across = grid.select(*by, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("density").alias("c"))
    cells = grid.withColumnsRenamed({"x": "x0", "y": "y0", "density": "a"})
    for corner in (right, up, across):
        cells = cells.join(corner, [*by, "i", "j"])
    cells = cells.join(levels.select(*by, "level", F.col("density").alias("z")), by)
    x0, x1, y0, y1, z = (F.col(c) for c in ("x0", "x1", "y0", "y1", "z"))

    def crossing(p: str, q: str, place):
        """Where the line crosses the side from corner p to corner q; null if it doesn't."""
        p, q = F.col(p), F.col(q)
        share = (z - p) / (q - p)
        x, y = place(share)
        return F.when((p >= z) != (q >= z), F.struct(x.alias("x"), y.alias("y")))
    sides = {"bottom": crossing("a", "b", lambda t: (x0 + t * (x1 - x0), y0)),
             "right": crossing("b", "c", lambda t: (x1, y0 + t * (y1 - y0))),
             "top": crossing("d", "c", lambda t: (x0 + t * (x1 - x0), y1)),
             "left": crossing("a", "d", lambda t: (x0, y0 + t * (y1 - y0)))}
    cells = cells.withColumns(sides).withColumn(
        "crossed", F.filter(F.array("bottom", "right", "top", "left"), lambda s: s.isNotNull()))

    def piece(p: Column, q: Column) -> Column:
        return F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4
    # Lines cut off corners b and d, or a and c.
    off_b_d = (F.col("a") >= z) == (middle >= z)
    saddle = F.when(off_b_d, F.array(piece(F.col("bottom"), F.col("right")), piece(F.col("top"), F.col("left")))).otherwise(
        F.array(piece(F.col("bottom"), F.col("left")), piece(F.col("right"), F.col("top"))))
    pieces = F.when(F.size("crossed") == 4, saddle).when(
        F.size("crossed") == 2, F.array(piece(F.get("crossed", F.lit(0)), F.get("crossed", F.lit(1)))))
    return cells.select(*by, "level", "i", "j", F.posexplode(pieces).alias("part", "s")).select(
        *by, "level", "i", "j", "part", "s.*")


def shaded_cells(grid: DataFrame, levels: DataFrame, by: Sequence[str] = ("x_var", "y_var")) -> DataFrame:
    """``(*by, i, j, x, y, shade)``: the highest level each grid point reaches; points below the lowest are left out."""
    by = list(by)
    reached = grid.join(levels.select(*by, "level", F.col("density").alias("__z")), by).where("density >= __z")
    return reached.groupBy(*by, "i", "j", "x", "y").agg(F.max("level").alias("shade"))


def pair_view(sample: DataFrame, names: dict[str, str] = PAIR_DISPLAY_NAMES) -> DataFrame:
    """The pair sample with the four variables under their display names (plus the pass class)."""
    return sample.select(*[F.col(c).alias(n) for c, n in names.items()], "qualitative_pass")
