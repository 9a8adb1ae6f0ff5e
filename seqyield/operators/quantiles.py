"""Exact quantiles with linear interpolation, computed without one big group.

The column is reduced to distinct values with counts (map-side combine: a hot
value costs one entry), the counts are summed in order by
:func:`running_totals`, and only the one or two distinct values around each
requested rank are kept.  The same plan runs at every size.

Interpolation is ``lo + (hi - lo) * (h - floor(h))`` with ``h = (n - 1) * p``,
the same arithmetic as pandas' default and SQL ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqyield.functions.expr import nan_to_null
from seqyield.operators.prefix import running_totals


def exact_quantiles(df: DataFrame, col: str | Column, probs: Sequence[float],
                    by: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(*by, p, q)``: exact quantile ``q`` of ``col`` at each probability ``p``.

    NULL and NaN are skipped; a group without values yields no rows.
    """
    by = list(by or [])
    c = F.col(col) if isinstance(col, str) else col
    data = df.select(*by, nan_to_null(c.cast("double")).alias("__v")).where(F.col("__v").isNotNull())
    # -0.0 and 0.0 are one value.
    hist = data.groupBy(*by, (F.col("__v") + F.lit(0.0)).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    pref = running_totals(hist, ["__v"], {"__cum": "__n"}, by=by)
    if by:
        totals = pref.groupBy(*[F.col(b).alias(f"__t_{b}") for b in by]).agg(F.sum("__n").alias("__total"))
        rows = pref.join(totals, [pref[b].eqNullSafe(F.col(f"__t_{b}")) for b in by])
    else:
        rows = pref.withColumn("__total", pref.agg(F.sum("__n")).scalar())
    # Each distinct value checks the requested ranks in place (a literal array
    # of targets), so no row is paired with anything: it keeps the targets
    # whose lower or upper rank falls inside its run of equal values.
    start = F.col("__cum") - F.col("__n")
    targets = F.array(*[F.lit(float(p)) for p in probs])

    def info(p):
        h = (F.col("__total") - 1).cast("double") * p
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        return F.struct(p.alias("p"), (h - F.floor(h)).alias("frac"),
                        ((start <= lo) & (lo < F.col("__cum"))).alias("is_lo"),
                        ((start <= hi) & (hi < F.col("__cum"))).alias("is_hi"))
    hits = rows.select(*by, "__v", F.explode(F.filter(F.transform(targets, info),
                                                      lambda t: t["is_lo"] | t["is_hi"])).alias("t"))
    agg = hits.groupBy(*by, F.col("t.p").alias("p"), F.col("t.frac").alias("__frac")).agg(
        F.max(F.when(F.col("t.is_lo"), F.col("__v"))).alias("__vlo"),
        F.max(F.when(F.col("t.is_hi"), F.col("__v"))).alias("__vhi"))
    return agg.select(*by, "p", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac")).alias("q"))


def quantile_values(df: DataFrame, col: str | Column, probs: Sequence[float]) -> list[float | None]:
    """Driver-side scalars for the ungrouped case (at most ``len(probs)`` rows come back)."""
    found = {float(r["p"]): r["q"] for r in exact_quantiles(df, col, probs).collect()}
    return [found.get(float(p)) for p in probs]
