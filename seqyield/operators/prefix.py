"""Ordered running totals without a global sort in one task.

1. Rows are range-partitioned once on the full ordering key.  Spark samples
   the composite key, so one time value holding a third of the rows is still
   cut by the later keys.
2. Every partition is sorted where it lies and summed in Arrow batches with a
   carried state of one number per sum: no second shuffle, and memory does not
   depend on the number of rows.  The result is written once under the
   checkpoint folder, which fixes every row's bucket.
3. The totals of each (bucket, group) give an exclusive offset.  Groups are
   contiguous in the order, so only the first group of a bucket can continue
   from an earlier one: at most one offset row per bucket, which is broadcast.

The same plan runs at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.session import materialize


def _as_col(v: str | Column | int | float) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(v)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it (NULL equals NULL)."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))))


def _summed(batches, measures: list[str], by: list[str], schema_names: list[str]):
    """Append the task number and inclusive running sums to sorted batches."""
    bucket = TaskContext.get().partitionId()
    carry, last = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, bool)
        keys = [batch.column(batch.schema.get_field_index(k)) for k in by]
        for k in keys:
            starts[1:] |= _changes(k)
        first = tuple(k[0].as_py() for k in keys)
        if last is not None and first != last:
            carry = None
        group = np.cumsum(starts)
        at = np.concatenate([[0], np.nonzero(starts)[0]])
        sums = []
        for i, m in enumerate(measures):
            v = np.asarray(batch.column(batch.schema.get_field_index(m)))
            if v.dtype.kind == "f":
                # Every group starts anew: a large, infinite or NaN sum must not reach the next one.
                run = np.concatenate([np.cumsum(x) for x in np.split(v, at[1:])])
            else:
                run = np.cumsum(v)
                run -= (run[at] - v[at])[group]
            if carry is not None:
                run[group == 0] += carry[i]
            sums.append(run)
        carry, last = [s[-1] for s in sums], tuple(k[n - 1].as_py() for k in keys)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, bucket, np.int32)), *map(pa.array, sums)], names=schema_names)


def running_totals(df: DataFrame, order_by: Sequence[str], sums: Mapping[str, str | Column | int],
                   by: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Append one inclusive running-sum column per entry of ``sums``.

    ``order_by`` must be a total order (add a unique tie-breaker); the sums
    restart for every value of ``by``.  Integer measures give BIGINT sums, all
    others DOUBLE; a NULL measure adds nothing.  Every input row is kept.
    """
    by, order_by, names = list(by or []), list(order_by), list(sums)
    measures = [f"__m_{i}" for i in range(len(names))]
    base = df.select("*", *[_as_col(sums[n]).alias(m) for n, m in zip(names, measures)])
    kinds = ["long" if isinstance(base.schema[m].dataType, T.IntegralType) else "double" for m in measures]
    base = base.withColumns({m: F.coalesce(F.col(m).cast(k), F.lit(0).cast(k)) for m, k in zip(measures, kinds)})
    keys = [*by, *order_by]
    dealt = base.repartitionByRange(n_buckets, *keys) if n_buckets else base.repartitionByRange(*keys)
    local = [f"__s_{i}" for i in range(len(names))]
    schema = T.StructType([*base.schema.fields, T.StructField("__bk", T.IntegerType()),
                           *[T.StructField(s, T.LongType() if k == "long" else T.DoubleType())
                             for s, k in zip(local, kinds)]])
    columns = schema.names
    rows = materialize(dealt.sortWithinPartitions(*keys).mapInArrow(
        lambda batches: _summed(batches, measures, by, columns), schema), "buckets")

    totals = rows.groupBy("__bk", *by).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__bk").alias("__r_bk"), *[F.col(k).alias(f"__r_{k}") for k in by],
                            *[F.sum(m).over(earlier).alias(f"__o_{i}") for i, m in enumerate(measures)])
    # A group that begins in its bucket has nothing before it: at most one row a bucket is left.
    offsets = offsets.where(F.col("__o_0").isNotNull())
    on = [rows["__bk"] == F.col("__r_bk"), *[rows[k].eqNullSafe(F.col(f"__r_{k}")) for k in by]]
    joined = rows.join(F.broadcast(offsets), on, "left")
    return joined.select(*[rows[c] for c in df.columns], *[
        (F.col(s) + F.coalesce(F.col(f"__o_{i}"), F.lit(0).cast(k))).alias(n)
        for i, (n, s, k) in enumerate(zip(names, local, kinds))])
