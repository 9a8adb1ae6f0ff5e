"""Nearest vectors by inner product, with vantage-point trees per shard.

Inner product is made a distance: with a shard's largest norm M, every vector
gets the extra component sqrt(M^2 - |x|^2) and a query the component 0, so
that the Euclidean distance falls as the inner product rises.

1. Equal vectors hash to the same shard, and only the ``k + 1`` smallest ids
   of equal vectors go on: ties go to the smaller id, so no other can be among
   the ``k`` nearest.  This is exact and removes a hot vector's weight.
2. A bounded sample of vectors gives each query a floor, its (k+1)-th best
   inner product there, which the true one cannot be below.
3. Shards meet query blocks under an explicit (shard, block) key.  There a
   vantage-point tree is built over the shard; the triangle inequality bounds
   each query's distance to every leaf from below.  The leaf with the least
   bound is searched first, then all others with bound * ``factor`` <= the
   distance of the (k+1)-th best found.  Factor 1 is exact search; above 1
   leaves are skipped earlier.
4. Per query, the shards' results are merged by one shuffle.

Scores are the correctly rounded sums of the exact products in double
precision.  Vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length
than the query's are no candidates.  Rows that repeat an id are rows of their
own.  Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqyield.llm.common import hash_sample, stored

K = 20
#: Pruning factor; measured recall with it is in the README.
FACTOR = 1.1
SHARD, BLOCK = 1 << 15, 1 << 13
LEAF = 256
SAMPLE = 2048


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(rows, -1)


class Tree:
    """Vantage-point tree over the rows of ``x``; leaves hold row numbers."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = (x * x).sum(axis=1)
        self.most = norms.max()
        self.x, extra = x, np.sqrt(np.maximum(self.most - norms, 0))
        self.vantage, self.radius, self.children, self.leaves = [], [], [], []
        self._build(np.column_stack([x, extra]), np.arange(len(x)), leaf)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Build below; the node's number (leaves are numbered -1, -2, ...)."""
        if len(rows) > leaf:
            own = points[rows]
            far = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()
            distance = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
            radius = np.median(distance)
            inside = distance <= radius
            if not inside.all():
                node = len(self.vantage)
                self.vantage.append(own[far])
                self.radius.append(radius)
                self.children.append(None)
                self.children[node] = (self._build(points, rows[inside], leaf),
                                       self._build(points, rows[~inside], leaf))
                return node
        self.leaves.append(rows)
        return -len(self.leaves)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least distance (queries x leaves) that the triangle inequality allows."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not self.vantage:
            return out
        vantage = np.array(self.vantage)
        squared = ((queries * queries).sum(axis=1)[:, None] + (vantage * vantage).sum(axis=1)
                   - 2 * queries @ vantage[:, :-1].T)
        distance = np.sqrt(np.maximum(squared, 0))
        todo = [(0, np.zeros(len(queries)))]
        while todo:
            node, bound = todo.pop()
            if node < 0:
                out[:, -node - 1] = bound
                continue
            beyond = distance[:, node] - self.radius[node]
            todo += [(self.children[node][0], np.maximum(bound, beyond)),
                     (self.children[node][1], np.maximum(bound, -beyond))]
        return out

    def nearest(self, queries: np.ndarray, floor: np.ndarray, keep: int, at: int,
                factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the ``keep`` best of each query; leaves are pruned by the ``at``-th best."""
        scores = np.full((len(queries), keep), -np.inf)
        rows = np.full((len(queries), keep), -1)
        bounds, norms = self.bounds(queries), (queries * queries).sum(axis=1)
        first = bounds.argmin(axis=1)

        def visit(leaf: int, which: np.ndarray) -> None:
            members = self.leaves[leaf]
            all_scores = np.hstack([scores[which], queries[which] @ self.x[members].T])
            all_rows = np.hstack([rows[which], np.broadcast_to(members, (len(which), len(members)))])
            best = np.argpartition(-all_scores, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_scores, best, 1), axis=1), 1)
            scores[which] = np.take_along_axis(all_scores, best, 1)
            rows[which] = np.take_along_axis(all_rows, best, 1)

        for leaf in np.unique(first):
            visit(leaf, np.nonzero(first == leaf)[0])
        for leaf in range(len(self.leaves)):
            reached = np.maximum(scores[:, at - 1], floor)
            # A query whose floor is unknown has reached -inf, at infinite distance.
            distance = np.sqrt(np.maximum(norms + self.most - 2 * reached, 0)) + 1e-9
            which = np.nonzero((bounds[:, leaf] * factor <= distance) & (first != leaf))[0]
            if len(which):
                visit(leaf, which)
        return scores, rows


def _search_shard(vectors: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    x, ids = _matrix(vectors.column("v"), vectors.num_rows), vectors.column("id").to_numpy()
    row = vectors.column("row").to_numpy()
    q, q_row = _matrix(queries.column("v"), queries.num_rows), queries.column("row").to_numpy()
    order = np.lexsort((row, ids, *x.T[::-1]))
    x, ids, row = x[order], ids[order], row[order]
    starts = np.concatenate([[0], np.nonzero((x[1:] != x[:-1]).any(axis=1))[0] + 1, [len(x)]])
    points = x[starts[:-1]]
    tree, found = Tree(points), []
    for at in range(0, len(q), 1024):
        some = q[at:at + 1024]
        # One vector may be the query's own; a few more settle ties of rounding.
        _, near = tree.nearest(some, queries.column("floor").to_numpy()[at:at + 1024], k + 5, k + 1, factor)
        for i, members in enumerate(near):
            own = []
            for m in members[members >= 0]:
                score = math.fsum((some[i] * points[m]).tolist())
                own += [(-score, int(ids[j]), q_row[at + i]) for j in range(starts[m], starts[m + 1])
                        if row[j] != q_row[at + i]]
            own.sort()
            found += own[:k]
    scores, vec_ids, rows = zip(*found) if found else ((), (), ())
    return pa.table({"row": pa.array(rows, pa.int64()), "vec_id": pa.array(vec_ids, pa.int64()),
                     "score": pa.array([-s for s in scores], pa.float64())})


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    v = F.col("v")
    usable = (F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
              & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows, _ = stored(vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"),
                                    F.col(vector_col).cast("array<double>").alias("v")).where(usable)
                     .withColumn("row", F.monotonically_increasing_id()), "vectors")
    copies = Window.partitionBy("v").orderBy("id", "row")
    points = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    points, _ = stored(points.select("id", "row", "v", "copy"), "points")
    queries = rows.where("is_query").select("id", "row", "v")
    n, n_queries = points.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // block))

    # One copy of equal vectors.
    some = hash_sample(points.where("copy = 1").select("v"), F.col("v"), n, sample)
    known = spark.sparkContext.broadcast([np.array(r[0], np.float64) for r in some.toPandas().itertuples(index=False)])

    def floors(batches):
        by_length: dict[int, np.ndarray] = {}
        for vector in known.value:
            by_length.setdefault(len(vector), []).append(vector)
        by_length = {n: np.array(found).T for n, found in by_length.items()}
        for batch in batches:
            floor = []
            for vector in batch.column(2).to_numpy(zero_copy_only=False):
                scores = vector @ by_length[len(vector)] if len(vector) in by_length else np.zeros(0)
                floor.append(np.partition(scores, -k - 1)[-k - 1] - 1e-9 if len(scores) > k else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.float64())],
                                             names=["id", "row", "v", "floor"])

    asked, _ = stored(queries.mapInArrow(floors, "id long, row long, v array<double>, floor double"), "queries")
    left = points.select("id", "row", "v", F.size("v").alias("n"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("row", "v", "floor", F.size("v").alias("n"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                         F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))

    def meet(vectors_here: pa.Table, queries_here: pa.Table) -> pa.Table:
        if not (vectors_here.num_rows and queries_here.num_rows):
            return pa.table({"row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        return _search_shard(vectors_here, queries_here, k, factor)

    keys = ["n", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "row long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return asked.select("row", F.col("id").alias("query_id")).join(ranked, "row").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
