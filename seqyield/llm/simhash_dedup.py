"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints come from whole texts, one Arrow batch at a time.  Equal
fingerprints are one point from then on, so exact copies cost one row each.

*Shards.*  A vantage-point tree is fitted on a bounded sample of the distinct
fingerprints (``SAMPLE``) and sent to the tasks.  A node sends a point within
``radius`` of its vantage point inside, any other outside; by the triangle
inequality a partner of an inside point is at most ``bits`` farther away, so
outside points within ``radius + bits`` are queried against the inside shard
too: they go to both.  Every linked pair therefore meets in a shard.

*Inside a shard* the same split goes on until a block is small; there all
Hamming distances are computed exactly, and every connected set of the block
leaves as one star (point, smallest point), never as all its pairs.

*Components* of the stars are found with alternating large-star and small-star
steps, each one written under the checkpoint folder, until nothing changes.

A null text is the empty text; texts without words have fingerprint zero,
which links like any other; texts of fewer words than a shingle hash their
whole word sequence.  Null ids never name a component unless it has no other
id.  Repeated rows are documents of their own.  Empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.llm.common import discard, free_names, hash_sample, stored, whole

WORDS = 3
BITS = 2
SEED = 42
#: Distinct fingerprints the shard tree is fitted on, at most.
SAMPLE = 1 << 14
#: Points a shard aims at, and points of a block whose distances are all computed.
SHARD, BLOCK = 4096, 256


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text over word shingles, repeats included."""
    found = text.lower().split()  # bytes: lower-cases A-Z, splits at the ASCII white space
    if not found:
        return 0
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start, last = end - size, end[words - 1:]
    if not len(last):
        start, last = start[:1], end[-1:]
    counts, total = np.zeros(64, np.int64), len(last)
    for at in range(0, total, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in
                           zip(start[at:at + (1 << 16)].tolist(), last[at:at + (1 << 16)].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint",
                      words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each text as a long (the unsigned bits)."""
    raw, = free_names(docs, ["__raw"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    carried = docs.withColumn(raw, whole(text_col).cast("binary"))

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=schema.names)

    return carried.mapInArrow(add, schema)


def _distance(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int64)


def _best_split(points: np.ndarray, bits: int, tries: int = 4):
    """(vantage, radius) that leaves the least pairs to compare, or None if none shrinks the set."""
    n, best = len(points), None
    for vantage in points[np.linspace(0, n - 1, tries).astype(int)]:
        upto = np.cumsum(np.bincount(_distance(points, vantage), minlength=65)[:65])
        inside = upto[np.minimum(np.arange(65) + bits, 64)]
        cost = inside.astype(float) ** 2 + (n - upto).astype(float) ** 2
        cost[(inside >= 0.95 * n) | (upto <= 0.05 * n)] = np.inf
        radius = int(cost.argmin())
        if np.isfinite(cost[radius]) and (best is None or cost[radius] < best[0]):
            best = cost[radius], vantage, radius
    return best and best[1:]


def fit_tree(sample: np.ndarray, bits: int, leaf: int) -> list[tuple]:
    """Nodes (vantage, radius, inside node, outside node); a leaf is (None, shard, 0, 0)."""
    nodes, todo, shards = [None], [(0, sample)], 0
    while todo:
        at, points = todo.pop()
        split = _best_split(points, bits) if len(points) > leaf else None
        if split is None:
            nodes[at] = (None, shards, 0, 0)
            shards += 1
            continue
        distance = _distance(points, split[0])
        nodes[at] = (*split, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), points[distance <= split[1] + bits]), (len(nodes) + 1, points[distance > split[1]])]
        nodes += [None, None]
    return nodes


def assign(points: np.ndarray, nodes: list[tuple], bits: int):
    """Yield (shard, its points); boundary points go to both sides."""
    todo = [(0, points)]
    while todo:
        at, some = todo.pop()
        vantage, radius, inside, outside = nodes[at]
        if not len(some):
            continue
        if vantage is None:
            yield radius, some
            continue
        distance = _distance(some, vantage)
        todo += [(inside, some[distance <= radius + bits]), (outside, some[distance > radius])]


def _stars(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of one block as stars: each linked point with the smallest of its connected set."""
    points = np.sort(points)
    n = len(points)
    label = np.arange(n)
    step = max(1, (1 << 22) // max(n, 1))
    near = [np.nonzero(np.bitwise_count(points[i:i + step, None] ^ points[None, :]) <= bits) for i in range(0, n, step)]
    rows = np.concatenate([r + i for (r, _), i in zip(near, range(0, n, step))]) if near else label
    cols = np.concatenate([c for _, c in near]) if near else label
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(n)
    return points[own], points[label[own]]


def link_shard(points: np.ndarray, bits: int = BITS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Stars of all points of a shard at ``bits`` or fewer differing bits."""
    todo, found = [np.unique(points)], []
    while todo:
        some = todo.pop()
        split = _best_split(some, bits) if len(some) > block else None
        if split is None:
            found.append(_stars(some, bits))
            continue
        distance = _distance(some, split[0])
        todo += [some[distance <= split[1] + bits], some[distance > split[1]]]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Stars (a, b), b < a as unsigned, linking the distinct longs of column ``fp``."""
    spark, n = points.sparkSession, points.count()
    some = hash_sample(points.select("fp"), F.col("fp"), n, sample).toPandas()
    fitted = np.unique(some["fp"].to_numpy(np.int64).view(np.uint64))
    nodes = fit_tree(fitted, bits, max(16, round(shard * len(fitted) / max(n, 1))))
    tree = spark.sparkContext.broadcast(nodes)

    def shards(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at, got in assign(values, tree.value, bits):
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(got), at, np.int64)),
                                                  "fp": pa.array(got.view(np.int64))})

    def linked(table):
        a, b = link_shard(table.column("fp").to_numpy().view(np.uint64), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return (points.select("fp").mapInArrow(shards, "shard long, fp long")
            .groupBy("shard").applyInArrow(linked, "a long, b long"))


def _smallest_neighbours(edges: DataFrame, larger_too: bool) -> DataFrame:
    """(vertex, least): the smallest of each vertex and its (smaller, or all) neighbours."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
    if larger_too:
        both = both.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    return both.groupBy("v").agg(F.min("w").alias("low")).select("v", F.least("v", "low").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b): the smallest vertex of its component.

    Large-star and small-star in turn.  Only counts and a checksum come to the driver.
    """
    spark = edges.sparkSession

    def tidy(e):
        return (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())

    def seal(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    now, path = stored(tidy(edges), "links")
    sealed = seal(now)
    while True:
        low = _smallest_neighbours(now, larger_too=True)
        # Every larger neighbour of v hangs on v's least.
        turned = (now.select(F.col("a").alias("x"), F.col("b").alias("v"))
                  .unionByName(now.select(F.col("b").alias("x"), F.col("a").alias("v"))).where("x > v"))
        large = tidy(turned.join(low, "v").select(F.col("x").alias("a"), F.col("least").alias("b")))
        large, large_path = stored(large, "links")
        low = _smallest_neighbours(large, larger_too=False)
        # Every smaller neighbour of v, and v, hang on v's least.
        small = large.join(low, large["a"] == low["v"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = tidy(small.unionByName(low.select(F.col("v").alias("a"), F.col("least").alias("b"))))
        new, new_path = stored(small, "links")
        discard(spark, path, large_path)
        again = seal(new)
        now, path = new, new_path
        if again == sealed:
            break
        sealed = again
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")
    return roots.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def classes(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, order) of each fingerprint to (fp, first): the smallest ``order`` reachable."""
    roots = components(links(points.select("fp"), bits))
    rooted = points.join(roots, points["fp"] == roots["v"], "left").select(
        "fp", "order", F.coalesce("root", "fp").alias("root"))
    rooted, _ = stored(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("order").alias("first"))
    return rooted.join(first, "root").select("fp", "first")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           words: int = WORDS, bits: int = BITS) -> DataFrame:
    """A row per row of ``docs``: id_col, fingerprint (16 hex digits), component_id."""
    narrow, _ = stored(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                         "text", "fp", words).select("id", "fp"), "fingerprints")
    points, _ = stored(narrow.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("order")), "points")
    first = classes(points, bits)
    return narrow.join(first, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"))


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id, with all its columns."""
    fp, row = free_names(docs, ["__fp", "__row"])
    kept, _ = stored(with_fingerprints(docs, text_col, fp, words)
                     .withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    points, _ = stored(kept.groupBy(F.col(fp).alias("fp")).agg(F.min(F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("order")),
        "points")
    stays = classes(points, bits).select(F.col("first.row").alias(row)).distinct()
    return kept.join(stays, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
