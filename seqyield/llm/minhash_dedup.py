"""MinHash near-duplicates with b-bit signatures, checked on full sets.

*Signatures.*  A document's set holds the 64-bit hashes of its word shingles.
``BANDS`` x ``ROWS`` hash functions give as many minima; of each only the low
``BITS`` bits are kept.  The bytes of a band are packed in one 64-bit word, so a
signature is ``BANDS`` words, 320 bytes instead of 2,560.

*Candidates.*  Documents with equal sets become one first, by a digest of the
set, so exact copies cost one row each.  Two sets are candidates if a word of
their signatures agrees; at a similarity of 0.85 a pair is missed with odds of
3 in a million.  Each word is grouped with map-side combining and only leaves
links to the least member of its bucket, never pairs; the connected parts of
these links (alternating star steps) hold every candidate pair inside one part.

*Estimate and check.*  A part is cut into sides of about ``SIDE`` shingles, and every
two sides are compared as a tile.  A tile looks at the pairs that share a band, of sizes that allow the
similarity.  Differing bytes are folded into one bit each and counted; the
share m of equal ones is corrected for the collisions of low bits,
J = (m - 2^-b) / (1 - 2^-b), and a pair ``SLACK`` below the wanted similarity is
dropped (five standard errors).  The rest are checked on their full sets,
unless checked links have connected them already.  A tile returns checked links
that connect what belongs together, at most one a document; the stars
of all tiles give the components.  A part of many documents becomes many tiles,
not a larger one.

A null text is the empty text.  Texts without words have the empty set and link
with nothing; texts of fewer words than a shingle have one shingle, their whole
sequence.  Null ids name a component only where it has no other id.  Repeated
rows are documents of their own.  Extra columns are never read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqyield.llm.common import batch_bytes, stored, whole
from seqyield.llm.simhash_dedup import components
from seqyield.operators.prefix import running_totals

WORDS = 3
#: Linked from 85 % on: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bands of a signature, minima of a band, and bits that are kept of each: a band fills 64 bits.
BANDS, ROWS, BITS = 40, 8, 8
#: How far the estimate may stay below the wanted similarity: five standard errors at 0.85 of 320 minima.
SLACK = 0.1
#: Shingles of a tile's side (a document counts ``LEAST`` more), and shingles hashed at a time.
SIDE, LEAST, CHUNK = 1 << 21, 512, 512
#: Sets with more rows than one in so many of the table are few, and broadcast.
HEAVY = 1024

_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    found = text.lower().split()  # bytes: lower-cases A-Z, splits at the ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total * _P1 + hashes[i:len(found) - width + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low bits of the minima of a set, one packed word per band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        some = shingles[i:i + CHUNK]
        np.minimum(least, (_FACTORS[:, None] * some[None, :] + _ADDED[:, None]).min(axis=1), out=least)
    return (least & np.uint64((1 << BITS) - 1)).astype(np.uint8).view("<u8")


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the kept minima of signatures (one a row) agree."""
    differ = a ^ b
    for shift in (4, 2, 1):
        differ |= differ >> np.uint64(shift)
    return BANDS * ROWS - np.bitwise_count(differ & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of signatures."""
    chance = 2.0 ** -BITS
    return (equal_minima(a, b) / (BANDS * ROWS) - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, on full sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text) of each row: the text in UTF-8 and its SHA-256."""
    text = whole(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))


def with_signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_key, n, digest, sig) of each row: size and 128-bit digest of the set, packed signature."""
    def add(batches):
        for batch in batches:
            n, digests, packed = [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_buffer().to_pybytes(), words)
                n.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                packed.append(signature(shingles).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                names=["id", "text_key", "n", "digest", "sig"])

    carried = _texts(docs, id_col, text_col)
    kind = carried.schema["id"].dataType.simpleString()
    return carried.mapInArrow(add, f"id {kind}, text_key binary, n long, digest binary, sig binary")


def band_links(sets: DataFrame) -> DataFrame:
    """Links (a, b), b the least of a bucket, of the sets (v, sig) that share a band."""
    def words(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(sig.reshape(-1))],
                names=["v", "band", "word"])

    bands = sets.select("v", "sig").mapInArrow(words, "v long, band int, word long")
    buckets = bands.groupBy("band", "word").agg(F.min("v").alias("b"), F.max("v").alias("top")).where("b < top").drop("top")
    return bands.join(buckets, ["band", "word"]).where("v <> b").select(F.col("v").alias("a"), "b").distinct()


class _Forest:
    """Connected sets of 0 .. n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[max(i, j)] = min(i, j)


def link_tile(sigs: np.ndarray, sizes: np.ndarray, sets, left: np.ndarray, right: np.ndarray,
              percent: int = PERCENT) -> list[tuple[int, int]]:
    """Checked links between the documents ``left`` and ``right`` of a tile, enough to connect all that links connect.

    ``sets(i)`` gives the full set of document i.
    """
    pairs = []
    step = max(1, (1 << 21) // max(len(right), 1))
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        shared = np.zeros((len(rows), len(right)), bool)
        for band in range(BANDS):
            shared |= sigs[rows, band][:, None] == sigs[right, band][None, :]
        small, large = np.minimum.outer(sizes[rows], sizes[right]), np.maximum.outer(sizes[rows], sizes[right])
        i, j = np.nonzero(shared & (100 * small >= percent * large))
        i, j = rows[i], right[j]
        i, j = i[i != j], j[i != j]
        likely = np.concatenate([estimate(sigs[i[k:k + 65536]], sigs[j[k:k + 65536]])
                                 for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        good = likely >= percent / 100 - SLACK
        pairs.append((likely[good], i[good], j[good]))
    likely, i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0),) * 3
    forest, found = _Forest(len(sigs)), []
    for k in np.argsort(-likely, kind="stable"):
        a, b = forest.find(int(i[k])), forest.find(int(j[k]))
        if a != b and similar(sets(int(i[k])), sets(int(j[k])), percent):
            forest.join(a, b)
            found.append((int(i[k]), int(j[k])))
    return found


def members(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(part, side, v, n, sig, text) of the sets ``v`` that have a candidate; ``size`` shingles make a side."""
    wanted = sets.join(parts, "v").select("root", "v", "n", "sig", F.col("order.id").alias("id"), "text_key")
    dealt = running_totals(wanted, ["v"], {"upto": F.col("n") + LEAST}, by=["root"])
    dealt = dealt.withColumn("side", F.floor((F.col("upto") - 1) / size).cast("long"))
    # Rows that repeat id and text leave their tasks once.
    texts = _texts(docs, id_col, text_col).groupBy("id", "text_key").agg(F.first("text").alias("text"))
    return dealt.join(texts, dealt["id"].eqNullSafe(texts["id"]) & (dealt["text_key"] == texts["text_key"])).select(
        F.col("root").alias("part"), "side", "v", "n", "sig", "text")


def checked_links(found: DataFrame, words: int, percent: int) -> DataFrame:
    """Checked links (a, b) of the members (part, side, v, n, sig, text) of each part.

    Every two sides of a part, and each with itself, are a tile.
    """
    sides = found.groupBy("part").agg((F.max("side") + 1).alias("sides"))
    # Side s of k takes part in k tiles: (s, t) for t >= s and (t, s) for t < s.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    dealt = found.join(sides, "part").withColumn("other", other).select(
        "part", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        "side", "v", "n", "sig", "text")

    def linked(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        v, side = table.column("v").to_numpy(), table.column("side").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(-1, BANDS)
        texts, known = table.column("text"), {}

        def full(i):
            if i not in known:
                known[i] = shingle_set(texts[i].as_py(), words)
            return known[i]
        links = link_tile(sigs, table.column("n").to_numpy(), full, np.nonzero(side == low)[0],
                          np.nonzero(side == high)[0], percent)
        return pa.table({"a": pa.array([v[i] for i, _ in links], pa.int64()),
                         "b": pa.array([v[j] for _, j in links], pa.int64())})

    return dealt.groupBy("part", "low", "high").applyInArrow(linked, "a long, b long")


def _order(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                           percent: int = PERCENT, side: int = SIDE) -> DataFrame:
    """A row per row of ``docs``: id_col, n_shingles, component_id, kept (its id names its component)."""
    with batch_bytes(docs.sparkSession, 4 << 20):
        narrow, _ = stored(with_signatures(docs, id_col, text_col, words), "signatures")
    # Of equal sets the row with the least id stands for all.
    least = F.min(F.struct("order", "text_key", "n", "sig"))
    sets, _ = stored(narrow.where(F.col("n") > 0).withColumn("order", _order("id")).groupBy("digest").agg(
        least.alias("s"), F.count(F.lit(1)).alias("rows")).select(
        "digest", "rows", "s.*", F.monotonically_increasing_id().alias("v")), "sets")
    parts, _ = stored(components(band_links(sets)), "candidate-parts")
    roots = components(checked_links(members(docs, id_col, text_col, sets, parts, side), words, percent))
    rooted, _ = stored(sets.join(roots, "v", "left").select(
        "digest", "rows", "order", F.coalesce("root", "v").alias("root")), "rooted-sets")
    first = rooted.groupBy("root").agg(F.min("order").alias("first"))
    named, _ = stored(rooted.join(first, "root").select("digest", "rows", "first"), "named-sets")
    # Sets that many rows share are few and broadcast; no other has more rows than one in HEAVY.
    heavy = F.col("rows") > narrow.count() // HEAVY
    marked = narrow.select("id", "n", "digest").join(
        F.broadcast(named.where(heavy).select("digest", "first")), "digest", "left")
    alone = marked.where(F.col("n") == 0).select("id", "n", _order("id").alias("first"))
    light = marked.where((F.col("n") > 0) & F.col("first").isNull()).drop("first").join(
        named.where(~heavy).select("digest", "first"), "digest").select("id", "n", "first")
    every = marked.where(F.col("first").isNotNull()).select("id", "n", "first").unionByName(light).unionByName(alone)
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"))


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                           percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns."""
    stays = near_duplicate_classes(docs, id_col, text_col, words, percent).where("kept").select(
        F.col(id_col).alias("__stays")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(F.col("__stays")), "left_semi")
