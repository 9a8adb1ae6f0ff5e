"""What each of five filters removes, in every order, with a counting-Bloom duplicate prepass.

1. *Facts.*  One scan of the whole texts gives a narrow row per document: its
   part, a mask of the filters A to D that it fails, a 64-bit hash and the
   SHA-256 of its text.  The row is written once; no text enters a shuffle.
2. *Sketches.*  Every task counts its hashes in counting Bloom sketches, one
   for each segment of the hash space, and the sketches of all tasks are added
   up by segment.  The number of segments grows with the table, so the share of
   texts that are wrongly held for repeats does not.  A counter adds at most
   two for a text and chunk, so a text that a third of all rows share weighs no
   more than one entry per chunk.
3. *Prepass.*  A text with a counter below two is the only one of its kind in the
   table: it cannot fail E and is cleared where it lies.  The counters are
   reduced to one bit (two or more) and broadcast, ``GROUP_BYTES`` of segments at
   a time, whatever their number; each group looks at the rows of its own
   segments.
4. *Exact minima.*  Only possible repeats are shuffled: the smallest id of each
   full text, by SHA-256, and rows with a larger id fail E.
5. *Counts.*  Rows are counted by part, mask and label.  Everything the audit
   reports is a sum over the 32 masks of a part, so the 600 steps of the 120
   orders are read off 32 counts.

A null text is the empty text, a null part the empty string.  Rows without an
id have no label, cannot fail E and make no other row fail it.  Rows that
repeat an id are rows of their own; a row equal to one with the same id does
not fail E.  Of several labels of an id, one that says 1 counts.  Extra columns
are never read.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqyield.llm.common import WHITE, discard, stored, whole

FILTERS = "ABCDE"
#: Counters for each text, hashes of a text, and counters of a segment.
PER_TEXT, HASHES, SEGMENT = 16, 3, 1 << 18
#: Bytes of bits that are broadcast at a time.
GROUP_BYTES = 1 << 26
#: Hashes that a task adds up before it sends a sketch.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def failures(text: Column) -> Column:
    """Mask of the filters A (1), B (2), C (4) and D (8) that a text fails."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, F.lit(100) * distinct < F.lit(80) * n,
             F.lit(100) * capitals.cast("long") > F.lit(10) * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, hash, digest) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       whole(text_col).alias("text"))
    return rows.select("id", "part", failures(F.col("text")).alias("mask"), F.xxhash64("text").alias("hash"),
                       F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def segment_of(hash_col: str, segments: int) -> Column:
    return F.pmod(F.col(hash_col), F.lit(segments))


def slots(hashes: np.ndarray) -> np.ndarray:
    """The ``HASHES`` counters of each hash within its segment, a row per hash."""
    mixed = (hashes.view(np.uint64) ^ (hashes.view(np.uint64) >> np.uint64(29))) * MIX
    bits = np.uint64(SEGMENT.bit_length() - 1)
    return np.stack([(mixed >> (np.uint64(64) - bits * np.uint64(i + 1))) & np.uint64(SEGMENT - 1)
                     for i in range(HASHES)], axis=1).astype(np.uint32)


def partial_sketches(hashes: np.ndarray, segments: int):
    """(segment, counter numbers) of some hashes; a counter stands there as often as it is raised."""
    found, counts = np.unique(hashes, return_counts=True)
    found = np.repeat(found, np.minimum(counts, 2))
    of = np.mod(found, segments)
    order = np.argsort(of, kind="stable")
    found, of = found[order], of[order]
    cuts = np.nonzero(np.diff(of))[0] + 1
    for part, at in zip(np.split(found, cuts), np.split(of, cuts)):
        if len(part):
            yield int(at[0]), slots(part).tobytes()


def sketches(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): which counters of the merged sketch of each segment are two or more."""
    def counted(batches):
        held, n = [], 0

        def sent():
            parts = list(partial_sketches(np.concatenate(held), segments)) if held else []
            for i in range(0, len(parts), 4096):
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s for s, _ in parts[i:i + 4096]], pa.int64()),
                                                  "raised": pa.array([b for _, b in parts[i:i + 4096]], pa.binary())})
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).copy())
            n += batch.num_rows
            if n >= CHUNK:
                yield from sent()
                held, n = [], 0
        yield from sent()

    def merged(table):
        counters = np.zeros(SEGMENT, np.uint8)
        for raised in table.column("raised"):
            more = np.bincount(np.frombuffer(raised.as_buffer(), np.uint32), minlength=SEGMENT)
            counters = np.minimum(counters + np.minimum(more, 2), 2).astype(np.uint8)
        return pa.table({"segment": table.column("segment").slice(0, 1),
                         "bits": pa.array([np.packbits(counters >= 2).tobytes()], pa.binary())})

    return (hashes.mapInArrow(counted, "segment long, raised binary")
            .groupBy("segment").applyInArrow(merged, "segment long, bits binary"))


def possible_repeats(rows: DataFrame, segments: int) -> tuple[DataFrame, list[str]]:
    """``rows`` (with column ``hash``) and whether each may repeat (``maybe``); and the scratch paths.

    A row that is not marked is the only one with its hash.
    """
    spark = rows.sparkSession
    merged, merged_path = stored(sketches(rows.select("hash"), segments), "sketches")
    names, paths = [*rows.columns, "maybe"], []
    at_once = max(1, GROUP_BYTES * 8 // SEGMENT)
    for low in range(0, segments, at_once):
        high = min(low + at_once, segments)
        bits = np.zeros((high - low, SEGMENT // 8), np.uint8)
        for batch in merged.where(F.col("segment").between(low, high - 1)).toArrow().to_batches():
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                bits[s - low] = np.frombuffer(b.as_buffer(), np.uint8)
        sent = spark.sparkContext.broadcast(bits)

        def probe(batches, low=low, sent=sent):
            for batch in batches:
                hashes = batch.column(batch.schema.get_field_index("hash")).to_numpy(zero_copy_only=False)
                at = (np.mod(hashes, segments) - low)[:, None]
                where = slots(hashes)
                on = sent.value[at, where >> 3] >> (7 - (where & 7)).astype(np.uint8) & 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(on.all(axis=1))], names=names)

        mine = rows.where(segment_of("hash", segments).between(low, high - 1))
        schema = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("maybe", "boolean")])
        paths.append(stored(mine.mapInArrow(probe, schema), "probed")[1])
        sent.destroy()
    discard(spark, merged_path)
    return spark.read.parquet(*paths), paths


def failed_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                 per_text: int = PER_TEXT) -> DataFrame:
    """(id, part, mask, n): rows of ``docs`` counted by id, part and the filters A (1) to E (16) they fail."""
    rows, _ = stored(facts(docs, id_col, text_col, part_col), "facts")
    segments = max(1, -(-rows.count() * per_text // SEGMENT))
    probed, _ = possible_repeats(rows, segments)
    repeats = F.col("maybe") & F.col("id").isNotNull()
    suspects = probed.where(repeats).groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = probed.where(repeats).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    late = suspects.join(first, ["id", "digest"], "left").select(
        "id", "part", (F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)).alias("mask"), "n")
    cleared = probed.where(~repeats).select("id", "part", "mask", F.lit(1).cast("long").alias("n"))
    return late.unionByName(cleared).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those labelled quality 1 and toxic 1."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return masks.join(said, "id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def with_steps(parts: DataFrame) -> DataFrame:
    """Each row with the 600 steps: order, number, bit of the step's filter, bits of those before."""
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    bit = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])

    def bits(letters: Column) -> Column:
        return F.transform(letters, lambda x: F.get(bit, F.ascii(x) - ord(FILTERS[0])))
    steps = (parts.withColumn("filter_order", F.explode(orders))
             .withColumn("bits", bits(F.array(*[F.substring("filter_order", i + 1, 1) for i in range(len(FILTERS))])))
             .select("*", F.posexplode("bits").alias("at", "bit")))
    earlier = F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda a, x: a + x)
    return steps.withColumns({"step": F.col("at") + 1, "before": earlier})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step, with what the step keeps and removes."""
    counts = mask_counts(failed_masks(docs, id_col, text_col, part_col), labels, id_col)
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    by_part = counts.groupBy("part").agg(cells.alias("cells"))
    by_part = with_steps(by_part)
    bit, before = F.col("bit"), F.col("before")

    def total(value, which) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"),
                           lambda acc, c: acc + F.when(which(c["mask"]), value(c)).otherwise(0).cast("long"))

    def fails(m):
        return m.bitwiseAND(bit) != 0

    def gone(m):
        return m.bitwiseAND(before) != 0

    def orders_first(c):
        """In how many of the orders a row meets this filter before the others it fails."""
        return c["n"] * F.get(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(c["mask"]) - 1)

    removed = lambda m: fails(m) & ~gone(m)
    return by_part.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(orders_first, fails).alias("shapley"))
