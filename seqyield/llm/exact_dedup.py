"""Exact de-duplication with a heavy-hitter split.

1. One scan of the texts gives a narrow table (id, digest, length), written
   once under the checkpoint folder.
2. Misra-Gries: each task keeps ``k`` counters over its digests; the counters
   of all tasks are summed by digest, and the candidates are the sums above
   N/(k+1) of the N rows.  The sums add up to N at most, so there are at most
   ``k``; and they fall short by N/(k+1) at most, so a digest with more than
   2N/(k+1) rows always is one.
3. The candidates (at most ``k`` digests) are counted exactly with map-side
   combining.  Those above N/(k+1) rows are *heavy*; their winners, at most
   ``k`` rows, are broadcast, and their rows never enter a shuffle.
4. All other digests go through one ordinary shuffle; no group there has more
   than 2N/(k+1) rows.

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; null counts as the empty text, and all empty texts are
one group.  Of equal texts the row with the most code points, then the
smallest id, stays; a null id is larger than any other.  Rows that repeat an id and a text are separate rows, of
which one is kept.  Extra columns are never read here.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqyield.llm.common import WHITE, free_names, stored, whole

#: Counters of a Misra-Gries summary, and the most rows that are broadcast.
COUNTERS = 1024


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(whole(text), WHITE, "").cast("binary"), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], k: int) -> dict[bytes, int]:
    """Misra-Gries summary with ``k`` counters of the first column of ``batches``."""
    counters: dict[bytes, int] = {}
    for batch in batches:
        found = pc.value_counts(batch.column(0))
        for digest, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
            counters[digest] = counters.get(digest, 0) + n
        if len(counters) > k:
            cut = sorted(counters.values(), reverse=True)[k]
            counters = {d: n - cut for d, n in counters.items() if n > cut}
    return counters


def heavy_candidates(digests: DataFrame, rows: int, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` digests (column ``digest``) of ``rows`` in all, holding every one with over 2N/(k+1) rows."""
    def summaries(batches):
        counters = misra_gries(batches, k)
        if counters:
            yield pa.RecordBatch.from_pydict(
                {"digest": pa.array(list(counters), pa.binary()), "n": pa.array(list(counters.values()), pa.int64())})

    return (digests.mapInArrow(summaries, "digest binary, n long")
            .groupBy("digest").agg(F.sum("n").alias("n"))
            .where(F.col("n") > rows // (k + 1)).select("digest"))


def heavy_winners(narrow: DataFrame, k: int = COUNTERS) -> tuple[DataFrame, str]:
    """Verified heavy digests of ``narrow`` (digest, order): digest, size, best; and their scratch path."""
    rows = narrow.count()
    candidates = heavy_candidates(narrow.select("digest"), rows, k)
    verified = (narrow.join(F.broadcast(candidates), "digest")
                .groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("order").alias("best"))
                .where(F.col("size") > rows // (k + 1)))
    return stored(verified, "heavy-digests")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, digest, order) of each row; ``order`` sorts the row that stays first and is unique."""
    return stored(docs.select(
        F.col(id_col).alias("id"), text_digest(text_col).alias("digest"),
        F.struct((-F.char_length(whole(text_col))).alias("longest"), F.col(id_col).isNull().alias("no_id"),
                 F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("order")), "digests")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     k: int = COUNTERS) -> DataFrame:
    """A row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256."""
    narrow, _ = _narrow(docs, id_col, text_col)
    heavy, _ = heavy_winners(narrow, k)
    marked = narrow.join(F.broadcast(heavy), "digest", "left")
    light = marked.where(F.col("size").isNull()).drop("size", "best")
    # Counts are combined before the shuffle; the join streams the rows of a group past one row of sums.
    groups = light.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("order").alias("best"))
    light = light.join(groups, "digest").select(*marked.columns)
    both = marked.where(F.col("size").isNotNull()).unionByName(light)
    return both.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("order.row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows of heavy groups other than the winner's are dropped map-side, before
    any text is shuffled; the rest is reduced by digest.  Rows that share
    group, length and id are ordered by their text.
    """
    digest, size, best, rank, no_id, length = free_names(
        docs, ["__digest", "__size", "__best", "__rank", "__no_id", "__longest"])
    narrow, _ = _narrow(docs, id_col, text_col)
    heavy, _ = heavy_winners(narrow, k)
    heavy = heavy.select(F.col("digest").alias(digest), F.col("size").alias(size), F.col("best.id").alias(best))
    order = [F.desc(length), no_id, F.col(id_col), whole(text_col)]
    first = Window.partitionBy(digest).orderBy(*order)
    marked = (docs.withColumns({digest: text_digest(text_col), length: F.char_length(whole(text_col)),
                                no_id: F.col(id_col).isNull()})
              .join(F.broadcast(heavy), digest, "left")
              .where(F.col(size).isNull() | F.col(best).eqNullSafe(F.col(id_col))))
    return marked.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(
        *[F.col(f"`{c}`") for c in docs.columns])
