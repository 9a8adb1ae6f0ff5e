"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source; sources in code-point order (null last) weigh
5, 2, 1, repeating.  The targets are the level filling of ``share`` times all
sizes: a source gets ``level * weight`` words, but at most ``cap`` times its
own.  The level is found by the step "reshare the excess by weight among the
sources not yet at their cap" until no source is above, each step one
aggregate over the table of sources.

A source's repetition rate is target / size.  Every document is emitted
floor(rate) times, plus once more if the number in [0, 1) that MD5 makes of
the seed, the id and the text's digest is below the rate's fraction, so reruns agree and no
document has more than ceil(cap) copies.

Null sources are one source.  A null or empty text has size 0; a source of
such texts has target and rate 0 and emits nothing.  Rows that repeat an id
and a text draw alike, documents with a null id draw by their text.  An empty
table gives an empty mix.  The input's columns keep their names and values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqyield.llm.common import free_names, id_text, stored, whole

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank): the place of each source in code-point order, null last.

    Sources are range-partitioned and numbered within their partition; the
    partitions' totals, one row each, give what to add.
    """
    dealt, _ = stored(sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
                      .withColumn("part", F.spark_partition_id()), "dealt-sources")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n")).select(
        "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("last", "source")))
    return numbered.join(F.broadcast(totals), F.col("part") == F.col("p")).select(
        "source", "source_size", (F.col("place") + F.col("earlier")).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """(source, source_size) of each source to (source, source_size, weight, target, rate)."""
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked, _ = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    at_cap, level = F.lit(False), (0, 1)
    capped_words, open_weight, seen = 0, None, -1
    while True:
        n, held, free = ranked.agg(
            F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0))).head()
        if n == seen or not free:
            break
        seen, capped_words, open_weight = n, cap * held, free
        # A source is at its cap when cap * size <= weight * (share * total - capped) / open weight.
        at_cap = (F.lit(float(cap)) * F.col("source_size") * F.lit(float(open_weight))
                  <= F.col("weight") * F.lit(share * total - capped_words))
    amount = F.lit(share * total - capped_words)
    target = F.when(at_cap, F.lit(float(cap)) * F.col("source_size")).otherwise(
        F.col("weight") * amount / F.lit(float(open_weight or 1)))
    return ranked.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed, id and text only."""
    key = F.concat_ws(":", F.lit(seed), id_text(id_col), F.md5(whole(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, rate, copies."""
    size, source, count, targets = free_names(docs, ["__size", "__source", "__draw", "mix"])
    wide = docs.withColumns({size: word_count(text_col)})
    sizes, _ = stored(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(word_count(text_col)).alias("source_size")), "source-sizes")
    rates = source_targets(sizes, weights, share, cap).select(
        F.col("source").alias(source), F.struct("source_size", "target", "rate").alias(count))
    # The table of sources has one row each; the join is left to Spark's size check.
    joined = wide.join(rates, F.col(source_col).eqNullSafe(F.col(source)))
    rate = F.col(f"{count}.rate")
    copies = F.floor(rate) + F.when(draw(id_col, text_col, seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.col(size).alias("size"), F.col(f"{count}.source_size").alias("source_size"),
                 F.col(f"{count}.target").alias("target"), rate.alias("rate"),
                 copies.cast("long").alias("copies")).alias(targets))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document of ``docs`` as many times as the mix takes it."""
    with_copies = mixed(docs, **options)
    name = with_copies.columns[-1]
    times = F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies").cast("int")))
    return with_copies.where(F.col(f"{name}.copies") > 0).select(
        *[F.col(f"`{c}`") for c in docs.columns], times.alias(name)).drop(name)
