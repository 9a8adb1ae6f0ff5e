"""Language-model scores from a log-frequency Bloom filter.

*Training* counts every word exactly (one pass, words combined per task, then
one shuffle).  A count ``c`` is stored as its level on a logarithmic scale
(1, 2, 3, ... and from there on steps of a fifth): an n-gram with level ``l``
enters the filter as the keys (n-gram, 1) ... (n-gram, l).  Its count is read
back by probing level 1, 2, ... until a probe fails, so counts are never too
small, and too large only where a probe hits by chance.

*The filter* has ``BITS_PER_TOKEN`` bits or more for every training token,
however many there are, in segments of a fixed size.  All bits of an n-gram lie
in one segment, and a segment never leaves its task: blocks of documents send
their distinct words and pairs of neighbouring tokens there, packed, with how
often they are taught; the segment is built from the taught ones, all are
probed, and their levels go back to the blocks.  Nothing of the filter reaches
the driver or is broadcast.  What travels is in order and written as the gaps
between neighbours, and compressed; the blocks are deleted once they are scored.

*Score*: the probability of a token after another is
``W * c(pair) / c(first) + (1 - W) * p(token)``, ``c(pair)`` being at most
either token's count, and ``p`` the additive estimate (c + 0.5) / (N + 0.5 (V + 1))
on the counts read from the filter.

*Base score*: the same estimate on exact counts.  The most frequent words, at
most ``HEAD`` of at most ``LONGEST`` bytes each, are broadcast with their
counts; all other words are joined by an ordinary shuffle.

Null texts are empty; a null id counts as the empty text in the fold.  Empty
texts consist of the end token.  Repeated rows are scored alike; extra columns
are not read.  Without training rows N = V = 0 and all counts are 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqyield.llm.common import batch_bytes, discard, most_frequent, stored, whole
from seqyield.session import scratch_path

HEAD, LONGEST = 1 << 17, 64
BITS_PER_TOKEN = 6
HASHES = 3
PAIR_WEIGHT = 0.2
SEED = 42
#: Hash of the end token, which no word has but by chance; word hashes are XXH64.
END = 0x9E3779B97F4A7C15
#: Bytes of a batch of texts and of a block of documents, and training tokens a segment aims at.
BATCH_BYTES, BLOCK_BYTES, SEGMENT_TOKENS = 1 << 21, 1 << 23, 1 << 19
#: Bytes of its key an n-gram keeps within its segment.  A segment holds about a million n-grams at
#: every size of the input, so one in a million shares its place with another.
SHORT = 5

# Counts at which the levels 1, 2, ... begin: at first every number, then steps of a fifth.
_steps = [1]
while _steps[-1] < 1 << 62:
    _steps.append(max(_steps[-1] + 1, math.ceil(_steps[-1] * 1.2)))
LEVELS = np.array(_steps, np.int64)
#: What a level stands for: the geometric middle of the counts it begins and ends with.
MEANS = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0))])


def level(counts: np.ndarray) -> np.ndarray:
    """Level of each positive count."""
    return np.searchsorted(LEVELS, counts, side="right")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(3) + mix64(second))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts with A-Z in lower case, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0   # white space at an end leaves an empty word there
    if not some.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        flat = flat.filter(pa.array(some))
    return flat, sizes


def word_hashes(words) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(SEED)), np.uint64, len(words))


class Block:
    """The tokens of some texts as numbers of distinct words; the last number is the end token, after every text."""

    def __init__(self, texts: pa.Array):
        flat, sizes = words_of(texts)
        numbered = flat.dictionary_encode()
        self.words = numbered.dictionary
        self.keys = self.words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        inner = np.ones(len(flat) + len(texts), bool)
        inner[self.starts + sizes] = False
        self.codes = np.full(len(inner), len(self.words), np.int32)
        self.codes[inner] = np.asarray(numbered.indices)
        self.hashes = np.append(word_hashes(self.keys), np.uint64(END))
        self.before = _before(self.codes, self.starts)

    def pairs(self) -> np.ndarray:
        """Key of each token with the one before it; a text's first token follows an end token."""
        return _pairs(self.codes, self.before, self.hashes)


def _before(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the word before each token; that of the end token, the last one's, before each text."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[starts] = codes[-1:]
    return out


def _pairs(codes: np.ndarray, before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[before] * np.uint64(3) + mix64(hashes)[codes])


class Filter:
    """Log-frequency Bloom filter of ``segments`` segments of ``width`` bits (powers of two)."""

    def __init__(self, bits: np.ndarray, segments: int, width: int, hashes: int = HASHES):
        self.bits, self.segments, self.width, self.hashes = bits, segments, width, hashes

    @staticmethod
    def shape(tokens: int) -> tuple[int, int]:
        """(segments, width) for so many training tokens."""
        bits = 1 << max(16, math.ceil(math.log2(max(tokens, 1) * BITS_PER_TOKEN)))
        segments = min(bits >> 13, 1 << max(0, math.ceil(math.log2(max(tokens, 1) / SEGMENT_TOKENS))))
        segments = max(segments, 1)
        return segments, bits // segments

    @staticmethod
    def short(keys: np.ndarray) -> np.ndarray:
        """What tells the keys of one segment apart: their first ``SHORT`` bytes."""
        return keys >> np.uint64(64 - 8 * SHORT)

    @staticmethod
    def bases(short: np.ndarray, at_level: int) -> np.ndarray:
        return mix64(short + np.uint64(at_level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))

    @staticmethod
    def place(bases: np.ndarray, which: int, width: int) -> np.ndarray:
        """The bit within its segment that hash ``which`` gives."""
        step = (bases >> np.uint64(32)) | np.uint64(1)
        return (bases + step * np.uint64(which)) & np.uint64(width - 1)

    @staticmethod
    def segment(keys: np.ndarray, segments: int) -> np.ndarray:
        return (mix64(keys) >> np.uint64(40)) & np.uint64(segments - 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: the number of levels from 1 on that are all found."""
        return self.levels_at(self.short(keys), self.segment(keys, self.segments))

    def levels_at(self, short: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Levels of short keys in their segments."""
        out, left = np.zeros(len(short), np.int64), np.arange(len(short))
        offset = segment * np.uint64(self.width)
        for at in range(1, len(LEVELS)):
            if not len(left):
                break
            bases = self.bases(short[left], at)
            for which in range(self.hashes):   # a key that misses one bit is not looked up further
                bit = offset[left] + self.place(bases, which, self.width)
                hit = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                left, bases = left[hit], bases[hit]
            out[left] = at
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts the levels of the keys stand for; equal keys are probed once."""
        distinct, back = np.unique(keys, return_inverse=True)
        return MEANS[np.minimum(self.levels(distinct), len(MEANS) - 1)][back]


def segment_bits(keys: np.ndarray, counts: np.ndarray, width: int, hashes: int = HASHES) -> np.ndarray:
    """The bytes of one segment holding all ``keys``."""
    return short_bits(Filter.short(keys), counts, width, hashes)


def short_bits(keys: np.ndarray, counts: np.ndarray, width: int, hashes: int = HASHES) -> np.ndarray:
    """The bytes of one segment holding all short keys."""
    if len(keys):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
    out, at = np.zeros(width, bool), 1
    found = np.ones(len(keys), np.int64)
    more = counts > 1
    found[more] = level(counts[more])
    while len(keys):
        bases = Filter.bases(keys, at)
        for which in range(hashes):
            out[Filter.place(bases, which, width)] = True
        more = found > at
        keys, found, at = keys[more], found[more], at + 1
    return np.packbits(out, bitorder="little")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs; the first byte says how many."""
    wide = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w - 1))
    return bytes([wide]) + counts.astype(f"<i{wide}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[1:], f"<i{packed[0]}").astype(np.int64)


def _planes(numbers: np.ndarray, wide: int) -> bytes:
    """The low ``wide`` bytes of numbers, all first bytes first: the high ones of small or sorted numbers compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _from_planes(packed: bytes, wide: int) -> np.ndarray:
    out = np.zeros((len(packed) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(packed, np.uint8).reshape(wide, -1).T
    return out.reshape(-1).view("<u8")


def _gaps(numbers: np.ndarray, wide: int) -> bytes:
    """Numbers of at most ``wide`` bytes as the steps between them, modulo 2**64; below 8 bytes they must ascend."""
    return _planes(np.diff(numbers, prepend=np.uint64(0)), wide)


def _from_gaps(packed: bytes, wide: int) -> np.ndarray:
    return np.cumsum(_from_planes(packed, wide), dtype=np.uint64)


def _pressed(raw: bytes) -> bytes:
    """Bytes in zstd behind how many they are, or behind zeros as they are if that is shorter."""
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return len(raw).to_bytes(4, "little") + small if len(small) < len(raw) else bytes(4) + raw


def _unpressed(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:4], "little")
    return pa.decompress(packed[4:], size, codec="zstd", asbytes=True) if size else packed[4:]


def _packed_tokens(codes: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Tokens and hashes of the words under new numbers: the most frequent word first, equally frequent ones by hash."""
    order = np.lexsort((hashes, -np.bincount(codes, minlength=len(hashes))))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return _pressed(_planes(number[codes], 4)), _pressed(_gaps(hashes[order], 8))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the texts of column ``text``, without the end token; words are counted per batch first."""
    def count(batches):
        for batch in batches:
            found = words_of(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _grams(row: dict) -> tuple[np.ndarray, ...]:
    """Of a stored block: sizes, token numbers, numbers before, distinct words and distinct pairs as keys, pair of each token."""
    sizes, hashes = np.frombuffer(row["sizes"], "<i8"), _from_gaps(_unpressed(row["hashes"]), 8)
    codes = _from_planes(_unpressed(row["codes"]), 4).astype(np.int64)
    before = _before(codes, np.cumsum(sizes) - sizes)
    pairs, back = np.unique(_pairs(codes, before, hashes), return_inverse=True)
    return sizes, codes, before, hashes, pairs, back


def _by_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys by segment and short key, segments that hold any, where each begins in that order)."""
    segment = Filter.segment(keys, segments)
    order = np.argsort(segment << np.uint64(8 * SHORT) | Filter.short(keys))   # segments have 24 bits at most
    some, starts = np.unique(segment[order], return_index=True)
    return order, some, starts


def gram_levels(blocks: DataFrame, segments: int, width: int) -> DataFrame:
    """(block, segment, levels): for each block the level of each of its keys in a segment, a byte each, as it sent them."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, codes, _, words, pairs, back = _grams(row)
                taught = np.repeat(np.frombuffer(row["taught"], np.bool_), sizes)
                counts = np.concatenate([np.bincount(codes[taught], minlength=len(words)),
                                         np.bincount(back[taught], minlength=len(pairs))])
                keys = np.concatenate([words, pairs])
                order, some, starts = _by_segment(keys, segments)
                keys, counts, ends = Filter.short(keys[order]), counts[order], np.append(starts[1:], len(keys))
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array(some.astype(np.int64)), "block": pa.array(np.full(len(some), row["block"])),
                    "keys": pa.array([_pressed(_gaps(keys[i:j], SHORT)) for i, j in zip(starts, ends)], pa.binary()),
                    "counts": pa.array([_pressed(_narrow(counts[i:j])) for i, j in zip(starts, ends)], pa.binary())})

    def probe(key, table):
        sent = [_from_gaps(_unpressed(b.as_py()), SHORT) for b in table.column("keys")]
        counts = np.concatenate([_wide(_unpressed(b.as_py())) for b in table.column("counts")])
        keys, back = np.unique(np.concatenate(sent), return_inverse=True)
        summed = np.zeros(len(keys), np.int64)
        np.add.at(summed, back, counts)
        built = Filter(short_bits(keys[summed > 0], summed[summed > 0], width), 1, width)
        found = built.levels_at(keys, np.zeros(len(keys), np.uint64)).astype(np.uint8)[back]
        ends = np.cumsum([len(k) for k in sent])
        return pa.table({
            "block": table.column("block"), "segment": table.column("segment"),
            "levels": pa.array([_pressed(found[j - len(k):j].tobytes()) for k, j in zip(sent, ends)], pa.binary())})

    return (blocks.select("block", "taught", "sizes", "codes", "hashes")
            .mapInArrow(send, "segment long, block long, keys binary, counts binary")
            .groupBy("segment").applyInArrow(probe, "block long, segment long, levels binary"))


def _log_scores(single: np.ndarray, pairs: np.ndarray, codes: np.ndarray, before: np.ndarray, starts: np.ndarray,
                n: int, v: int, pair_weight: float) -> np.ndarray:
    """log10 probability of each text, from the counts of the distinct words and of each token's pair."""
    token, previous = single[codes], single[before]
    both = np.minimum(np.minimum(pairs, token), previous)
    p = (token + 0.5) / (n + 0.5 * (v + 1))
    p = np.where(previous > 0, pair_weight * both / np.maximum(previous, 1) + (1 - pair_weight) * p, p)
    return np.add.reduceat(np.log10(p), starts)


def score_block(filter_: Filter, block: Block, n: int, v: int, pair_weight: float) -> np.ndarray:
    """log10 probability of each text of a block."""
    if not len(block.sizes):
        return np.zeros(0)
    return _log_scores(filter_.counts(block.hashes), filter_.counts(block.pairs()), block.codes, block.before,
                       block.starts, n, v, pair_weight)


def block_scores(blocks: DataFrame, levels: DataFrame, segments: int, n: int, v: int, pair_weight: float) -> DataFrame:
    """(block, at, score): the log10 probability of each text of each block."""
    def score(own, got):
        row = own.to_pylist()[0]
        sizes, codes, before, words, pairs, back = _grams(row)
        order, _, _ = _by_segment(np.concatenate([words, pairs]), segments)
        pieces = got.column("levels").to_pylist()
        pieces = [_unpressed(pieces[i]) for i in np.argsort(np.asarray(got.column("segment")))]
        counts = np.zeros(len(order))
        counts[order] = MEANS[np.minimum(np.frombuffer(b"".join(pieces), np.uint8), len(MEANS) - 1)]
        found = _log_scores(counts[:len(words)], counts[len(words):][back], codes, before, np.cumsum(sizes) - sizes, n, v,
                            pair_weight)
        return pa.table({"block": pa.array(np.full(len(sizes), row["block"])),
                         "at": pa.array(np.arange(len(sizes), dtype=np.int32)), "score": pa.array(found)})

    return blocks.select("block", "sizes", "codes", "hashes").groupBy("block").cogroup(
        levels.groupBy("block")).applyInArrow(score, "block long, at int, score double")


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
           pair_weight: float = PAIR_WEIGHT, head: int = HEAD) -> DataFrame:
    """A row per row of ``docs``: id_col, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``train`` (over ``docs``) holds.
    """
    spark = docs.sparkSession
    raw = whole(text_col)
    taught = docs.where(train).select(raw.alias("text"))
    with batch_bytes(spark, BATCH_BYTES):
        counted, _ = stored(word_counts(taught), "words")
    documents = taught.count()
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    n, v = n + documents, v + (documents > 0)
    divisor = n + 0.5 * (v + 1)
    frequent = most_frequent(counted.where(F.octet_length("word") <= LONGEST), "c", head).toPandas()
    known = spark.sparkContext.broadcast(([w.encode() for w in frequent["word"]], np.log10(
        (frequent["c"].to_numpy(float) + 0.5) / divisor)))
    del frequent
    end_log = math.log10((documents + 0.5) / divisor)

    def blocked(batches):
        logs, held = dict(zip(known.value[0], known.value[1].tolist())), []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                yield from rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], logs)
                held = []
        if held:
            yield from rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], logs)

    def rows(batch, logs):
        block, number = Block(batch.column(2)), batch.column(0)[0].as_py()
        # log of each distinct word's estimate; NaN where the word is not broadcast
        log = np.array([*map(logs.get, block.keys, itertools.repeat(math.nan)), end_log])
        each = log[block.codes]
        rare = np.isnan(each)
        text = np.repeat(np.arange(len(block.sizes)), block.sizes)
        found, times = np.unique(text[rare] * np.int64(len(log)) + block.codes[rare], return_counts=True)
        of, code = np.divmod(found, len(log))
        words = block.words.take(pa.array(code))
        tail = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of, np.arange(len(block.sizes) + 1)), pa.int32()),
            pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], names=["word", "n"]))
        in_head = np.add.reduceat((~rare).astype(np.int64), block.starts) - (documents == 0)
        size = len(block.sizes)
        codes, hashes = _packed_tokens(block.codes, block.hashes)
        per_text = {
            "block": pa.array(np.full(size, number)), "at": pa.array(np.arange(size, dtype=np.int32)), "id": batch.column(1),
            "n_tokens": pa.array(block.sizes), "n_known": pa.array(in_head),
            "base": pa.array(np.add.reduceat(np.where(rare, 0.0, each), block.starts)), "tail": tail}
        per_block = {"block": pa.array([number]), "at": pa.array([-1], pa.int32())} | {
            name: pa.array([packed], pa.binary()) for name, packed in (
                ("taught", batch.column(3).to_numpy(zero_copy_only=False).astype(np.bool_).tobytes()),
                ("sizes", block.sizes.astype("<i8").tobytes()), ("codes", codes), ("hashes", hashes))}
        for columns, length in ((per_text, size), (per_block, 1)):
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)) for f in schema], schema=schema)

    first = docs.select(F.monotonically_increasing_id().alias("block"), F.col(id_col).alias("id"), raw.alias("text"),
                        F.coalesce(train, F.lit(False)).alias("taught"))
    kind = first.schema["id"].dataType
    schema = pa.schema([
        ("block", pa.int64()), ("at", pa.int32()), ("id", to_arrow_type(kind)), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base", pa.float64()),
        ("tail", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))),
        *((name, pa.binary()) for name in ("taught", "sizes", "codes", "hashes"))])
    segments, width = Filter.shape(n)
    with batch_bytes(spark, BATCH_BYTES):
        # A row for each text and, numbered -1, one for the block: what its keys are made from.
        made = first.mapInArrow(
            blocked, f"block long, at int, id {kind.simpleString()}, n_tokens long, n_known long, base double, "
                     "tail array<struct<word: string, n: long>>, taught binary, sizes binary, codes binary, hashes binary"
        ).withColumn("text", (F.col("at") >= 0).cast("int"))
        path = scratch_path(spark, "blocks")
        made.write.partitionBy("text").option("compression", "zstd").parquet(path)
        blocks = spark.read.schema(made.schema).parquet(path).where("text = 0")
        scored, _ = stored(block_scores(blocks, gram_levels(blocks, segments, width), segments, n, v, pair_weight), "scored")
    discard(spark, f"{path}/text=0")   # the frame returned reads the texts only
    texts = spark.read.schema(made.schema).parquet(path).where("text = 1")
    rare = texts.select("block", "at", F.explode("tail").alias("t")).select("block", "at", "t.word", "t.n").join(
        counted, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("block", "at").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(divisor))).alias("rare"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    return texts.select("block", "at", "id", "n_tokens", "n_known", "base").join(scored, ["block", "at"]).join(
        rare, ["block", "at"], "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"), "score")
