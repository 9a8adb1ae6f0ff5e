"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; only (document, piece, start, length,
checksum) rows travel.  Pieces of full length are sequences by themselves and
are never shuffled.  The others are dealt by hash over shards of about
``SHARD`` pieces, whose number follows the table, and each shard is packed on
its own, which costs at most one partly filled sequence a shard.

In a shard a sequence is first filled greedily with the largest pieces that
fit.  If a gap remains, its smallest piece is replaced by the two unpacked
pieces that fill the place of both, piece and gap, more tightly.

A null text is the empty text and has the end token alone.  Repeated rows are
documents of their own.  An empty table gives an empty result.  Extra columns
are not read.

Token ids are those of the ``tokenizers`` library.  Texts of ASCII and Latin
letters go through ``tiktoken`` with the ranks of that same vocabulary, about
four times as fast with equal ids (tested); all other texts, and those with a
run of ``BLANKS`` white-space characters, on which ``tiktoken`` runs out of
stack, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.llm.common import stored, whole

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 2
#: Pieces a shard aims at.
SHARD = 1 << 16

#: White-space characters in a row up to which texts go through tiktoken; it fails between 700,000 and a million.
BLANKS = 100_000

_LATIN = re.compile("[\x00-\x7f¡-¬®-ɏ]*")
_BLANK = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")


@functools.lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of a byte-level BPE file and the same vocabulary for texts of Latin letters."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    # Byte-level vocabularies spell byte b with a printable character: b itself where it is one,
    # else the next free code point from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    assert set(pre_tokenizers.ByteLevel.alphabet()) == set(spelled)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(spelled[c] for c in token): rank for token, rank in vocabulary.items()
             if all(c in spelled for c in token)}
    fast = tiktoken.Encoding("latin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast


def token_ids(text: str, path: str, end: int = END) -> np.ndarray:
    """Ids of one text followed by the end id, as little-endian unsigned 32-bit numbers."""
    exact, fast = _encoders(path)
    if _LATIN.fullmatch(text) and not (len(text) >= BLANKS and _BLANK.search(text)):
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    ids.append(end)
    return np.array(ids, "<u4")


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    first = n % length or length
    return [(0, min(first, n)), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: id_col, piece, start, length, ids_crc32 (and ids)."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def tokenise(batches):
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        for batch in batches:
            which, rows, ids = [], [], []
            for i, text in enumerate(batch.column(1)):
                of = token_ids(text.as_py(), path, end)
                for k, (at, n) in enumerate(cut(len(of), length)):
                    which.append(i)
                    rows.append((k, at, n, zlib.crc32(of[at:at + n].tobytes())))
                    if with_ids:
                        ids.append(of[at:at + n].astype(np.int32))
            columns = [*zip(*rows), ids] if with_ids else [*zip(*rows)]
            if which:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which)), *(pa.array(v, t) for v, (_, t) in zip(columns, fields))],
                    names=["id", *(name for name, _ in fields)])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(
        tokenise, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Stock:
    """Unpacked pieces by length; a bit set answers "the largest length up to n"."""

    def __init__(self, lengths: np.ndarray, longest: int):
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(longest + 2))
        self.by = [order[bounds[n]:bounds[n + 1]].tolist() for n in range(longest + 1)]
        self.some = sum(1 << n for n in range(longest + 1) if self.by[n])

    def largest(self, upto: int) -> int:
        """The largest length in stock that is at most ``upto``; -1 if there is none."""
        return (self.some & ((1 << (upto + 1)) - 1)).bit_length() - 1

    def take(self, n: int) -> int:
        piece = self.by[n].pop()
        if not self.by[n]:
            self.some &= ~(1 << n)
        return piece

    def back(self, n: int, piece: int) -> None:
        self.by[n].append(piece)
        self.some |= 1 << n

    def best_two(self, above: int, upto: int) -> tuple[int, int] | None:
        """Two lengths in stock whose sum is as large as can be, over ``above`` and at most ``upto``."""
        best, found = above, None
        a = self.largest(upto - 1)
        while a > 0 and 2 * a > best:
            b = self.largest(min(a, upto - a))
            if b == a and len(self.by[a]) < 2:
                b = self.largest(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == upto:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one shard."""
    stock = Stock(lengths, length)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number in itertools.count():
        if not stock.some:
            return sequence, offset
        held, gap = [], length
        while (n := stock.largest(gap)) > 0:
            held.append((n, stock.take(n)))
            gap -= n
        if gap:
            n, piece = held[-1]  # taken in falling order: the smallest
            two = stock.best_two(n, n + gap)
            if two:
                held[-1:] = [(m, stock.take(m)) for m in two]
                stock.back(n, piece)
        at = 0
        for n, piece in held:
            sequence[piece], offset[piece] = number, at
            at += n


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         length: int = LENGTH, end: int = END, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """A row per piece of ``docs``: its place (sequence_id, offset) beside what ``pieces`` returns."""
    cut_up, _ = stored(pieces(docs, id_col, text_col, vocabulary, length, end, with_ids)
                       .withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = cut_up.where(F.col("length") < length)
    shards = max(1, -(-short.count() // shard))
    dealt = short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def packed(key, table):
        order = np.argsort(table.column("row").to_numpy())
        rows = table.column("row").to_numpy()[order]
        sequence, offset = best_two_fit(table.column("length").to_numpy()[order], length)
        return pa.table({"row": rows, "sequence_id": sequence + (key[0].as_py() << 32), "offset": offset})

    places = dealt.groupBy("shard").applyInArrow(packed, "row long, sequence_id long, offset long")
    names = [c for c in cut_up.columns if c not in ("id", "row")]
    out = [F.col("id").alias(id_col), *names, "sequence_id", "offset"]
    # Full pieces are sequences of their own, numbered below zero.
    full = cut_up.where(F.col("length") >= length).select(
        "*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(places, "row").select(*out).unionByName(full.select(*out))
