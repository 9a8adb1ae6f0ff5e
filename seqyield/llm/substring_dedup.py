"""Substring de-duplication by content-defined chunking with a gear hash.

*Cuts.*  The gear hash of a position depends on the ``WINDOW`` bytes before it
only; a chunk ends where it falls below a threshold (every ``AVERAGE`` bytes on
average), never inside a character, and after ``LONGEST`` bytes at the latest.  An insertion therefore moves the cuts near it and
no others, and two copies of a passage have the same chunks but for the first and last.

*Digests.*  Chunks are told apart by their 64-bit XXH3.  Of equal chunks the
one in the document with the smallest id, and there the first, is the
original; all others are repeats.  Documents are read in blocks of bounded
size.  A block sends each digest once, with its first place and number, packed
by bucket; so a chunk that a third of all documents holds costs one entry a
block, and the number of buckets follows the number of chunks.  What comes
back to a block is the digests that occur elsewhere too.

*Passages.*  Consecutive repeats are a run.  The chunks at the ends of a copied
passage hold foreign bytes, so a run is extended, character by character, as
far as it agrees with the original of its outer chunks.  That is never
further than one more chunk and ``WINDOW`` bytes, or that chunk would be a
repeat as well (chunks cut at ``LONGEST`` bytes excepted).  Only those neighbouring
characters travel, one piece per original chunk and block.  An extended run
of ``MIN_WORDS`` words or ``MIN_CHARACTERS`` code points is a repeated
passage.  Shorter ones are left: common phrases and single lines.  Runs that
could not get that long are left out before anything travels.  In scripts
written without blanks each character counts as a word.  Passages may overlap.

Null and empty texts have no chunks.  Null ids come after all others; ids that
are not integers are ordered by their hash.  Rows that repeat an id are rows
of their own, in the order of their row numbers.  An empty table gives no
passages; extra columns are not read by ``passages`` and kept by ``without_passages``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.llm.common import free_names, stored, whole

WINDOW = 32
AVERAGE, LONGEST = 24, 4096
MIN_WORDS, MIN_CHARACTERS = 25, 400
#: Code points from which a chunk counts on its own.
TELLING = 16
#: Telling chunks at either end of a run that choose the original to compare with.
OUTER = 8
#: Bytes of text and documents of a block, and chunks a bucket aims at.
BLOCK_BYTES, BLOCK_ROWS = 1 << 23, 1 << 14
BUCKET = 1 << 19

_GEAR = np.random.default_rng(20).integers(1, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0   # the zero bytes between documents leave no trace


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of the table's value of the byte ``j`` places before, shifted by ``j`` bits."""
    out, width = _GEAR[data], 1
    while width < WINDOW:
        moved = out[:-width] << np.uint32(width)
        out = np.concatenate([out[:width], out[width:] + moved])
        width *= 2
    return out


def chunk_ends(texts: list[bytes], average: int = AVERAGE, longest: int = LONGEST) -> list[np.ndarray]:
    """The end of every chunk of each text."""
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    cut = gear(data) < np.uint32((1 << 32) // average)
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    places = np.nonzero(cut)[0] + 1
    out, at = [], 0
    for text in texts:
        end = at + len(text)
        own = places[np.searchsorted(places, at, side="right"):np.searchsorted(places, end, side="left")] - at
        own = np.append(own, len(text)) if text else own[:0]
        sizes = np.diff(own, prepend=0)
        if len(own) and sizes.max() > longest:
            own = np.concatenate([_split(text, e - s, e, longest) for e, s in zip(own.tolist(), sizes.tolist())])
        out.append(own)
        at = end + WINDOW
    return out


def _split(text: bytes, start: int, end: int, longest: int) -> np.ndarray:
    """Ends of the parts of a chunk of more than ``longest`` bytes, at characters' ends."""
    out, at = [], start
    while end - at > longest:
        at += longest
        while at < end and text[at] & 0xC0 == 0x80:
            at += 1
        out.append(at)
    return np.array([*out, *([end] if not out or out[-1] < end else [])], np.int64)


def white(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte; kana, ideographs, Thai, Lao, Burmese and Khmer letters are words of their own."""
    space = white(data)
    out = ~space & np.concatenate([[True], space[:-1]])
    if len(data) and data.max() >= 0xE0:
        after = np.concatenate([data[1:], [0]])
        out |= (data >= 0xE3) & (data <= 0xE9)
        out |= (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
        out |= (data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))
    return out


def _digests(text: bytes, sizes: np.ndarray) -> list[int]:
    at, out = 0, []
    for size in sizes.tolist():
        out.append(xxhash.xxh3_64_intdigest(text[at:at + size]))
        at += size
    return out


def _order(id_col: str, kind: T.DataType) -> Column:
    number = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(id_col).cast("string"))
    return F.coalesce(number, F.lit((1 << 63) - 1))


#: Chunks of a block, one row for each of its documents: where its text begins in the block, its bytes, those of its
#: chunks, and their digests, packed.  The first row has the texts of the block, compressed.
_CHUNKS = "row long, place long, id {}, block long, at long, size long, sizes binary, digests binary, texts binary"


def _chunked(docs: DataFrame, average: int) -> DataFrame:
    """``docs`` (row, place, id, text in UTF-8) as rows of ``_CHUNKS``."""
    def chunk(batches):
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column(3)):
                held.append((i, text.as_py()))
                size += len(held[-1][1])
                if size > BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                    yield rows(batch, held)
                    held, size = [], 0
            if held:
                yield rows(batch, held)

    def rows(batch, held):
        index = pa.array([i for i, _ in held])
        texts = [t for _, t in held]
        parts = [np.diff(own, prepend=0) for own in chunk_ends(texts, average)]
        digests = [np.array(_digests(text, own), "<u8").tobytes() for text, own in zip(texts, parts)]
        parts = [own.astype("<u2").tobytes() for own in parts]
        row = batch.column(0).take(index)
        block = pa.array(np.full(len(held), row[0].as_py()))
        sizes = np.array([len(t) for t in texts], np.int64)
        packed = [zstandard.compress(b"".join(texts), 1), *[None] * (len(held) - 1)]
        return pa.RecordBatch.from_arrays(
            [row, batch.column(1).take(index), batch.column(2).take(index), block, pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
             *(pa.array(x, pa.binary()) for x in (parts, digests, packed))],
            names=["row", "place", "id", "block", "at", "size", "sizes", "digests", "texts"])

    return docs.select("row", "place", "id", "text").mapInArrow(
        chunk, _CHUNKS.format(docs.schema["id"].dataType.simpleString()))


def _spread(table, column: str, kind: str) -> tuple[np.ndarray, ...]:
    """(value, row, number in its document, document) of all chunks of some rows of ``_CHUNKS``."""
    lists = [np.frombuffer(d.as_py(), kind) for d in table.column(column)]
    sizes = np.array([len(x) for x in lists], np.int64)
    value = np.concatenate(lists) if lists else np.zeros(0, kind)
    number = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    return value, np.asarray(table.column("row")).astype(np.int64)[document], number, document


def _firsts(digest, place, row, number, count) -> tuple[np.ndarray, ...]:
    """Each digest once: with its first (place, row, number), the sum of its counts, and where the first was."""
    order = np.lexsort((number, row, place, digest))
    digest = digest[order]
    starts = np.concatenate([[0], np.nonzero(digest[1:] != digest[:-1])[0] + 1]) if len(digest) else order
    first = order[starts]
    return (digest[starts], place[first], row[first], number[first],
            np.add.reduceat(count[order], starts) if len(starts) else count[:0], first)


#: Columns of packed digests, as sent and as found: they travel one after the other, as equal high bytes compress.
_SENT = (("digest", "<u8"), ("place", "<i8"), ("row", "<i8"), ("number", "<u4"), ("count", "<u4"))
_FOUND = (("digest", "<u8"), ("row", "<i8"), ("number", "<u4"), ("home", "<i8"))


def _pack(columns: tuple[np.ndarray, ...], kinds, which=slice(None)) -> bytes:
    return b"".join(np.minimum(c[which], (1 << 32) - 1).astype(t).tobytes() if n == "count" else c[which].astype(t).tobytes()
                    for c, (n, t) in zip(columns, kinds))


def _width(kinds) -> int:
    return sum(np.dtype(t).itemsize for _, t in kinds)


def _unpack(packed: list[bytes], kinds) -> tuple[np.ndarray, ...]:
    """The columns of several packed pieces, put together."""
    parts = [[] for _ in kinds]
    for piece in packed:
        at, n = 0, len(piece) // _width(kinds)
        for part, (_, t) in zip(parts, kinds):
            part.append(np.frombuffer(piece, t, n, at))
            at += n * np.dtype(t).itemsize
    return tuple(np.concatenate(p or [np.zeros(0, t)]).astype(np.uint64 if name == "digest" else np.int64)
                 for p, (name, t) in zip(parts, kinds))


def repeated(chunks: DataFrame, buckets: int) -> DataFrame:
    """(block, found): for each block its digests that occur more than once, with their first row, number and its block."""
    def send(batches):
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            for block in np.unique(blocks):
                part = batch.filter(pa.array(blocks == block))
                digest, row, number, document = _spread(part, "digests", "<u8")
                place = np.asarray(part.column("place")).astype(np.int64)[document]
                own = _firsts(digest, place, row, number, np.ones(len(digest), np.int64))
                bucket = own[0] % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.nonzero(np.diff(starts))[0]:
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([int(b)]), "block": pa.array([int(block)]),
                        "sent": pa.array([_pack(own, _SENT, order[starts[b]:starts[b + 1]])], pa.binary())})

    def meet(table):
        pieces = [b.as_py() for b in table.column("sent")]
        every = _unpack(pieces, _SENT)
        blocks = np.repeat(np.asarray(table.column("block")), [len(p) // _width(_SENT) for p in pieces])
        digest, _, row, number, count, at = _firsts(*every)
        first = tuple(c[count > 1] for c in (digest, row, number, blocks[at]))
        here = np.searchsorted(first[0], every[0])
        known = here < len(first[0])
        known[known] = first[0][here[known]] == every[0][known]
        here, blocks = here[known], blocks[known]
        order = np.argsort(blocks, kind="stable")
        here, blocks = here[order], blocks[order]
        starts = np.concatenate([[0], np.nonzero(blocks[1:] != blocks[:-1])[0] + 1]) if len(blocks) else blocks
        return pa.table({"block": pa.array(blocks[starts] if len(blocks) else [], pa.int64()), "found": pa.array(
            [_pack(first, _FOUND, here[i:j]) for i, j in zip(starts, np.append(starts[1:], len(here)))], pa.binary())})

    return (chunks.select("row", "place", "block", "digests").mapInArrow(send, "bucket long, block long, sent binary")
            .groupBy("bucket").applyInArrow(meet, "block long, found binary"))


def _texts(own: pa.Table) -> bytes:
    """The texts of a block, one after the other in the order of ``at``."""
    packed = own.column("texts").drop_null()
    return zstandard.decompress(packed[0].as_py()) if len(packed) else b""


#: A run of repeats: ``start`` and ``length`` without the extension, the distance and words from either end to the chunk
#: that is compared with its original, the number of words between, and the bytes beside it.
_RUNS = ("block long, row long, start long, length long, n_words long, originals array<long>, "
         "left_home long, left_row long, left_number long, left_off long, left_words long, left_need long, left_own binary, "
         "right_home long, right_row long, right_number long, right_off long, right_words long, right_need long, right_own binary")


def _runs(table: pa.Table, found: tuple[np.ndarray, ...], min_words: int, min_characters: int) -> list[tuple]:
    """Runs of repeats of the documents of one block that may be a passage: rows of ``_RUNS`` without the block."""
    table = table.sort_by("at")
    size, row, number, document = _spread(table, "sizes", "<u2")
    if not len(found[0]) or not len(size):
        return []
    # Running sums over the bytes of the whole block, and where the document of each chunk begins and ends.
    text = _texts(table)
    end = np.cumsum(size, dtype=np.int64)
    begin = end - size
    opens = np.nonzero(number == 0)[0]
    which = np.cumsum(number == 0) - 1
    doc_begin, doc_last = begin[opens][which], np.append(opens[1:], len(size))[which] - 1

    order = np.argsort(found[0], kind="stable")
    known, known_row, known_number, known_home = (c[order] for c in found)
    digest = np.array(_digests(text, size), np.uint64)
    here = np.minimum(np.searchsorted(known, digest), len(known) - 1)
    repeat = (known[here] == digest) & ((known_row[here] != row) | (known_number[here] != number))
    if not repeat.any():
        return []
    first_row, first_number, first_home = known_row[here], known_number[here], known_home[here]

    data = np.frombuffer(text, np.uint8)
    words = word_starts(data)
    words[begin[opens]] = ~white(data[begin[opens]])   # what precedes is another document
    said = np.cumsum(np.add.reduceat(words, begin, dtype=np.int64))
    lengths = np.add.reduceat((data & 0xC0) != 0x80, begin, dtype=np.int64)
    chars = np.cumsum(lengths)
    before, ahead = np.append(0, said[:-1]), chars - lengths

    apart = np.concatenate([[True], document[1:] != document[:-1]])
    firsts = np.nonzero(repeat & (apart | ~np.concatenate([[False], repeat[:-1]])))[0]
    lasts = np.nonzero(repeat & (np.append(apart[1:], True) | ~np.append(repeat[1:], False)))[0]
    lower = np.maximum(begin[np.maximum(firsts - 1, opens[which[firsts]])] - WINDOW, doc_begin[firsts])
    beyond = np.minimum(lasts + 1, doc_last[lasts])
    most_words = said[beyond] - before[np.searchsorted(end, lower, side="right")]
    may = (most_words >= min_words) | (end[beyond] - lower >= min_characters)
    out = []
    for i, j, low, high in zip(firsts[may].tolist(), lasts[may].tolist(), lower[may].tolist(), end[beyond[may]].tolist()):
        # Chunks of a few letters repeat by chance: where there are others, they neither begin nor end a run, nor name its original.
        some = np.nonzero(lengths[i:j + 1] >= TELLING)[0] + i
        if not len(some):
            some = np.array([i + int(np.argmax(lengths[i:j + 1]))])
        left, right = some[:OUTER], some[-OUTER:][::-1]
        a, b = (int(side[_commonest(first_row[side], lengths[side])]) for side in (left, right))
        s, e = int(some[0]), int(some[-1])
        out.append((
            int(row[i]), int(ahead[s] - ahead[opens[which[i]]]), int(chars[e] - ahead[s]), int(said[e] - before[s]),
            np.unique(first_row[some]).tolist(),
            int(first_home[a]), int(first_row[a]), int(first_number[a]), int(ahead[a] - ahead[s]), int(before[a] - before[s]),
            int(begin[a]) - low, text[low:begin[a]],
            int(first_home[b]), int(first_row[b]), int(first_number[b]), int(chars[e] - chars[b]), int(said[e] - said[b]),
            high - int(end[b]), text[end[b]:high]))
    return out


def _commonest(rows: np.ndarray, weights: np.ndarray) -> int:
    """The first place of the row with the largest weight."""
    names, each = np.unique(rows, return_inverse=True)
    total = np.bincount(each, weights)[each]
    return int(np.argmax(total)) if len(names) > 1 else 0


def agreement(own: bytes, other: bytes, at_end: bool) -> int:
    """How many bytes of whole characters ``own`` and ``other`` have in common, at their ends or at their beginnings."""
    n = min(len(own), len(other))
    if not n:
        return 0
    one, two = ((np.frombuffer(x[-n:] if at_end else x[:n], np.uint8)) for x in (own, other))
    differ = np.nonzero(one != two)[0]
    if at_end:
        same = n - 1 - int(differ[-1]) if len(differ) else n
        while same and own[-same] & 0xC0 == 0x80:
            same -= 1
    else:
        same = int(differ[0]) if len(differ) else n
        while 0 < same < len(own) and own[same] & 0xC0 == 0x80:
            same -= 1
    return same


def _beside(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """(block, chunk_row, number, at_left, beside): for each block the bytes beside the original chunks its runs name."""
    sides = [runs.select("block", F.col(f"{s}_home").alias("home"), F.col(f"{s}_row").alias("chunk_row"),
                         F.col(f"{s}_number").alias("number"), F.lit(s == "left").alias("at_left"), F.col(f"{s}_need").alias("need"))
             for s in ("left", "right")]
    keys = ["chunk_row", "number", "at_left"]
    # A hot original is asked for once a block, and cut once.
    asked, _ = stored(sides[0].unionAll(sides[1]).where("need > 0").groupBy("block", "home", *keys).agg(
        F.max("need").alias("need")), "asked")
    wanted = asked.groupBy("home", *keys).agg(F.max("need").alias("need"))

    def cut(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"chunk_row": [], "number": [], "at_left": [], "beside": []}
        if own.num_rows and asked.num_rows:
            text = _texts(own)
            places = {r["row"]: r for r in own.select(["row", "at", "size", "sizes"]).to_pylist()}
            row = None
            for r in asked.sort_by("chunk_row").select(["chunk_row", "number", "at_left", "need"]).to_pylist():
                if r["chunk_row"] != row:
                    row = r["chunk_row"]
                    begin = places[row]["at"]
                    stop = begin + places[row]["size"]
                    ends = np.cumsum(np.append([begin], np.frombuffer(places[row]["sizes"], "<u2")), dtype=np.int64)
                at = int(ends[r["number"] + (not r["at_left"])])
                for name in ("chunk_row", "number", "at_left"):
                    out[name].append(r[name])
                out["beside"].append(text[max(at - r["need"], begin):at] if r["at_left"] else text[at:min(at + r["need"], stop)])
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))})

    pieces = chunks.select("block", "row", "at", "size", "sizes", "texts").groupBy("block").cogroup(
        wanted.groupBy("home")).applyInArrow(cut, "chunk_row long, number long, at_left boolean, beside binary")
    return asked.select("block", *keys).join(pieces, keys)


def _spans(narrow: DataFrame, average: int, min_words: int, min_characters: int) -> tuple[DataFrame, DataFrame]:
    """Repeated passages of ``narrow`` (row, place, id, text in UTF-8): row, start, length, n_words, originals.

    And (row, id) of all rows, as they were numbered when the texts were read.
    """
    chunks, _ = stored(_chunked(narrow, average), "chunks")
    total = chunks.agg(F.coalesce(F.sum(F.length("digests")), F.lit(0))).head()[0] // 8
    found, _ = stored(repeated(chunks, max(1, -(-total // BUCKET))), "repeated")

    def runs_of(own: pa.Table, repeats: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows:
            block = own.column("block")[0].as_py()
            got = _unpack([b.as_py() for b in repeats.column("found")], _FOUND)
            rows = [(block, *r) for r in _runs(own, got, min_words, min_characters)]
        columns = [*zip(*rows)] or [()] * len(names)
        return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)})

    names = [part.split()[0] for part in _RUNS.split(", ")]
    kinds = {"originals": pa.list_(pa.int64()), "left_own": pa.binary(), "right_own": pa.binary()}
    runs, _ = stored(chunks.select("block", "row", "at", "size", "sizes", "texts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(runs_of, _RUNS), "runs")

    def extend(own: pa.Table, beside: pa.Table) -> pa.Table:
        pieces = {(r["chunk_row"], r["number"], r["at_left"]): r["beside"] for r in beside.to_pylist()}
        out = []
        for r in own.to_pylist():
            gain = {}
            for side, at_left in (("left", True), ("right", False)):
                text = r[f"{side}_own"]
                same = agreement(text, pieces.get((r[f"{side}_row"], r[f"{side}_number"], at_left), b""), at_left)
                data = np.frombuffer(text, np.uint8)
                reached = slice(len(data) - same, None) if at_left else slice(0, same)
                length = int(((data & 0xC0) != 0x80)[reached].sum()) - r[f"{side}_off"]
                # What lies between the compared chunk and the end of the run is a repeat anyway.
                gain[side] = (length, int(word_starts(data)[reached].sum()) - r[f"{side}_words"]) if length > 0 else (0, 0)
            (left, left_words), (right, right_words) = gain["left"], gain["right"]
            length, n_words = r["length"] + left + right, r["n_words"] + left_words + right_words
            if n_words >= min_words or length >= min_characters:
                out.append((r["row"], r["start"] - left, length, n_words, r["originals"]))
        columns = [*zip(*out)] or [()] * 5
        return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in
                         zip(("row", "start", "length", "n_words", "originals"), columns)})

    asking = [f"{side}_{name}" for side in ("left", "right") for name in ("home", "need")]
    spans = runs.drop(*asking).groupBy("block").cogroup(_beside(chunks, runs).groupBy("block")).applyInArrow(
        extend, "row long, start long, length long, n_words long, originals array<long>")
    return spans, chunks.select("row", "id")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE,
             min_words: int = MIN_WORDS, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """A row per repeated passage: id_col, start and length (code points), n_words, originals.

    ``originals`` lists the ids of the documents that hold the originals of the passage's chunks.
    """
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         _order(id_col, kind).alias("place"), whole(text_col).cast("binary").alias("text"))
    spans, ids = _spans(narrow, average, min_words, min_characters)
    spans, _ = stored(spans, "spans")
    named = spans.select("row", "start", F.explode("originals").alias("original")).join(
        ids.select(F.col("row").alias("original"), "id"), "original").groupBy("row", "start").agg(
        F.sort_array(F.collect_set("id")).alias("originals"))
    return spans.drop("originals").join(ids, "row").join(named, ["row", "start"]).select(
        F.col("id").alias(id_col), "start", "length", "n_words", "originals")


def without_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", average: int = AVERAGE,
                     min_words: int = MIN_WORDS, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """``docs`` with every repeated passage cut out of its text; all other columns as they were."""
    row, cuts = free_names(docs, ["__row", "__cuts"])
    numbered, _ = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    narrow = numbered.select(F.col(row).alias("row"), _order(id_col, docs.schema[id_col].dataType).alias("place"),
                             F.lit(None).cast("long").alias("id"), whole(text_col).cast("binary").alias("text"))
    spans = _spans(narrow, average, min_words, min_characters)[0].groupBy(F.col("row").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cuts))
    text = F.col(f"`{text_col}`")
    # What lies between the cuts, then what follows the last.
    kept = F.aggregate(
        F.col(cuts), F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda done, cut: F.struct(
            F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), (cut["start"] - done["at"]).cast("int"))).alias("text"),
            F.greatest(done["at"], cut["start"] + cut["length"]).alias("at")),
        lambda done: F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.lit((1 << 31) - 1))))
    joined = numbered.join(spans, row, "left")
    return joined.select(*[(F.when(F.col(cuts).isNull(), text).otherwise(kept) if c == text_col else F.col(f"`{c}`")).alias(c)
                           for c in docs.columns])
