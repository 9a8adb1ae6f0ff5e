"""Cheapest repair of conversations by weighted interval parsing.

A conversation is a list of rows; its role initials should read
``(s?(ua)+)?``.  Rows may be kept (K, 0), given another role (R, 2), deleted
(D, 3; blank and duplicate rows must be) and empty rows inserted (I, 2); a
truncated row that stays adds 1.  The cheapest edits win, ties go to the
ASCII-least string of edits.

*Grammar.*  The wanted language is that of four states (0 nothing yet, 1 after
s, 2 after u, 3 after a).  The non-terminal X(p, q) derives the spans that lead
from state p to q, and the rules are in Chomsky normal form: X(p, q) -> X(p, r)
X(r, q) for two spans, X(p, q) -> a row, with the edit it takes and closed under
insertions before it.  The cell of a span holds for every X(p, q) the least
(cost, audit).  Insertions stand before rows, so an audit ends with its last
row's letter (those after the last row are added at the end); no audit of a
span is then the beginning of another, and the least of a whole is made of the
least of its parts.

*One split is enough.*  The non-terminals are closed under joining spans, so a
cell comes out the same whichever place it is split at; the parse joins
neighbouring spans of 1, 2, 4, ... rows instead of trying all splits (tests
compare it with the parse that does).

*Long conversations.*  Rows get their place in their conversation from ordered
running totals, which spread one conversation over many tasks.  ``BLOCK`` rows
make a block, ``BLOCK`` blocks a block of the next level, until each conversation
is one; above the rows a cell holds, in the place of an audit, the ranks of its
parts' audits.  The way down picks the cell of every block, and only then
letters and lines are written, a block at a time.

Rows are taken by turn (nulls first), then role, then SHA-256 of the text;
equal rows stand next to each other.  A null role or text counts as one blank,
rows without a conversation id are one conversation.  A role stands for its
first character; a role without one is never kept.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.llm.common import null_safe_join, stored
from seqyield.operators.prefix import running_totals

#: Rows of a block, and blocks of a block of the next level.
BLOCK = 256
STATES = range(4)
#: The state and role that an inserted row, or one given another role, leads to.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: The state a kept row leads to, by initial and state.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Edits after the last row: the insertions that each state still needs.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
#: What a row allows: any edit, any with 1 more when it stays, only its deletion.
FREE, TRUNCATED, FORCED = 0, 1, 2

Cell = tuple  # 16 entries: None or (cost, audit letters or ranks, states passed)


def _least(options) -> tuple | None:
    return min((x for x in options if x is not None), default=None)


def _add(a: tuple | None, b: tuple | None) -> tuple | None:
    return None if a is None or b is None else (a[0] + b[0], a[1] + b[1], a[2] + b[2])


@lru_cache(maxsize=4096)
def row_cell(initial: str, allows: int, copies: int) -> Cell:
    """Cell of a row, followed by ``copies - 1`` equal rows, which must be deleted."""
    def edits(state: int):
        yield state, DELETE, "D"
        if allows != FORCED:
            extra = CUT if allows == TRUNCATED else 0
            yield NEXT[state], REROLE + extra, "R"
            if state in KEEP.get(initial, ()):
                yield KEEP[initial][state], extra, "K"

    found: dict[tuple, list] = {}
    for p in STATES:
        state, cost, audit = p, 0, ""
        for _ in range(3):  # more insertions before a row never pay
            for q, more, letter in edits(state):
                found.setdefault((p, q), []).append((cost + more, audit + letter, ()))
            state, cost, audit = NEXT[state], cost + INSERT, audit + "I"
    one = tuple(_least(found.get((p, q), ())) for p in STATES for q in STATES)
    if copies == 1:
        return one
    again = row_cell(initial, FORCED, 1)
    if copies == 2:
        return join(one, again)
    # Deletions in a row: what is inserted comes last, as D sorts before I.
    run = tuple(e and (e[0] + DELETE * (copies - 2), "D" * (copies - 2) + e[1], ()) for e in again)
    return join(one, run)


def join(a: Cell, b: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    return tuple(_least([_add(a[4 * p + r], b[4 * r + q]) for r in STATES]) for p in STATES for q in STATES)


def parse(cells: Sequence[Cell]) -> Cell:
    """Cell of a list of neighbouring spans, joined bottom-up by span length."""
    spans = list(cells)
    while len(spans) > 1:
        spans = [join(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


@lru_cache(maxsize=4096)
def parse_rows(rows: tuple) -> Cell:
    """Cell of rows (initial, what it allows, copies)."""
    return parse([row_cell(*r) for r in rows])


def ranked(cell: Cell) -> tuple[list, list]:
    """Costs and ranks of the audits (equal ones alike) of a cell; None where there is no entry."""
    order = {x: i for i, x in enumerate(sorted({e[1] for e in cell if e}))}
    return [e and e[0] for e in cell], [e and order[e[1]] for e in cell]


def illegal_pairs(rows: Sequence[tuple]) -> int:
    """Neighbouring initials other than su, ua and au."""
    pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return pairs + sum(n - 1 for _, _, n in rows)


def out_lines(letters: str, state: int, rows: Sequence[dict]) -> list[tuple]:
    """The rows that the edits leave: (role, role before or None, digest or None)."""
    found, sources = [], (r for r in rows for _ in range(r["n"]))
    for edit in letters:
        source = None if edit == "I" else next(sources)
        if edit == "K":
            state = KEEP[source["role"][:1]][state]
            found.append((source["role"], source["role"], source["digest"]))
        elif edit in "RI":
            state = NEXT[state]
            found.append((ROLE[state], source and source["role"], source and source["digest"]))
    return found


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of ``rows`` after damage by CRC-32 of ``conv:turn`` modulo 20."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return (rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.when(fate == 4, "user").otherwise(said(role_col)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(
            said(text_col)).alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
        .drop("copy"))


def plain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of ``rows`` as they are."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"),
                       said(text_col).alias("text"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def sequence(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, role, digest) with their copies ``n``, what they allow, and their place ``at`` (from 1)."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flat = rows.select("conv", "turn", "role", _digest().alias("digest"), last.alias("last"))
    runs = flat.groupBy("conv", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("last").alias("last"))
    # The first of equal (role, text) in a conversation has the least turn, nulls first.
    key = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = runs.groupBy("conv", "role", "digest").agg(F.min(key).alias("first")).select(
        "conv", "role", "digest", F.col("first.turn").alias("turn"), F.lit(True).alias("first"))
    marked = null_safe_join(runs, first, ["conv", "turn", "role", "digest"], "left").withColumn(
        "first", F.col("first").isNotNull())
    blank = F.col("last") == ""
    allows = (F.when(blank | ~F.col("first"), FORCED)
              .when(F.col("last").isin(".", "!", "?"), FREE).otherwise(TRUNCATED))
    return running_totals(marked.select("conv", "turn", "role", "digest", "n", "first", blank.alias("blank"),
                                        allows.alias("allows")),
                          ["turn", "role", "digest"], {"at": 1}, by=["conv"])


def _cells_schema(conv: T.DataType, *more: T.StructField) -> T.StructType:
    ints = T.ArrayType(T.LongType())
    return T.StructType([T.StructField("conv", conv), T.StructField("block", T.LongType()),
                         T.StructField("costs", ints), T.StructField("ranks", ints),
                         T.StructField("illegal", T.LongType()), T.StructField("ends", T.StringType()), *more])


def _per_record(record, schema: T.StructType):
    """Run ``record`` on each row of Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([record(r) for r in batch.to_pylist()], schema=arrow)
    return run


def row_blocks(seq: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` rows with their cells and the letters of each entry."""
    rows = F.array_sort(F.collect_list(F.struct("at", "role", "digest", "allows", "n")))
    blocks = seq.groupBy("conv", F.floor((F.col("at") - 1) / size).cast("long").alias("block")).agg(rows.alias("rows"))
    schema = _cells_schema(seq.schema["conv"].dataType, T.StructField("letters", T.ArrayType(T.StringType())),
                           blocks.schema["rows"])

    def record(r):
        kinds = tuple((x["role"][:1], x["allows"], x["n"]) for x in r["rows"])
        cell = parse_rows(kinds)
        costs, ranks = ranked(cell)
        ends = [kinds[0][0] or " ", kinds[-1][0] or " "]
        return {**r, "costs": costs, "ranks": ranks, "illegal": illegal_pairs(kinds), "ends": "".join(ends),
                "letters": [e and e[1] for e in cell]}
    return blocks.mapInArrow(_per_record(record, schema), schema)


def joined_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` blocks with their cells and the states that each entry passes."""
    parts = F.array_sort(F.collect_list(F.struct("block", "costs", "ranks", "illegal", "ends")))
    grouped = blocks.groupBy("conv", F.floor(F.col("block") / size).cast("long").alias("parent")).agg(parts.alias("parts"))
    schema = _cells_schema(blocks.schema["conv"].dataType, T.StructField("paths", T.ArrayType(T.ArrayType(T.LongType()))))

    def record(r):
        parts = r["parts"]
        cells = [tuple(c if c is None else (c, (k,), (i % 4,)) for i, (c, k) in enumerate(zip(x["costs"], x["ranks"])))
                 for x in parts]
        cell = parse(cells)
        costs, ranks = ranked(cell)
        ends = [x["ends"] for x in parts]
        return {"conv": r["conv"], "block": r["parent"], "costs": costs, "ranks": ranks,
                "illegal": sum(x["illegal"] for x in parts)
                + sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:])),
                "ends": ends[0][0] + ends[-1][1], "paths": [e and list(e[2]) for e in cell]}
    return grouped.mapInArrow(_per_record(record, schema), schema)


def _whole(blocks: DataFrame) -> DataFrame:
    """(conv, cost, illegal, q): the cheapest cell of whole conversations, from state 0 to q, with what still has to be inserted."""
    ends = F.array(*[F.when(F.get("costs", F.lit(q)).isNotNull(), F.struct(
        (F.get("costs", F.lit(q)) + INSERT * CLOSING[q]).alias("cost"), F.get("ranks", F.lit(q)).alias("rank"),
        F.lit(q).alias("q"))) for q in STATES])
    best = F.array_min(F.filter(ends, lambda e: e.isNotNull()))
    return blocks.select("conv", best["cost"].alias("cost"), "illegal", best["q"].alias("q"))


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair the conversations of ``rows`` (conv, turn, role, text).

    Returns the audits (conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit), a row per conversation; the lines (conv, block, line, role,
    text, edit) of the repaired conversations, ordered by block and line; and
    the marked rows (conv, turn, role, digest, n, first, blank, allows, at).
    """
    seq, _ = stored(sequence(rows), "conversation-rows")
    level, _ = stored(row_blocks(seq, block), "row-blocks")
    levels = [level]
    most = seq.agg(F.max("at")).head()[0] or 0
    while most > block:
        levels.append(stored(joined_blocks(levels[-1], block), "joined-blocks")[0])
        most = -(-most // block)
    top, _ = stored(_whole(levels[-1]), "whole-conversations")
    # The way down: which entry of each block's cell the whole takes.
    taken = top.select("conv", F.lit(0).cast("long").alias("block"), F.col("q").cast("long").alias("entry"))
    for upper in levels[:0:-1]:
        path = null_safe_join(upper, taken, ["conv", "block"]).select(
            "conv", F.col("block").alias("parent"), F.floor(F.col("entry") / 4).cast("long").alias("p"),
            F.get("paths", F.col("entry").cast("int")).alias("path"))
        taken = path.select("conv", "parent", "p", "path", F.posexplode("path").alias("i", "q")).select(
            "conv", (F.col("parent") * block + F.col("i")).alias("block"),
            (F.when(F.col("i") == 0, F.col("p")).otherwise(F.get("path", F.col("i") - 1)) * 4 + F.col("q")).alias("entry"))
    chosen, _ = stored(null_safe_join(level, taken, ["conv", "block"]).select(
        "conv", "block", "rows", F.floor(F.col("entry") / 4).cast("int").alias("p"),
        F.get("letters", F.col("entry").cast("int")).alias("letters")), "edits")
    return _audits(seq, top, chosen), _lines(rows, top, chosen), seq


def _audits(seq: DataFrame, top: DataFrame, chosen: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    by_turn = seq.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
        F.sum((F.col("allows") == TRUNCATED).cast("long")).alias("truncated"))
    faults = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    letters = F.array_sort(F.collect_list(F.struct("block", "letters")))
    audits = chosen.groupBy("conv").agg(F.concat_ws("", F.transform(letters, lambda x: x["letters"])).alias("audit"))
    closing = F.get(F.array(*[F.lit("I" * CLOSING[q]) for q in STATES]), "q")
    return null_safe_join(null_safe_join(faults, top, ["conv"]), audits, ["conv"]).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", closing).alias("audit"))


def _lines(rows: DataFrame, top: DataFrame, chosen: DataFrame) -> DataFrame:
    line = T.StructType([T.StructField("role", T.StringType()), T.StructField("before", T.StringType()),
                         T.StructField("digest", T.BinaryType())])
    schema = T.StructType([chosen.schema["conv"], T.StructField("block", T.LongType()),
                           T.StructField("lines", T.ArrayType(line))])

    def record(r):
        found = out_lines(r["letters"], r["p"], r["rows"])
        return {"conv": r["conv"], "block": r["block"],
                "lines": [{"role": a, "before": b, "digest": d} for a, b, d in found]}
    written = chosen.mapInArrow(_per_record(record, schema), schema).select(
        "conv", "block", F.posexplode("lines").alias("line", "x")).select("conv", "block", "line", "x.*")
    written, _ = stored(written, "lines")
    last = F.when(F.col("q") == 1, F.array(F.lit("user"), F.lit("assistant"))).when(
        F.col("q") == 2, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    inserted = written.where(F.col("digest").isNull()).select("conv", "block", "line", "role").unionByName(
        top.select("conv", F.lit((1 << 63) - 1).alias("block"), F.posexplode(last).alias("line", "role")))
    texts = rows.select("conv", F.col("role").alias("before"), _digest().alias("digest"), "text").groupBy(
        "conv", "before", "digest").agg(F.first("text").alias("text"))
    kept = null_safe_join(written.where(F.col("digest").isNotNull()), texts, ["conv", "before", "digest"])
    edit = F.when(F.col("role") == F.col("before"), "keep").otherwise("rerole")
    return kept.select("conv", "block", "line", "role", "text", edit.alias("edit")).unionByName(
        inserted.withColumns({"text": F.lit(""), "edit": F.lit("insert")}))


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation, joined by newlines.

    SHA-256 runs over a conversation from its beginning to its end, so its
    lines pass one task, in order, a batch at a time; none is held.
    """
    kind = lines.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("sha256", T.StringType())])
    dealt = (lines.select("conv", "block", "line", F.concat("role", F.lit(":"), "text").cast("binary").alias("said"))
             .repartition(F.col("conv")).sortWithinPartitions("conv", "block", "line"))

    def digests(batches):
        now, state = None, None
        for batch in batches:
            found, sums = [], []
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(3)):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        found.append(now)
                        sums.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                state.update(said.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field(0).type), pa.array(sums, pa.string())],
                                             names=["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type),
                                              pa.array([state.hexdigest()], pa.string())], names=["conv", "sha256"])
    return dealt.mapInArrow(digests, schema)


def report(conversations: DataFrame, damaged: DataFrame, conv_col: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """A row for every id of ``conversations``, with the audit and the digest of the repair of its ``damaged`` rows."""
    audits, lines, _ = repair(damaged, block)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = (conversations.select(F.col(conv_col).alias("conv"))
             .unionByName(audits, allowMissingColumns=True).unionByName(line_digests(lines), allowMissingColumns=True))
    return parts.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")).withColumnRenamed(
        "conv", conv_col)
