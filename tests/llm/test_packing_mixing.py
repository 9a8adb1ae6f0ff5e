"""Packing against the tokenizers library and a bound; mixing against level filling in plain Python."""
from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from seqyield.llm import mixing, packing
from tests.conftest import SF01
from tests.llm import data

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, packing.END]


def check_placement(rows, length=packing.LENGTH):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return len(by)


def test_pieces_and_places(spark, exact):
    rows = [(r[0], r[1] or "") for r in data.rows()]
    packed = packing.pack(data.frame(spark))
    got = packed.collect()
    want = Counter()
    for i, text in rows:
        ids = np.array(exact(text), "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), packing.LENGTH)):
            want[i, k, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(n * k for (_, _, _, n, _), k in want.items())
    assert -(-total // packing.LENGTH) <= check_placement(got) <= -(-total // packing.LENGTH) + 1
    again = packing.pack(data.frame(spark), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in again)
    assert packing.pack(data.empty(spark)).count() == 0


@pytest.mark.parametrize("shard", [5, 1 << 16])
def test_shards_pack_a_whole_table(spark, shard):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = packing.pack(docs, shard=shard if shard > 100 else 200).collect()
    bins, total = check_placement(got), sum(r.length for r in got)
    assert bins <= 1.02 * total / packing.LENGTH + len(got) / 100
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += r.length
    assert len(by) == docs.count()


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]),
                                    (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, want):
    assert packing.cut(n, 1024) == want


def test_best_two_replaces_the_smallest():
    # 60 fills greedily with 30 (gap 10); 22 + 18 fill the 40 better.
    sequence, offset = packing.best_two_fit(np.array([60, 30, 22, 18, 25]), 100)
    first = {int(n) for n, s in zip([60, 30, 22, 18, 25], sequence) if s == sequence[0]}
    assert first == {60, 22, 18} and offset[0] == 0


def test_best_two_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        stock = packing.Stock(np.array(lengths), 64)
        above, upto = sorted((rng.randint(1, 60), rng.randint(2, 64)))
        pairs = [a + b for i, a in enumerate(lengths) for b in lengths[:i] if above < a + b <= upto]
        found = stock.best_two(above, upto)
        assert (sum(found) if found else None) == max(pairs, default=None)


def test_both_encoders_agree_on_every_letter_they_share(exact):
    letters = [chr(c) for c in range(0x250) if packing._LATIN.fullmatch(chr(c))]
    rng = random.Random(5)
    texts = [f"{a}{b} {a}1{b}  {b}'s\n{a}" for a in letters for b in rng.sample(letters, 3)]
    texts += ["".join(rng.choices(letters + [" "] * 40, k=60)) for _ in range(2000)]
    texts += ["<|endoftext|> x", "a" * 3000, " " * 500 + "x", " \u0085 ­", "don't we'll I'VE"]
    for text in texts:
        assert packing.token_ids(text, PATH).tolist() == exact(text), repr(text)


@pytest.mark.parametrize("blanks", [" " * 10**6, "\n" * 10**6, " \n" * 5 * 10**5, " " * (packing.BLANKS - 1)])
def test_long_runs_of_blanks_have_their_ids(exact, blanks):
    text = f"word{blanks}next"
    assert packing.token_ids(text, PATH).tolist() == exact(text)


def level_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, amount, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if amount * weight[s] / total >= cap * sizes[s]}
        if not over:
            target.update({s: amount * weight[s] / total for s in open_})
            break
        target.update({s: float(cap * sizes[s]) for s in over})
        amount -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_copies(spark):
    docs = data.frame(spark)
    rows = [(r[0], r[1], r[3]) for r in data.rows()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = level_targets(sizes)
    got = mixing.mixed(docs)
    assert got.columns[:-1] == docs.columns and got.columns[-1] == "_mix"
    got = got.select("doc_id", "source", "_mix.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r["source_size"] == sizes[r.source]
        assert r.copies in (int(r.rate), int(r.rate) + (r.rate % 1 > 0)) and r.copies <= 2
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    assert got and sorted(map(tuple, mixing.mixed(docs).select("doc_id", "source", "_mix.*").collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixed(data.empty(spark)).count() == 0 and mixing.mix(data.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_level_filling_of_random_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10**6, 10**9]) * rng.randint(1, 9) for i in range(rng.randint(1, 25))}
    sizes[None] = rng.randint(0, 10**7)
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = level_targets(sizes)
    for r in mixing.source_targets(table).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(4)).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).cast("int")).alias("text"))
    got = mixing.mixed(docs).groupBy("source").agg(F.first("mix.target").alias("target"),
                                                   F.sum(F.col("mix.copies") * F.col("mix.size")).alias("taken"))
    for r in got.collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)
