"""Exact, SimHash and substring de-duplication against brute force."""
from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F
from seqyield.llm import exact_dedup, simhash_dedup, substring_dedup
from tests.llm import data


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append((-len(text or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("k", [1, 2, 1024])
def test_exact_groups_match_brute_force(spark, k):
    docs = data.frame(spark)
    rows = [(r[0], r[1]) for r in data.rows()]
    want = brute_groups(rows)
    got = exact_dedup.duplicate_groups(docs, k=k).collect()
    expected = Counter((i, *want[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.remove_duplicates(docs, k=k)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(keep for keep, _ in want.values())


def test_exact_hot_group_and_every_k(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_groups(rows)
    for k in (1, 3, 50):
        got = exact_dedup.duplicate_groups(docs, k=k).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, *want[normal(t)]) for i, t in rows}


def test_misra_gries_keeps_every_frequent_item():
    rng = random.Random(4)
    items = [b"hot"] * 400 + [b"warm"] * 250 + [bytes([65 + rng.randrange(26), rng.randrange(200)]) for _ in range(900)]
    rng.shuffle(items)
    batches = [pa.RecordBatch.from_pydict({"d": pa.array(items[i:i + 100], pa.binary())}) for i in range(0, len(items), 100)]
    k = 8
    found = exact_dedup.misra_gries(iter(batches), k)
    true = Counter(items)
    assert len(found) <= k
    assert all(d in found for d, n in true.items() if n > len(items) / (k + 1))
    assert all(true[d] - len(items) / (k + 1) <= n <= true[d] for d, n in found.items())


def test_exact_on_an_empty_table(spark):
    assert exact_dedup.duplicate_groups(data.empty(spark)).count() == 0
    assert exact_dedup.remove_duplicates(data.empty(spark)).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, ids, bits=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, name in enumerate(ids):
        root = find(i)
        least[root] = min((x for x in (least.get(root), name) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark):
    rows = [(r[0], r[1]) for r in data.rows()]
    got = simhash_dedup.near_duplicate_classes(data.frame(spark)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components(prints, [i for i, _ in rows])))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash_dedup.remove_near_duplicates(data.frame(spark))
    assert kept.columns == data.frame(spark).columns
    assert kept.count() == len({c if c is not None else ("p", p) for _, p, c in want})


def test_spark_xxhash64_is_the_shingle_hash(spark):
    assert spark.sql("select xxhash64('the quick brown')").head()[0] % 2**64 == xxhash.xxh64_intdigest(b"the quick brown", 42)


@pytest.mark.parametrize("seed", range(4))
def test_shard_links_lose_no_pair(seed):
    """Clusters with chains of near fingerprints: the trees find the same components as all pairs."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(5):
        flips = np.uint64(1) << rng.integers(0, 64, len(points), dtype=np.uint64)
        points = np.unique(np.concatenate([points, points ^ flips]))[:1500]
    nodes = simhash_dedup.fit_tree(points[::3], 2, 40)
    shards = defaultdict(list)
    for shard, some in simhash_dedup.assign(points, nodes, 2):
        shards[shard].append(some)
    assert len(shards) > 1
    edges = [e for parts in shards.values() for e in zip(*simhash_dedup.link_shard(np.concatenate(parts), 2, 32))]
    parent = {int(p): int(p) for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for a, b in edges:
        assert (int(a) ^ int(b)).bit_count() >= 1
        parent[find(int(a))] = find(int(b))
    ids = [int(p) for p in points]
    want = components(ids, ids)
    got = [find(p) for p in ids]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    both = chain.unionByName(spark.createDataFrame([(1000, 1001), (1002, 1001)], "a long, b long"))
    got = {r.v: r.root for r in simhash_dedup.components(both).collect()}
    assert got == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_simhash_on_an_empty_table(spark):
    assert simhash_dedup.near_duplicate_classes(data.empty(spark)).count() == 0
    assert simhash_dedup.remove_near_duplicates(data.empty(spark)).count() == 0


def test_gear_depends_on_its_window_only():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 500, dtype=np.uint8)
    hashes = substring_dedup.gear(text)
    slow = [sum(int(substring_dedup._GEAR[text[i - j]]) << j for j in range(32) if i >= j) % 2**32 for i in range(500)]
    assert hashes.tolist() == slow
    assert (substring_dedup.gear(np.concatenate([text[:77], text]))[77 + 31:] == hashes[31:]).all()


def test_chunks_cover_each_text_and_respect_characters():
    texts = ["".join(random.Random(i).choice("abc é日🙂 \n") for _ in range(n)).encode() for i, n in enumerate((0, 1, 31, 900, 5000))]
    texts.append(b"z" * 10000)
    for text, ends in zip(texts, substring_dedup.chunk_ends(texts)):
        assert (ends[-1:] == len(text)).all() and bool(len(ends)) == bool(text)
        sizes = np.diff(ends, prepend=0)
        assert (sizes > 0).all() and (sizes <= substring_dedup.LONGEST + 3).all()
        at = 0
        for end in ends:
            text[at:end].decode()
            at = end
    alone = substring_dedup.chunk_ends([texts[3]])[0]
    assert (alone == substring_dedup.chunk_ends(texts)[3]).all()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 60), prose(rng, 300)
    rows = [(i, prose(rng, 200)) for i in range(30)]
    holders = [3, 7, 12, 25]
    for i in holders:
        rows[i] = (i, f"{prose(rng, i)} {passage} {prose(rng, 40)}")
    rows[20] = (20, other)
    rows[21] = (21, prose(rng, 5) + other + "tail " + prose(rng, 30))   # shifted by an insertion
    rows += [(40, None), (41, ""), (None, f"x {passage}"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.passages(docs).collect()
    found = Counter(r.doc_id for r in got)
    assert set(found) == {7, 12, 25, 21, None, 3}   # of the copies of row 3 the second is a repeat
    texts = {i: t for i, t in rows}
    for r in got:
        cut = texts[r.doc_id][r.start:r.start + r.length]
        assert len(cut) == r.length and r.n_words >= substring_dedup.MIN_WORDS - 4
        assert r.originals == ([20] if r.doc_id == 21 else [3])
        assert any(cut in texts[o] for o in r.originals)
    cleaned = substring_dedup.without_passages(docs).collect()
    lost = Counter()
    for r in got:
        lost[r.doc_id] += r.length
    for r in cleaned:
        if r.doc_id not in (3, None):
            assert len(texts[r.doc_id] or "") - len(r.text or "") == lost[r.doc_id]
    assert passage in {r.doc_id: r.text for r in cleaned if r.doc_id != 3}.get(3, texts[3])


def test_substring_awkward_rows(spark):
    docs = data.frame(spark)
    got = substring_dedup.passages(docs)
    assert {r.doc_id for r in got.collect()} >= {8}
    assert substring_dedup.without_passages(docs).columns == docs.columns
    assert substring_dedup.passages(data.empty(spark)).count() == 0
    assert substring_dedup.without_passages(data.empty(spark)).count() == 0


def longest_shared(text, other):
    """(start, end) of the longest piece of ``text`` that ``other`` holds, by growing it character by character."""
    best = (0, 0)
    start = 0
    for end in range(1, len(text) + 1):
        while text[start:end] not in other:
            start += 1
        if end - start > best[1] - best[0]:
            best = (start, end)
    return best


@pytest.mark.parametrize("letters, words", [((1, 5), 60), ((2, 7), 51), ((2, 9), 51), ((2, 9), 130)])
def test_passages_reach_their_true_ends(spark, letters, words):
    rng = random.Random(words * letters[1])
    write = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(*letters))) for _ in range(n))
    rows = []
    for i in range(120):
        passage = write(words)
        rows += [(2 * i, f"{write(40)} {passage} {write(30)}"), (2 * i + 1, f"{write(rng.randint(0, 50))} {passage} {write(20)}")]
    got = defaultdict(list)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r.doc_id].append((r.start, r.start + r.length))
    assert not [i for i in got if i % 2 == 0]
    texts = dict(rows)
    exact = [longest_shared(texts[i], texts[i - 1]) for i in range(1, 240, 2)]
    missed = [i for i, _ in enumerate(exact) if 2 * i + 1 not in got]
    assert len(missed) <= (2 if letters == (1, 5) else 0)   # a passage without two cuts can't be met by chunks
    assert sum(got[2 * i + 1] == [span] for i, span in enumerate(exact)) >= 118 - len(missed)


def test_passages_of_texts_without_blanks(spark):
    rng = random.Random(3)
    chinese = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    base64 = lambda n: "".join(rng.choice("ABCDEFGHabcdefgh0123+/") for _ in range(n))
    rows = [(1, chinese(300)), (3, base64(3000)), (5, chinese(400))]
    rows += [(2, chinese(40) + rows[0][1][100:200] + chinese(70)), (4, base64(50) + rows[1][1][500:1400] + base64(100))]
    got = {(r.doc_id, r.start, r.length): r for r in substring_dedup.passages(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    want = {(i, *longest_shared(texts[i], texts[o])) for i, o in ((2, 1), (4, 3))}
    assert {(i, start, start + length) for i, start, length in got} == want
    assert all(r.n_words >= 100 for r in got.values() if r.doc_id == 2)


def test_agreement_keeps_whole_characters():
    one, two = "aé日".encode(), "bé曥".encode()
    assert substring_dedup.agreement(one, one, True) == len(one)
    assert substring_dedup.agreement("日x".encode(), "旦x".encode(), False) == 0   # the first two bytes agree
    assert substring_dedup.agreement("x日".encode(), "x旦".encode(), False) == 1
    assert substring_dedup.agreement("éz".encode(), "ùz".encode(), True) == 1
    assert substring_dedup.agreement(one[:3], two[:3], True) == 2
    assert substring_dedup.agreement(b"", one, True) == 0


def test_passages_with_a_hot_original_and_repeats_inside_a_text(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 5)} {passage} {prose(rng, 5)}") for i in range(300)]
    rows.append((900, f"{prose(rng, 30)}\n" + prose(rng, 80) + "\n" + " - ".join([prose(rng, 70)] * 3)))
    got = defaultdict(list)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {*range(1, 300), 900}
    texts = dict(rows)
    for i in range(1, 300):
        assert len(got[i]) == 1 and passage in texts[i][got[i][0].start:got[i][0].start + got[i][0].length]
        assert 0 in got[i][0].originals   # a chunk across the end may agree by chance with another copy only
    assert sum(r.length for r in got[900]) >= 2 * 70 * 5
