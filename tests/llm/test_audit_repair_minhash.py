"""Filter audit, conversation repair and b-bit MinHash against brute force."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from seqyield.llm import conversation_repair as repair
from seqyield.llm import filter_audit, minhash_dedup
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit

def brute_masks(rows):
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    masks = []
    for i, t in rows:
        w = WORD.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 re.search(r"[#$%&*|]", t) is not None, i is not None and i > least[t]]
        masks.append(sum(1 << k for k, f in enumerate(fails) if f))
    return masks


def brute_audit(rows, labels):
    """rows (id, text, part) through all 120 orders, one row at a time."""
    masks = brute_masks([(i, t or "") for i, t, _ in rows])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p or "" for _, _, p in rows}:
            left = [(i, m) for (i, _, p), m in zip(rows, masks) if (p or "") == part]
            every = list(left)
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                lost = [(i, m) for i, m in left if m & bit]
                left = [(i, m) for i, m in left if not m & bit]
                out[part, order, step] = [len(left), len(lost), sum(1 for _, m in every if m & bit) - len(lost),
                                          sum(m == bit for _, m in every), sum(i in good for i, _ in lost),
                                          sum(i in toxic for i, _ in lost)]
                shapley[part, name] += len(lost)
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                               r.shapley) for r in df.collect()}


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    some = [(100 + i, " ".join(rng.choice(["alpha", "BETA", "$5", "x" + str(i % 4), "y"]) for _ in range(rng.randrange(220))),
             rng.choice(["de", None, ""])) for i in range(60)]
    rows = [(r[0], r[1], r[2] if r[0] != 5 else None) for r in data.rows()] + some
    rows += [(300 + i, "the same text", "hot") for i in range(150)] + [(300, "the same text", "hot"), (None, "the same text", "hot")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 400, 2)] + [(101, 0, 1), (None, 1, 1), (7, None, None)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("mask", T.StringType()),
                           T.StructField("id", T.StringType())])
    docs = spark.createDataFrame([(*r, "m", "i") for r in rows], schema).repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = collected(filter_audit.audit(docs, said))
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(data.empty(spark), labels).count() == 0
    assert filter_audit.audit(data.frame(spark), labels).count() == 600


@pytest.mark.parametrize("group", [1 << 26, 1 << 15])
def test_prepass_clears_unique_hashes_only(spark, monkeypatch, group):
    """No repeated hash is cleared, whatever the groups of segments; few of the others are held."""
    monkeypatch.setattr(filter_audit, "GROUP_BYTES", group)
    rng = np.random.default_rng(1)
    single = rng.integers(-(1 << 63), 1 << 63, 40000)
    hashes = np.concatenate([single, np.repeat(single[:50], 3), np.repeat(single[50:51], 5000)])
    rows = spark.createDataFrame([(int(h),) for h in hashes], "hash long").repartition(6)
    segments = -(-len(hashes) * filter_audit.PER_TEXT // filter_audit.SEGMENT)
    marked, paths = filter_audit.possible_repeats(rows, segments)
    assert len(paths) == (1 if group > 1 << 20 else segments)
    got = Counter((r.hash, r.maybe) for r in marked.collect())
    assert sum(got.values()) == len(hashes)
    repeated = set(single[:51].tolist())
    assert all(maybe for (h, maybe) in got if h in repeated)
    assert sum(n for (h, maybe), n in got.items() if maybe and h not in repeated) < 0.02 * len(single)


# ---- conversation repair

def damaged(rows):
    out = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        r = "user" if fate == 4 else r
        out += [(c, t, r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute_repair(rows):
    """(counts, cost, audit, lines) of one conversation's rows, by dynamic programming row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                      "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        new = defaultdict(list)
        for state, (cost, audit, lines) in best.items():
            for _ in range(3):
                new[state].append((cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    cut, to = int(fault == "truncated"), {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    new[to].append((cost + 2 + cut, audit + "R", (*lines, f"{ {2: 'user', 3: 'assistant'}[to] }:{text}")))
                    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)
                    if keep is not None:
                        new[keep].append((cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                cost, audit, lines, state = cost + 2, audit + "I", (*lines, f"{ {2: 'user', 3: 'assistant'}[to] }:"), to
        best = {s: min(x) for s, x in new.items()}
    ends = []
    for state, (cost, audit, lines) in best.items():
        more = {0: (), 3: (), 1: ("user:", "assistant:"), 2: ("assistant:",)}[state]
        ends.append((cost + 2 * len(more), audit + "I" * len(more), lines + more))
    cost, audit, lines = min(ends)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", "ünï 🙂.", "Why?\n", None, f"number {c} {t}."])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, None, "user", "Hm?")]
    rows += rows[3:9]
    return rows


def frame(spark, rows):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("conv", T.StringType()), T.StructField("digest", T.StringType()),
                           T.StructField("Block", T.StringType())])
    return spark.createDataFrame([(*r, "c", "d", "b") for r in rows], schema).repartition(4)


@pytest.mark.parametrize("block", [2, 256])
def test_repair_matches_row_by_row(spark, block):
    long = [(1000, i, "user" if i % 3 else "assistant", f"row {i % 17}." if i % 5 else f"row {i}") for i in range(90)]
    hot = [(1001, 7, "user", "again.")] * 40 + [(1001, 8, "assistant", "x" * 200_000 + ".")]
    rows = conversations() + long + hot
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    docs = frame(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(docs, repair.damage(docs), block=block).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c in got:
        want = brute_repair(by[c]) if by[c] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got[c] == want, c


def test_repaired_lines_are_wellformed(spark):
    rows = conversations(seed=9)
    audits, lines, _ = repair.repair(repair.plain(frame(spark, rows)))
    found = defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: (r.block, r.line)):
        found[r.conv].append(r)
    for r in audits.collect():
        mine = found[r.conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in mine))
        assert [x.edit[0].upper() for x in mine] == [x for x in r.audit if x != "D"]
        assert all(x.text == "" for x in mine if x.edit == "insert")


def test_repair_of_an_empty_table(spark):
    docs = frame(spark, [(1, 1, "user", "x")]).where("false")
    assert repair.report(docs, repair.damage(docs)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_one_split_gives_the_cell_of_all_splits(seed):
    """The joined spans hold what CYK over every interval and every split holds."""
    rng = random.Random(seed)
    rows = [(rng.choice("suat"), rng.randrange(3), rng.choice([1, 1, 1, 2, 4])) for _ in range(rng.randrange(1, 9))]
    chart = {(i, i + 1): repair.row_cell(*r) for i, r in enumerate(rows)}
    for width in range(2, len(rows) + 1):
        for i in range(len(rows) - width + 1):
            splits = [repair.join(chart[i, k], chart[k, i + width]) for k in range(i + 1, i + width)]
            chart[i, i + width] = tuple(repair._least(c[e] for c in splits) for e in range(16))
    assert repair.parse_rows(tuple(rows)) == chart[0, len(rows)]
    spelled = [x for i, a, n in rows for x in [(i, a, 1)] + [(i, repair.FORCED, 1)] * (n - 1)]
    assert repair.parse_rows(tuple(spelled)) == chart[0, len(rows)]


# ---- b-bit MinHash

def slow_set(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())


def brute_components(rows, percent=85):
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        root = find(i)
        least[root] = min((x for x in (least.get(root), name) if x is not None), default=None)
    return Counter((name, len(sets[i]), least[find(i)], name == least[find(i)]) for i, (name, _) in enumerate(rows))


def near_copies(seed=2):
    """Groups of copies changed by 0 to 12 words; chains; pairs around the wanted similarity."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            copy = list(base)
            for _ in range(rng.randrange(13)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy)))
            if rng.random() < 0.2:
                base = copy
    return rows


@pytest.mark.parametrize("side", [3000, minhash_dedup.SIDE])
def test_minhash_matches_brute_force(spark, side):
    rows = [(r[0], r[1]) for r in data.rows()] + near_copies()
    schema = data.SCHEMA
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "d", "s", "c", 5, "r", "m", "rr", "dd", "k") for i, t in rows], schema)
    got = minhash_dedup.near_duplicate_classes(docs.repartition(4), side=side).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(rows)


def test_minhash_hot_set_and_empty_table(spark):
    rows = [(i, "one text that a third of all rows share here") for i in range(3000)] + [(4000 + i, f"other {i} text {i}") for i in range(50)]
    got = minhash_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0}
    assert sum(r.kept for r in got) == 51
    assert minhash_dedup.near_duplicate_classes(data.empty(spark)).count() == 0
    kept = minhash_dedup.remove_near_duplicates(data.frame(spark))
    assert kept.columns == data.frame(spark).columns


def test_estimate_corrects_for_collisions():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, 2000 - len(common), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, x])) for x in own)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash_dedup.estimate(minhash_dedup.signature(a)[None], minhash_dedup.signature(b)[None])[0]
        assert abs(got - true) < 5 * (true * (1 - true) / 320) ** 0.5 + 0.01
    full = minhash_dedup.signature(a)
    assert minhash_dedup.equal_minima(full, full) == minhash_dedup.BANDS * minhash_dedup.ROWS


def test_tile_returns_a_forest():
    """Of many links between equal-like documents a tile keeps at most one less than there are documents."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:490], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(40)]
    sigs, sizes = np.stack([minhash_dedup.signature(s) for s in sets]), np.array([len(s) for s in sets])
    links = minhash_dedup.link_tile(sigs, sizes, lambda i: sets[i], np.arange(40), np.arange(40))
    assert len(links) == 39
    assert all(minhash_dedup.similar(sets[i], sets[j]) for i, j in links)


def test_batches_of_awkward_texts_give_whole_sets():
    for text in ("", " \t\n", "One", "one TWO", "a b c a b c a b c", "Ünï ünï x"):
        assert len(minhash_dedup.shingle_set(text.encode())) == len(slow_set(text))
