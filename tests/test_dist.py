from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from seqyield.operators import dist


def _lengths(spark, n=2000, seed=8):
    rng = random.Random(seed)
    vals = [rng.randint(1, 30000) for _ in range(n)]
    return spark.createDataFrame([(v,) for v in vals], "sequence_length_template long"), vals


def test_weighted_histogram_matches_numpy(spark):
    df, vals = _lengths(spark)
    got = sorted((r["bin"], r["bases"]) for r in dist.weighted_histogram(df).collect())
    edges = np.linspace(0, max(vals), 50)
    counts, _ = np.histogram(vals, bins=edges, weights=vals)
    assert len(got) == 49
    assert [b for _, b in got] == pytest.approx(list(counts))


def test_histogram_fd_bins_match_numpy(spark):
    df, vals = _lengths(spark, n=3000)
    got = sorted((r["bin"], r["reads"]) for r in dist.histogram(df, "sequence_length_template").collect())
    a = np.asarray(vals, dtype=float)
    iqr = np.subtract(*np.percentile(a, [75, 25]))
    h = 2 * iqr / len(a) ** (1 / 3)
    nb = min(int(np.ceil((a.max() - a.min()) / h)), 50)
    counts, _ = np.histogram(a, bins=nb)
    assert [c for _, c in got] == list(counts)


def test_kde_matches_direct_sum(spark):
    rng = random.Random(5)
    vals = [round(rng.gauss(10, 2), 2) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in vals], "q double")
    got = sorted((r["point"], r["x"], r["density"]) for r in dist.kde_1d(df, "q").collect())
    a = np.asarray(vals)
    q75, q25 = np.percentile(a, [75, 25])
    bw = 1.059 * min(a.std(ddof=1), (q75 - q25) / 1.349) * len(a) ** (-0.2)
    grid = np.linspace(a.min() - 3 * bw, a.max() + 3 * bw, 100)
    dens = np.exp(-0.5 * ((grid[:, None] - a[None, :]) / bw) ** 2).sum(axis=1) / (len(a) * bw * math.sqrt(2 * math.pi))
    assert [x for _, x, _ in got] == pytest.approx(list(grid), rel=1e-9)
    assert [d for _, _, d in got] == pytest.approx(list(dens), rel=1e-9)
    assert sum(d for _, _, d in got) * (grid[1] - grid[0]) == pytest.approx(1.0, abs=0.02)


def test_hexbin_counts_every_row(spark):
    rng = random.Random(6)
    rows = [(rng.uniform(0, 500), rng.uniform(0, 20)) for _ in range(2000)] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    h = dist.hexbin(df, "x", "y", gridsize=20)
    assert sum(r["reads"] for r in h.collect()) == 2000


def test_pair_sample_equals_full_sort(spark):
    rng = random.Random(12)
    rows = [(f"r{i}", rng.uniform(0, 8), rng.random() * 20, i % 50, rng.uniform(0, 30), "Passed") for i in range(5000)]
    df = spark.createDataFrame(rows, "read_id string, events_ratio double, mean_qscore_template double, "
                                     "sequence_length_template long, pore_speed double, qualitative_pass string")
    got = [r["read_id"] for r in dist.pair_sample(df, k=300).collect()]
    keep = [r for r in rows if r[1] < 5]
    expect = sorted(keep, key=lambda r: (hashlib.md5(("seqyield" + r[0]).encode()).hexdigest(), r[0]))[:300]
    assert sorted(got) == sorted(r[0] for r in expect)
    # fewer rows than k: all of them
    assert dist.pair_sample(df.limit(10), k=300).count() == sum(1 for r in rows[:10] if r[1] < 5)


def test_binned_trend_line_and_centres(spark):
    rows = [("Passed", float(x), 2.0 * x + 1.0) for x in range(1, 1001)]
    df = spark.createDataFrame(rows, "qualitative_pass string, t double, y double")
    out = dist.binned_trend(df, "t", "y").collect()
    assert len(out) == 10
    assert all(r["slope"] == pytest.approx(2.0) and r["intercept"] == pytest.approx(1.0) for r in out)
    cents = sorted(r["x_centre"] for r in out)
    assert cents == pytest.approx(list(np.percentile(np.arange(1, 1001), np.linspace(0, 100, 12)[1:-1])))


def test_quality_ridges_labels(spark):
    rows = [(float(t), 8.0 + (t % 7)) for t in range(0, 7200, 3)]
    df = spark.createDataFrame(rows, "start_time_float_by_sample double, mean_qscore_template double")
    tb = dist.time_bins(df)
    labels = sorted({r["time_bin_label"] for r in tb.collect()})
    assert "0 - 00:07" in labels and len(labels) == 16


def test_kde_2d_is_the_direct_sum(spark):
    rng = random.Random(21)
    rows = [(rng.gauss(0, 1), rng.gauss(5, 2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = {(r["i"], r["j"]): r["density"] for r in dist.kde_2d(df, "x", "y", gridsize=30).collect()}
    a = np.asarray(rows)
    n = len(a)

    def bw(v):
        q75, q25 = np.percentile(v, [75, 25])
        return 1.059 * min(v.std(ddof=1), (q75 - q25) / 1.349) * n ** (-0.2)
    bx, by = bw(a[:, 0]), bw(a[:, 1])
    gx = np.linspace(a[:, 0].min() - 3 * bx, a[:, 0].max() + 3 * bx, 30)
    gy = np.linspace(a[:, 1].min() - 3 * by, a[:, 1].max() + 3 * by, 30)
    kx = np.exp(-0.5 * ((gx[:, None] - a[None, :, 0]) / bx) ** 2)
    ky = np.exp(-0.5 * ((gy[:, None] - a[None, :, 1]) / by) ** 2)
    z = kx @ ky.T / (n * bx * by * 2 * math.pi)
    assert len(got) == 900
    for (i, j), d in got.items():
        assert d == pytest.approx(z[i, j], rel=1e-9, abs=1e-300)


def test_kde_by_group_is_exact(spark):
    rng = random.Random(15)
    rows = [("big" if i % 10 else "small", rng.gauss(10, 2)) for i in range(3000)]
    got = dist.kde_1d(spark.createDataFrame(rows, "g string, q double"), "q", by=["g"]).collect()
    for g in ("big", "small"):
        a = np.asarray([v for k, v in rows if k == g])
        q75, q25 = np.percentile(a, [75, 25])
        bw = 1.059 * min(a.std(ddof=1), (q75 - q25) / 1.349) * len(a) ** (-0.2)
        grid = np.linspace(a.min() - 3 * bw, a.max() + 3 * bw, 100)
        dens = np.exp(-0.5 * ((grid[:, None] - a[None, :]) / bw) ** 2).sum(axis=1) / (len(a) * bw * math.sqrt(2 * math.pi))
        mine = sorted((r["point"], r["density"]) for r in got if r["g"] == g)
        assert [d for _, d in mine] == pytest.approx(list(dens), rel=1e-9)


def test_trend_with_many_groups(spark):
    rows = [(f"g{i % 200}", float(i), float(i % 7)) for i in range(4000)]
    out = dist.binned_trend(spark.createDataFrame(rows, "qualitative_pass string, t double, y double"), "t", "y")
    assert out.select("group").distinct().count() == 200
    assert out.agg({"reads": "sum"}).head()[0] == 4000
