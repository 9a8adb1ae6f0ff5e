"""Poisson bootstrap, line bands and density contours against plain numpy and Python."""
from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from seqyield.operators import dist


def reads(spark, n=900, seed=2):
    rng = random.Random(seed)
    rows = [(str(i), g, x, 3.0 + 0.01 * x * (g == "Passed") + rng.gauss(0, 1)) for i in range(n)
            for g in [rng.choice(["Passed", "Failed"])] for x in [rng.uniform(0, 500)]]
    rows += [("n1", "Passed", None, 1.0), ("n2", "Failed", 1.0, float("nan")), (None, "Failed", 2.0, 2.5)]
    return rows, spark.createDataFrame(rows, "read_id string, qualitative_pass string, t double, y double").repartition(5)


def weights(ids, replicates):
    half = [(int(h[:8], 16) % dist.PRIME, int(h[8:16], 16) % dist.PRIME)
            for h in (hashlib.md5(f"bootstrap-1:{i or ''}".encode()).hexdigest() for i in ids)]
    return dist.poisson_weights(np.array([a for a, _ in half]), np.array([b for _, b in half]), replicates).astype(float)


def test_weights_are_poisson():
    rng = np.random.default_rng(0)
    w = dist.poisson_weights(rng.integers(0, dist.PRIME, 4000), rng.integers(0, dist.PRIME, 4000), 50)
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.01
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    # Replicates are not copies of each other.
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1


def test_trend_and_band_match_numpy(spark):
    rows, df = reads(spark)
    replicates = 64
    got = {(r.group, round(r.x_centre, 6)): r for r in dist.binned_trend(df, "t", "y", replicates=replicates).collect()}
    band = {(r.group, r.point): r for r in dist.trend_band(df, "t", "y", replicates=replicates, points=5).collect()}
    for g in ("Passed", "Failed"):
        mine = [(i, x, y) for i, p, x, y in rows if p == g and x is not None and not math.isnan(y)]
        x, y = np.array([m[1] for m in mine]), np.array([m[2] for m in mine])
        w = weights([m[0] for m in mine], replicates)
        centres = np.quantile(x, [k / 11 for k in range(1, 11)])
        nearest = np.searchsorted((centres[1:] + centres[:-1]) / 2, x, side="left")
        for k, c in enumerate(centres):
            inside = nearest == k
            means = (w[inside] * y[inside, None]).sum(0) / w[inside].sum(0)
            r = got[g, round(c, 6)]
            assert (r.reads, round(r.y_mean, 9)) == (inside.sum(), round(y[inside].mean(), 9))
            assert np.allclose([r.ci_low, r.ci_high], np.quantile(means, [0.025, 0.975]))
            assert r.ci_low <= r.y_mean <= r.ci_high
        grid = np.linspace(x.min(), x.max(), 5)
        fits = [np.polyfit(x, y, 1, w=np.sqrt(w[:, b])) for b in range(replicates)]
        lines = np.array([np.polyval(f, grid) for f in fits])
        for k in range(5):
            r = band[g, k]
            assert np.allclose([r.y_low, r.y_high], np.quantile(lines[:, k], [0.025, 0.975]))
            assert np.isclose(r.y_fit, np.polyval(np.polyfit(x, y, 1), grid[k]))


def test_bootstrap_width_is_that_of_the_mean(spark):
    """The interval is about as wide as the normal one on well-behaved data."""
    _, df = reads(spark, n=4000)
    for r in dist.binned_trend(df, "t", "y", replicates=400).collect():
        assert 0.7 < (r.ci_high - r.ci_low) / (2 * 1.96 / math.sqrt(r.reads)) < 1.4


def test_trend_of_an_empty_table(spark):
    empty = reads(spark)[1].where("false")
    assert dist.binned_trend(empty, "t", "y").count() == 0
    assert dist.trend_band(empty, "t", "y").count() == 0


def grid_of(values):
    return [("x", "y", i, j, float(i), 2.0 * j, v) for i, row in enumerate(values) for j, v in enumerate(row)]


def frame(spark, values):
    return spark.createDataFrame(grid_of(values), "x_var string, y_var string, i int, j int, x double, y double, density double")


def plain_segments(values, z):
    """Segments by walking each cell's border from corner to corner."""
    out = []
    for i in range(len(values) - 1):
        for j in range(len(values[0]) - 1):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            v = [values[a][b] for a, b in corners]
            cut = {}
            for k in range(4):
                (a, b), (c, d), p, q = corners[k], corners[(k + 1) % 4], v[k], v[(k + 1) % 4]
                if (p >= z) != (q >= z):
                    t = (z - p) / (q - p)
                    cut[k] = (a + t * (c - a), 2 * (b + t * (d - b)))
            if len(cut) == 2:
                out.append(frozenset((round(x, 9), round(y, 9)) for x, y in cut.values()))
            elif len(cut) == 4:
                joined = (v[0] >= z) == (sum(v) / 4 >= z)
                for one, two in ((0, 1), (2, 3)) if joined else ((0, 3), (1, 2)):
                    out.append(frozenset((round(x, 9), round(y, 9)) for x, y in (cut[one], cut[two])))
    return sorted(out, key=sorted)


@pytest.mark.parametrize("seed", range(4))
def test_contours_match_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.uniform(0, 1, (7, 6)).tolist() if seed else [[0.0, 1.0, 0.0], [1.0, 0.0, 1.0], [0.0, 1.0, 0.0]]
    z = 0.5
    levels = spark.createDataFrame([("x", "y", 0, 0.5, z)], "x_var string, y_var string, level int, mass double, density double")
    got = dist.contour_lines(frame(spark, values), levels).collect()
    mine = sorted((frozenset([(round(r.x0, 9), round(r.y0, 9)), (round(r.x1, 9), round(r.y1, 9))]) for r in got), key=sorted)
    assert mine == plain_segments(values, z)


def test_levels_hold_their_mass(spark):
    rng = np.random.default_rng(9)
    values = rng.uniform(0, 1, (12, 12))
    flat = np.sort(values.ravel())[::-1]
    levels = {r.mass: r for r in dist.density_levels(frame(spark, values.tolist())).collect()}
    assert set(levels) == set(dist.CONTOUR_MASSES)
    for mass, r in levels.items():
        assert values[values >= r.density].sum() >= mass * values.sum() > values[values > r.density].sum()
        assert r.density == flat[np.searchsorted(np.cumsum(flat), mass * flat.sum())]
    shaded = dist.shaded_cells(frame(spark, values.tolist()), dist.density_levels(frame(spark, values.tolist()))).collect()
    assert len(shaded) == (values >= levels[0.9].density).sum()
    assert all(r.shade == max(x.level for x in levels.values() if values[r.i][r.j] >= x.density) for r in shaded)
