from __future__ import annotations

import contextlib
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqyield.functions.expr import hhmm, human_bases, zfill
from seqyield.operators import running, stats
from seqyield.operators.flowcell import flowcell_grid
from seqyield.operators.prefix import running_totals


def _reads(spark, n=1500, seed=1, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = 500.0 if (hot and i % 3 == 0) else round(rng.uniform(0, 10000), 3)   # a third share one time
        rows.append((f"id{rng.randint(0, 10**9):010d}_{i}", t, rng.randint(1, 40000), rng.random() < 0.6,
                     rng.randint(1, 30)))
    return spark.createDataFrame(rows, "read_id string, start_time_float_by_sample double, "
                                       "sequence_length_template long, pass boolean, channel int"), rows


def test_running_columns_match_pandas(spark):
    df, rows = _reads(spark)
    got = {r["read_id"]: r for r in running.running_columns(df).collect()}
    pdf = pd.DataFrame(rows, columns=["read_id", "t", "len", "pass", "channel"]).sort_values(["t", "read_id"])
    pdf = pdf.reset_index(drop=True)
    pdf["read_count"] = pdf.index + 1
    pdf["yield"] = pdf["len"].cumsum()
    pdf["channel_yield"] = pdf.groupby("channel")["len"].cumsum()
    pdf["quality_yield"] = pdf.groupby("pass")["len"].cumsum()
    pdf["quality_count"] = pdf.groupby("pass").cumcount() + 1
    for r in pdf.to_dict("records"):
        g = got[r["read_id"]]
        assert (g["read_count"], g["yield"], g["channel_yield"], g["quality_yield"], g["quality_count"]) == \
            (r["read_count"], r["yield"], r["channel_yield"], r["quality_yield"], r["quality_count"])


def test_plan_moves_rows_once(spark):
    """One range shuffle while the buckets are written; afterwards only bucket totals move."""
    df, _ = _reads(spark, n=300)
    out = running_totals(df, ["start_time_float_by_sample", "read_id"], {"y": "sequence_length_template"})
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    rows, totals = buf.getvalue().split("BroadcastExchange", 1)
    assert "Exchange" not in rows and "Window" not in rows
    assert "SinglePartition" in totals            # at most one row a bucket


def test_running_totals_with_nulls_and_floats(spark):
    rows = [(None, 1, 0.5), (None, 2, None), ("a", 1, 0.25), ("a", 3, 1.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    got = {(r["g"], r["t"]): r["s"] for r in running_totals(df, ["t"], {"s": "v"}, by=["g"], n_buckets=4).collect()}
    assert got == {(None, 1): 0.5, (None, 2): 0.5, ("a", 1): 0.25, ("a", 2): 0.25, ("a", 3): 1.25}
    assert running_totals(df.limit(0), ["t"], {"s": "v"}).count() == 0


def test_equal_times_ordered_by_id(spark):
    df = spark.createDataFrame([("c", 5.0, 1), ("a", 5.0, 1), ("b", 5.0, 1)],
                               "read_id string, start_time_float_by_sample double, sequence_length_template long")
    got = {r["read_id"]: r["read_count"] for r in running.running_count(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_curves_end_at_totals(spark):
    df, rows = _reads(spark, hot=False)
    df = df.withColumn("qualitative_pass", F.when(F.col("pass"), "Passed").otherwise("Failed"))
    y = running.yield_curve(df, by_quality=True, bin_seconds=600)
    last = {r["series"]: r["yield"] for r in y.groupBy("series").agg(F.max("yield").alias("yield")).collect()}
    assert last["All"] == sum(r[2] for r in rows)
    assert last["Passed"] + last["Failed"] == last["All"]
    c = running.reads_curve(df, by_quality=True, bin_seconds=600)
    lastc = {r["series"]: r["m"] for r in c.groupBy("series").agg(F.max("read_count").alias("m")).collect()}
    assert lastc["All"] == len(rows) == lastc["Passed"] + lastc["Failed"]


def _nx(spark, lengths, mode):
    df = spark.createDataFrame([(x,) for x in lengths], "sequence_length_template long")
    return [(r["label"], r["value"]) for r in stats.nx_values(df, mode=mode).orderBy("label").collect()]


def test_nx_compat_cases(spark):
    """Lists worked out by hand.

    1, 1, 100 (total 102): for 10.2 the second read is under the target (2) and the third reaches it;
    for 25.5 only the last read would do, which has no next one, so the list ends.
    1..100: the picked lengths stand where the cumulative sum n(n+1)/2 passes 505, 1262.5, 2525, 3787.5, 4545.
    """
    assert [v for _, v in _nx(spark, [100, 1, 1], "compat")] == [1]
    assert [v for _, v in _nx(spark, list(range(1, 101)), "compat")] == [31, 49, 70, 86, 94]
    # Ten reads of 10: the sums 10, 20, ... meet the targets 10, 25, 50, 75 and 90 at reads 1, 2, 4 or 5, 7, 8 or 9.
    assert _nx(spark, [10] * 10, "compat") == [("N10", 10), ("N25", 10), ("N50", 10), ("N75", 10), ("N90", 10)]
    # 4, 4, 8, 84 (sums 4, 8, 16, 100): 10 lies between 8 and 16, 25 between 16 and 100, 50 would need the last read.
    assert _nx(spark, [84, 8, 4, 4], "compat") == [("N10", 4), ("N25", 8)]
    assert _nx(spark, [], "compat") == [] and _nx(spark, [], "standard") == []


def test_nx_by_group(spark):
    df = spark.createDataFrame([("a", x) for x in range(1, 101)] + [("b", x) for x in (100, 1, 1)], "g string, sequence_length_template long")
    for mode in ("compat", "standard"):
        got = {(r["g"], r["label"]): r["value"] for r in stats.nx_values(df, mode=mode, by="g").collect()}
        for g, lengths in (("a", list(range(1, 101))), ("b", [100, 1, 1])):
            assert {k: v for (h, k), v in got.items() if h == g} == dict(_nx(spark, lengths, mode))


def test_report_keeps_the_original_time_origin(spark):
    """The trim removes the earliest read: the filtered duration still counts from it."""
    rows = [("r0", 0.0, 10**6, 1.0), *[(f"r{i}", 100.0 + i, 1000 + i, 1.0) for i in range(1, 1001)]]
    df = spark.createDataFrame(rows, "read_id string, start_time_float_by_sample double, sequence_length_template long, events_ratio double") \
        .withColumn("mean_qscore_template", F.lit(9.5)).withColumn("sample_id", F.lit("S1"))
    from seqyield.operators.trim import trim_reads
    kept = trim_reads(df)
    assert kept.where("read_id = 'r0'").count() == 0
    rep = {(r["stage"], r["section"], r["label"]): (r["value"], r["human"]) for r in
           stats.run_report({"unfiltered": df, "filtered": kept}).collect()}
    last = kept.agg(F.max("start_time_float_by_sample")).head()[0]
    assert rep["filtered", "duration", "seconds"][0] == last > 1000
    assert rep["unfiltered", "duration", "seconds"] == (1100.0, "0 hours, 18 minutes, 20 seconds")
    assert rep["filtered", "sample", "id"] == (None, "S1")


def test_nx_standard_brute_force(spark):
    rng = random.Random(9)
    lengths = [rng.randint(1, 5000) for _ in range(1000)]
    s = sorted(lengths, reverse=True)
    total = sum(s)
    exp = []
    for p in (0.1, 0.25, 0.5, 0.75, 0.9):
        cum = 0
        for v in s:
            cum += v
            if cum >= p * total:
                exp.append(v)
                break
    assert [v for _, v in _nx(spark, lengths, "standard")] == exp


def test_describe_matches_pandas(spark):
    rng = random.Random(2)
    vals = [rng.gauss(10, 3) for _ in range(999)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "q double")
    got = {r["stat"]: r["value"] for r in stats.describe(df, "q").collect()}
    d = pd.Series([v for v in vals if v is not None]).describe(percentiles=[0.1, 0.25, 0.5, 0.75, 0.9])
    for k in ["count", "mean", "std", "min", "10%", "25%", "50%", "75%", "90%", "max"]:
        assert got[k] == pytest.approx(round(d[k], 2), abs=1e-9)


def test_scalar_formatters(spark):
    df = spark.createDataFrame([(0, 0.0), (999, 3599.0), (1000, 3600.0), (1500, 366000.0), (2340000, 61.0),
                                (123456, 59.9)], "n long, s double")
    got = df.select("n", human_bases("n").alias("h"), hhmm("s").alias("t"), zfill("n", 5).alias("z")).collect()
    h = {r["n"]: (r["h"], r["t"], r["z"]) for r in got}
    assert h[999] == ("999b", "00:59", "00999")
    assert h[1000] == ("1 Kb", "01:00", "01000")
    assert h[1500] == ("1.5 Kb", "101:40", "01500")
    assert h[2340000][0] == "2.34 Mb"
    assert h[0][1] == "0"
    assert h[123456][2] == "123456"          # zero fill never truncates


def test_pearson_p_value():
    assert stats.pearson_p_value(0.0, 10) == pytest.approx(1.0)
    assert stats.pearson_p_value(0.5, 10) == pytest.approx(0.141, abs=1e-3)
    assert stats.pearson_p_value(1.0, 10) == 0.0
    # t = 1 has the tail of the normal distribution in the limit
    for n in (10**10, 10**12, 10**15):
        r = 1 / (n - 1) ** 0.5
        assert stats.pearson_p_value(r, n) == pytest.approx(0.31731050786, rel=1e-8)
    # both forms agree where one takes over from the other
    for r in (0.01, 0.05, 0.1, 0.2):
        import math
        df = stats.NORMAL_FROM
        t2 = r * r * df / (1 - r * r)
        assert stats.pearson_p_value(r, df + 2) == pytest.approx(stats.betainc_reg(df / 2, 0.5, df / (df + t2)), rel=1e-9)
        assert math.isfinite(t2)


def test_flowcell_positions(spark):
    chans = [1, 10, 11, 250, 251, 3000]
    df = spark.createDataFrame([(c, 1) for c in chans], "channel int, sequence_length_template long")
    grid = flowcell_grid(df)
    assert grid.count() == 3000
    cells = {r["channel"]: (r["row"], r["col"]) for r in grid.where("bases > 0").collect()}
    assert cells == {1: (0, 0), 10: (0, 9), 11: (1, 0), 250: (24, 9), 251: (0, 10), 3000: (24, 119)}
    # the layout itself: value c*250 + 10*l + w + 1 sits at row l, column c*10 + w
    for c in range(12):
        for ll in range(25):
            for w in (0, 9):
                ch = c * 250 + 10 * ll + w + 1
                if ch in cells:
                    assert cells[ch] == (ll, c * 10 + w)
    bad = spark.createDataFrame([(3001, 1)], "channel int, sequence_length_template long")
    with pytest.raises(ValueError, match="3001"):
        flowcell_grid(bad)


def test_range_buckets_split_a_hot_time_value(spark):
    """The running sums rely on this: a third of the rows at one time value still spread
    over the buckets, because the range bounds are sampled on (time, id)."""
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(500.0)).otherwise(F.col("id").cast("double")).alias("t"),
        F.format_string("id%07d", "id").alias("read_id"))
    counts = [r["count"] for r in df.repartitionByRange(8, "t", "read_id")
              .groupBy(F.spark_partition_id().alias("bk")).count().collect()]
    assert len(counts) == 8
    assert max(counts) < 2.5 * (n / 8)      # no bucket holds the whole hot value (n/3 rows)
