from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqyield.operators import trim
from seqyield.operators.quantiles import exact_quantiles, quantile_values
from seqyield.operators.reads import (check_single_sample, dedup_reads, elapsed_time, enrich_reads,
                                      merge_reads, unmatched_reads)

SCHEMA = ("read_id string, run_id string, channel int, sequence_length_template long, "
          "mean_qscore_template double, template_duration double, num_events long")


def test_enrich_edge_cases(spark):
    rows = [("a", "r", 1, 100, 9.0, 2.0, 300), ("b", "r", 1, 100, 9.0001, 0.0, 300),
            ("c", "r", 1, 0, float("nan"), 1.0, 300), ("d", "r", 1, 50, None, None, 100)]
    out = {r["read_id"]: r for r in enrich_reads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["a"]["qualitative_pass"] == "Failed" and out["a"]["pass"] is False
    assert out["b"]["qualitative_pass"] == "Passed"
    assert out["c"]["qualitative_pass"] == "Failed"          # NaN quality counts as a fail
    assert out["d"]["qualitative_pass"] == "Failed"          # missing quality too
    assert out["b"]["pore_speed"] is None                    # zero duration → missing
    assert out["a"]["pore_speed"] == 50.0
    assert out["c"]["events_ratio"] is None                  # zero length → missing
    assert out["d"]["events_ratio"] == 2.0


def test_merge_and_audit(spark):
    s = spark.createDataFrame([("a", "r", 1), ("b", "r", 1), ("c", "r", 2)], "read_id string, run_id string, channel int")
    f = spark.createDataFrame([("a", "r", 1, "S"), ("a", "r", 1, "S"), ("c", "r", 3, "S")],
                              "read_id string, run_id string, channel int, sample_id string")
    m = merge_reads(s, f)
    assert sorted(r["read_id"] for r in m.collect()) == ["a", "a"]      # duplicates multiply
    u = {(r["side"], r["read_id"]) for r in unmatched_reads(s, f).collect()}
    assert u == {("summary_only", "b"), ("summary_only", "c"), ("fastq_only", "c")}
    # repeated rows stay repeated, and a missing key matches nothing
    s2 = s.unionByName(spark.createDataFrame([("b", "r", 1), (None, "r", 9)], s.schema))
    f2 = f.unionByName(spark.createDataFrame([(None, "r", 9, "S")], f.schema))
    got = sorted((r["side"], str(r["read_id"])) for r in unmatched_reads(s2, f2).collect())
    assert got == [("fastq_only", "None"), ("fastq_only", "c"), ("summary_only", "None"), ("summary_only", "b"),
                   ("summary_only", "b"), ("summary_only", "c")]


def test_dedup_prefers_first(spark):
    df = spark.createDataFrame([("a", "r", 1, 5.0), ("b", "r", 1, 1.0), ("c", "r", 2, 3.0)],
                               "read_id string, run_id string, channel int, t double")
    out = {(r["channel"], r["read_id"]) for r in dedup_reads(df, ("run_id", "channel"), prefer=("t",)).collect()}
    assert out == {(1, "b"), (2, "c")}


def test_elapsed_time_and_single_sample(spark):
    df = spark.createDataFrame([("a", "S1", "2024-01-01 00:00:10"), ("b", "S1", "2024-01-01 00:01:00")],
                               "read_id string, sample_id string, t string") \
        .withColumn("start_time_utc", F.to_timestamp("t"))
    out = {r["read_id"]: r["start_time_float_by_sample"] for r in elapsed_time(df).collect()}
    assert out == {"a": 0.0, "b": 50.0}
    assert check_single_sample(df) == "S1"
    two = df.withColumn("sample_id", F.when(F.col("read_id") == "a", "S2").otherwise("S1"))
    with pytest.raises(ValueError, match="exactly one"):
        check_single_sample(two)


def _pandas_q(values, p):
    return pd.Series(values, dtype="float64").quantile(p)


def test_exact_quantiles_match_pandas(spark):
    rng = random.Random(7)
    # a hot value holds a third of the rows; the rest is continuous
    vals = [12.5] * 700 + [rng.uniform(0, 100) for _ in range(1400)] + [None] * 5 + [float("nan")] * 3
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.001, 0.1, 0.3334, 0.5, 0.999]
    got = quantile_values(df, "v", probs)
    clean = [v for v in vals if v is not None and not math.isnan(v)]
    for p, g in zip(probs, got):
        assert g == pytest.approx(_pandas_q(clean, p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_grouped(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", float(rng.randint(0, 500))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, "v", [0.25, 0.75], by=["g"]).collect()}
    for g in ("a", "b"):
        vs = [v for k, v in rows if k == g]
        for p in (0.25, 0.75):
            assert got[(g, p)] == pytest.approx(_pandas_q(vs, p), rel=1e-12)


def _trim_frame(spark, n=3000, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = rng.randint(0, 50000)
        ratio = None if length == 0 else rng.uniform(0, 25)
        rows.append((f"r{i:05d}", length, ratio, rng.uniform(0, 100000)))
    return spark.createDataFrame(rows, "read_id string, sequence_length_template long, events_ratio double, "
                                       "start_time_float_by_sample double"), rows


def test_trim_matches_pandas_query(spark):
    df, rows = _trim_frame(spark)
    pdf = pd.DataFrame(rows, columns=["read_id", "sequence_length_template", "events_ratio",
                                      "start_time_float_by_sample"])
    lq = "sequence_length_template < %d" % pdf["sequence_length_template"].quantile(0.999)
    tq = ("start_time_float_by_sample > %d" % pdf["start_time_float_by_sample"].quantile(0.001)
          + " & start_time_float_by_sample < %d" % pdf["start_time_float_by_sample"].quantile(0.999))
    expected = set(pdf.query(" & ".join([lq, "events_ratio < 20", tq]))["read_id"])
    got = {r["read_id"] for r in trim.trim_reads(df).collect()}
    assert got == expected


def test_trim_bound_is_strict(spark):
    # 1000 rows of lengths 1..1000: q99.9 = 999.001 → bound 999, the row with 999 is removed
    df = spark.createDataFrame([(f"r{i}", i, 1.0, 50.0) for i in range(1, 1001)],
                               "read_id string, sequence_length_template long, events_ratio double, "
                               "start_time_float_by_sample double")
    kept = trim.quantile_trim(df, "sequence_length_template", 0.999)
    assert kept.agg(F.max("sequence_length_template")).collect()[0][0] == 998


def test_trim_exclusions_modes(spark):
    df, _ = _trim_frame(spark, n=2000, seed=5)
    b = trim.trim_bounds(df)
    correct = trim.trim_exclusions(df, bounds=b).collect()
    assert sum(r["reads"] for r in correct) == 2000
    kept = [r["reads"] for r in correct if not (r["time_excluded"] or r["ratio_excluded"] or r["length_excluded"])]
    assert kept == [trim.trim_reads(df, bounds=b).count()]
    compat = {r["region"]: r["reads"] for r in trim.trim_exclusions(df, mode="compat", bounds=b).collect()}
    assert compat["010"] == compat["110"] == compat["001"] == compat["011"] == 0
    assert compat["101"] == compat["111"] == kept[0]
    inside = (F.col("start_time_float_by_sample") > b.time_min) & (F.col("start_time_float_by_sample") < b.time_max)
    assert compat["100"] == df.where(inside & (F.col("events_ratio") < 20) & (F.col("sequence_length_template") > b.length_max)).count()


def test_dedup_hot_key(spark):
    rows = [("hot", 1, f"r{i:05d}", float(1000 - i % 997)) for i in range(3000)] + [("cold", 2, "z", 5.0)]
    df = spark.createDataFrame(rows, "run_id string, channel int, read_id string, t double")
    out = {r["run_id"]: (r["read_id"], r["t"]) for r in dedup_reads(df, ("run_id", "channel"),
                                                                    prefer=("t", "read_id")).collect()}
    assert out["cold"] == ("z", 5.0)
    best = min(rows[:3000], key=lambda r: (r[3], r[2]))
    assert out["hot"] == (best[2], best[3])


def test_observed_trim_counts(spark):
    df, _ = _trim_frame(spark, n=1500, seed=9)
    out, before, after = trim.observed_trim(df)
    n = out.count()
    assert before.get["reads"] == 1500 and after.get["reads"] == n


def test_pair_view_names(spark):
    from seqyield.operators.dist import pair_view
    df = spark.createDataFrame([(9.5, 400.0, 1000, 2.0, "Passed")],
                               "mean_qscore_template double, pore_speed double, sequence_length_template long, "
                               "events_ratio double, qualitative_pass string")
    assert pair_view(df).columns == ["Mean QScore Template", "Pore Speed (b/s)", "Read Length", "Events / base",
                                     "qualitative_pass"]
