"""Property tests: the distributed operators equal brute force on random data."""
from __future__ import annotations

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seqyield.operators.prefix import running_totals
from seqyield.operators.quantiles import quantile_values

rows_strategy = st.lists(
    st.tuples(st.integers(0, 5),            # time: few values → heavy ties
              st.sampled_from(["a", "b", "c"]),  # group: a hot group is likely
              st.integers(0, 1000)),         # measure
    min_size=1, max_size=120)

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=rows_strategy, buckets=st.integers(1, 7))
def test_running_sums_equal_brute_force(spark, rows, buckets):
    data = [(t, g, m, f"id{i:04d}") for i, (t, g, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "t int, g string, m long, id string")
    out = running_totals(df, ["t", "id"], {"s": "m", "c": 1}, by=["g"], n_buckets=buckets)
    got = {r["id"]: (r["s"], r["c"]) for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["t", "g", "m", "id"]).sort_values(["t", "id"])
    pdf["s"] = pdf.groupby("g")["m"].cumsum()
    pdf["c"] = pdf.groupby("g").cumcount() + 1
    assert got == {r.id: (r.s, r.c) for r in pdf.itertuples()}


@SETTINGS
@given(values=st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                       min_size=1, max_size=150),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True))
def test_quantiles_equal_pandas(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantile_values(df, "v", probs)
    s = pd.Series(values, dtype="float64").sort_values().reset_index(drop=True)
    for p, g in zip(probs, got):
        h = (len(s) - 1) * p
        lo, hi = int(h // 1), int(-(-h // 1))
        exp = s[lo] + (s[hi] - s[lo]) * (h - lo)
        assert g == exp or abs(g - exp) <= 1e-9 * max(1.0, abs(exp))


@SETTINGS
@given(lengths=st.lists(st.one_of(st.integers(0, 60), st.just(7)), min_size=2, max_size=150))
def test_nx_compat_picks_sit_at_their_targets(spark, lengths):
    """Every value is that of a read whose cumulative bases do not pass the target while the next
    read's reach it, at ever later places; where the list ends, no later read would do."""
    from itertools import accumulate

    from seqyield.operators import stats
    df = spark.createDataFrame([(x,) for x in lengths], "sequence_length_template long")
    got = {r["label"]: r["value"] for r in stats.nx_values(df, mode="compat").collect()}
    ordered, total = sorted(lengths), float(sum(lengths))
    sums = list(accumulate(ordered))
    place, ended = -1, False
    for p in (0.1, 0.25, 0.5, 0.75, 0.9):
        fits = [i for i in range(place + 1, len(ordered) - 1) if sums[i] <= total * p <= sums[i + 1]]
        label = f"N{round(p * 100):02d}"
        ended = ended or not fits
        assert (label in got) == (not ended)
        if not ended:
            place = min(fits)
            assert got[label] == ordered[place]
