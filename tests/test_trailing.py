"""Trailing statistics against brute force."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.operators import trailing


def brute(values, width, need, what):
    out = []
    for i in range(len(values)):
        seen = [v for v in values[max(0, i - width + 1) : i + 1] if v is not None]
        if len(seen) < max(need, 2 if what == "std" else 1):
            out.append(None)
        elif what == "mean":
            out.append(float(np.mean(seen)))
        elif what == "std":
            out.append(float(np.std(seen, ddof=1)))
        else:
            out.append(float(np.quantile(seen, what)))
    return out


def column(wanted, series):
    """The statistics of several series laid one after the other."""
    flat = [v for s in series for v in s]
    first = np.array([i == 0 for s in series for i in range(len(s))], bool)
    import pyarrow as pa

    table = pa.table({"value": pa.array(flat, pa.float64())})
    return [[float(v) if ok else None for v, ok in zip(x, there)] for x, there in trailing._columns(wanted, table, first)]


numbers = st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1e9, 1e-9]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(numbers, min_size=1, max_size=40), min_size=1, max_size=4), st.integers(1, 15), st.integers(1, 6))
def test_every_window(series, width, need):
    wanted = {"m": trailing.mean(width, need), "s": trailing.std(width, need), "q": trailing.quantiles(width, (0.1, 0.5), need)}
    got = column(wanted, series)
    for found, what in zip(got, ("mean", "std", 0.1, 0.5)):
        want = [x for s in series for x in brute(s, width, need, what)]
        for a, b in zip(found, want):
            assert (a is None) == (b is None)
            if a is not None:
                assert a == pytest.approx(b, rel=1e-9, abs=1e-9 * max(1.0, *(abs(v) for s in series for v in s if v is not None)))


def test_no_digits_are_lost():
    """Equal values deviate by exactly 0 behind huge ones; small values keep their own digits."""
    series = [[1e15, -3e14, 7.0] + [5.0] * 30 + [1e-3 * i for i in range(40)]]
    s, m = column({"s": trailing.std(7), "m": trailing.mean(7)}, series)
    assert s[20] == 0.0 and m[20] == 5.0
    want = brute(series[0], 7, 3, "std")
    assert s[-1] == pytest.approx(want[-1], rel=1e-12)


def test_nan_stays_in_its_windows():
    m, s, q = column({"m": trailing.mean(3, 1), "s": trailing.std(3, 1), "q": trailing.quantiles(3, (0.5,), 1)}, [[1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]])
    assert np.isnan(m[1:4]).all() and m[0] == 1.0 and m[4:] == [3.0, 4.0]
    assert np.isnan(s[1:4]).all() and s[0] is None and s[4:] == [1.0, 1.0] and q == [1.0, 1.0, 1.5, 2.5, 3.0, 4.0]


def panel(spark, series, extra=False):
    day = datetime.date(2020, 1, 1)
    rows = [(n, day + datetime.timedelta(i), v) for n, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "series_id string, d date, value double").repartition(3)


def test_batches_and_other_columns(spark):
    """Series that end inside a batch, span several, or lack an id; columns ride along."""
    rng = np.random.default_rng(1)
    series = {n: [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 50, size)] for n, size in (("a", 1), ("b", 37), ("c", 120), (None, 9))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = panel(spark, series).selectExpr("*", "'x' AS tag", "named_struct('k', 1) AS _row")
        out = trailing.trailing_features(df, {"m": trailing.mean(10), "s": trailing.std(4, 1), "q": trailing.quantiles(5, (0.25, 0.75))})
        assert out.columns == ["series_id", "d", "value", "tag", "_row", "m", "s", "q_0", "q_1"]
        rows = out.orderBy("series_id", "d").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, values in series.items():
        mine = [r for r in rows if r["series_id"] == name]
        assert [r["value"] for r in mine] == values and all(r["tag"] == "x" and r["_row"]["k"] == 1 for r in mine)
        for c, w in (("m", (10, 5, "mean")), ("s", (4, 1, "std")), ("q_0", (5, 2, 0.25)), ("q_1", (5, 2, 0.75))):
            want = brute(values, *w)
            assert all((r[c] is None) == (x is None) and (x is None or abs(r[c] - x) < 1e-9) for r, x in zip(mine, want))


def test_edges(spark):
    df = panel(spark, {"a": [1.0, None]})
    assert trailing.trailing_features(df.limit(0), {"m": trailing.mean(3)}).count() == 0
    with pytest.raises(ValueError):
        trailing.trailing_features(df, {"value": trailing.mean(3)})
    whole = df.selectExpr("series_id", "d", "CAST(value AS INT) AS value")
    assert [r["m"] for r in trailing.trailing_features(whole, {"m": trailing.mean(1)}).orderBy("d").collect()] == [1.0, None]


def test_an_aligned_panel_is_not_shuffled_again(spark):
    from seriesloom.operators.align import align_asof

    daily = align_asof(panel(spark, {"a": [1.0, None, 3.0]}), "2020-01-01", "2020-01-05")
    plan = trailing.trailing_features(daily, {"m": trailing.mean(3)})._jdf.queryExecution().executedPlan().toString()
    before = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == before.count("Exchange hashpartitioning")
