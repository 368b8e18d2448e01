"""Hand-made frames for the cases that are easy to get wrong."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seriesloom.functions.guarded import change_ratio, clean_number, fixed, safe_ratio
from seriesloom.operators import align, clean, metrics, model, resample, rolling, select, split, stationarity, technical
from seriesloom.sources import panel_csv, records


def day(text):
    return dt.date.fromisoformat(text)


def panel(spark, data):
    """{series: {day text: value}} or {series: [values from 2020-01-01]}."""
    out = []
    for s, values in data.items():
        pairs = values.items() if isinstance(values, dict) else ((str(day("2020-01-01") + dt.timedelta(i)), v) for i, v in enumerate(values))
        out += [(s, day(d), None if v is None else float(v)) for d, v in pairs]
    return spark.createDataFrame(out, "series_id string, d date, value double")


def series(df, col, key="series_id"):
    out = {}
    for r in df.orderBy(key, "d").collect():
        out.setdefault(r[key], []).append(r[col])
    return out


def test_asof_carries_history_in_and_exact_match_loses_it(spark):
    p = panel(spark, {"a": {"2019-12-20": 1, "2020-01-03": 3, "2020-02-01": 9}, "b": {"2020-01-02": 2}})
    assert series(align.align_asof(p, "2020-01-01", "2020-01-04"), "value") == {"a": [1, 1, 3, 3], "b": [None, 2, 2, 2]}
    assert series(align.align_exact(p, "2020-01-01", "2020-01-04"), "value") == {"a": [None, None, 3, 3], "b": [None, 2, 2, 2]}


def test_asof_never_looks_ahead(spark):
    rng = np.random.default_rng(1)
    data = {s: {str(day("2020-01-01") + dt.timedelta(int(i))): float(i) for i in rng.choice(60, 20, replace=False)} for s in "abc"}
    for r in align.align_asof(panel(spark, data), "2020-01-01", "2020-02-29").collect():
        past = [v for d, v in data[r.series_id].items() if day(d) <= r.d]
        assert r.value == (max(past) if past else None)


def test_duplicate_day_keeps_last(spark):
    df = spark.createDataFrame([("a", day("2020-01-01"), 1.0, 1), ("a", day("2020-01-01"), 2.0, 2)], "series_id string, d date, value double, k int")
    assert rows(align.last_per_day(df, "k"), "value") == [(2.0,)]


def test_cleaning_needs_more_than_100_values(spark):
    p = panel(spark, {"a": list(range(100)) + [10_000], "b": list(range(99)) + [10_000]})
    bounds = {r.series_id: r.upper for r in clean.cleaning_bounds(p).collect()}
    assert bounds["b"] is None and bounds["a"] == pytest.approx(np.quantile(list(range(100)) + [10_000], 0.75) + 3 * 50)


def test_winsorizing_keeps_nulls_and_a_second_clip_changes_nothing(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(size=60)] + [50.0, None]
    p = panel(spark, {"a": values})
    limit = clean.limits(p, "std").first()
    once = clean.winsorize(p, "std")
    got = series(once, "value")["a"]
    assert got[-1] is None and max(v for v in got if v is not None) == pytest.approx(limit.high)
    assert all(limit.low <= v <= limit.high for v in got[:-1])


def test_repair_starts_with_median(spark):
    p = panel(spark, {"a": [0.5, 10, 11, 100, 12]})
    # 0.5 is near zero; 10 is a jump from it; 100 and 12 are jumps
    assert series(clean.repair_jumps(p), "value")["a"] == [11, 11, 11, 11, 11]


def test_change_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 5e-5), (1.0, -2.0), (1.0, 1e-4)], "v double, p double")
    v, p = F.col("v"), F.col("p")
    got = df.select(change_ratio(v, p, "signed").alias("s"), change_ratio(v, p, "abs").alias("a"), change_ratio(v, p, "abs", 1e-4, True).alias("w")).collect()
    assert got[0] == (None, None, None)
    assert got[1].w is None and got[1].a == pytest.approx(19999)
    assert (got[2].s, got[2].a) == (-1.5, 1.5)
    assert got[3].w == pytest.approx(9999)


def test_number_cells(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("nan",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_number(F.col("t"))).collect()] == [1.5, None, None, None, None]
    assert [r[0] for r in df.select(fixed(clean_number(F.col("t")), 2)).collect()] == ["1.50", None, None, None, None]
    assert [r[0] for r in df.select(safe_ratio(F.lit(1.0), F.lit(0.0))).collect()] == [None] * 5


def test_min_periods_count_values(spark):
    p = panel(spark, {"a": [1, None, None, None, 5, 6, 7]})
    got = series(p.withColumn("m", rolling.rolling_mean("value", 5)), "m")["a"]
    assert got == [None, None, None, None, 3, 5.5, 6]


def test_iso_weeks(spark):
    p = panel(spark, {"a": {d: i for i, d in enumerate(["2020-12-28", "2021-01-01", "2021-01-03", "2021-01-04", "2021-01-07", "2021-01-16"])}})
    assert [r.d for r in resample.weekly_sample(p).orderBy("d").collect()] == [day("2021-01-01"), day("2021-01-07"), day("2021-01-16")]
    assert rows(resample.weekly_days(p), "d") == rows(resample.weekly_sample(p), "d")


def test_interpolation_of_gaps(spark):
    p = panel(spark, {"a": [None, 1, None, None, 4, None], "b": [None, None, None, None, None, None]})
    assert series(resample.interpolate(p), "value") == {"a": [0, 1, 2, 3, 4, 4], "b": [0] * 6}


def test_point_budget_keeps_whole_dates(spark):
    p = panel(spark, {"a": range(10), "b": range(10)})
    kept = resample.point_budget(p, 7)
    assert kept.count() == 6 and kept.agg(F.min("d")).first()[0] == day("2020-01-08")


def test_split_embargo(spark):
    p = panel(spark, {"a": {str(day("2024-12-01") + dt.timedelta(7 * i)): i for i in range(40)}})
    out = split.train_test(p, "2024-12-31")
    report = split.split_report(out).first()
    assert report.gap_days >= 98 and report.train_rows == 5
    three = {r.split: r.n for r in split.train_val_test(p, "2024-12-31").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert three["train"] == 4 and three["val"] == 1
    # the label of the last training row lies behind the cutoff, so that row goes
    strict = split.labelled_split(p.withColumn("x", F.col("value")), "x", "2024-12-31")
    assert strict.filter("split = 'train'").count() == 4
    assert split.labelled_split(p.withColumn("x", F.col("value")), "x", "2024-12-31", strict=False).filter("split = 'train'").count() == 5


def predictions(spark, true, pred):
    data = [("t", day("2020-01-01") + dt.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(zip(true, pred))]
    return spark.createDataFrame(data, "target_id string, d date, y_true double, y_pred double")


def test_direction_metrics(spark):
    flat = metrics.forecast_metrics(predictions(spark, [1, 1, 1], [1, 2, 3])).first()
    assert flat.mda == 0.5
    got = metrics.forecast_metrics(predictions(spark, [1, 2, 2, 0], [1, 3, 9, 9])).first()
    assert got.mda == 0.5 and got.zero_actuals == 1 and got.mape == pytest.approx((0 + 0.5 + 3.5) / 3)
    hits = metrics.direction_hits(predictions(spark, [1, 2, 2, 0], [1, 3, 9, 9])).orderBy("d").collect()
    assert [h.hit for h in hits] == [1, 0, 1]


def test_index_percentiles(spark):
    got = metrics.error_percentiles(predictions(spark, [0] * 4, [4, 1, 3, 2])).first()
    assert (got.p50, got.p75, got.p95) == (3, 4, 4)


def slow_rsi(values, p):
    """Recursion spelled out for comparison."""
    moves = [b - a if a is not None and b is not None else 0 for a, b in zip(values, values[1:])]
    out, up, down = [None] * len(values), None, None
    for end in range(p, len(values)):
        if up is None:
            up, down = (sum(max(sign * m, 0) for m in moves[:p]) / p for sign in (1, -1))
        else:
            up, down = ((old * (p - 1) + max(sign * moves[end - 1], 0)) / p for old, sign in ((up, 1), (down, -1)))
        out[end] = 100.0 if down < 1e-10 else 100 - 100 / (1 + up / down)
    return out


def test_recursive_indicators(spark):
    noise = [float(x) for x in np.random.default_rng(3).normal(100, 5, 80)]
    holed = noise[:30] + [None] + noise[31:]
    p = panel(spark, {"noise": noise, "holed": holed, "up": range(40), "short": [1, 2, 3]})
    got = technical.recursive_indicators(p)
    for name, values in (("noise", noise), ("holed", holed), ("up", list(range(40))), ("short", [1, 2, 3])):
        for n in (7, 14):
            assert series(got, f"rsi{n}")[name] == [None if x is None else pytest.approx(x) for x in slow_rsi(values, n)]
    fast, slow = noise[0], noise[0]
    for x in noise[1:]:
        fast, slow = fast + (x - fast) * 2 / 13, slow + (x - slow) * 2 / 27
    assert series(got, "macd")["noise"][-1] == pytest.approx(fast - slow)


def long_features(spark, columns, group="g"):
    data = [(group, day("2020-01-01") + dt.timedelta(i), f, None if v is None else float(v)) for f, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "series_id string, d date, feature_id string, value double")


def test_low_information(spark):
    n = 100
    cols = {"empty": [None] * n, "flat": [3] * n, "sparse": [None] * 51 + list(range(49)), "half": [None] * 50 + list(range(50)), "full": range(n)}
    kept = select.drop_low_information(long_features(spark, cols), ["series_id"])
    assert rows(kept.select("feature_id").distinct()) == [("full",), ("half",)]


def brute_redundant(cols, limit):
    order = sorted(cols, key=lambda f: (-np.var(cols[f]), f))
    kept = []
    for f in order:
        if np.var(cols[f]) >= 1e-8 and all(abs(np.corrcoef(cols[f], cols[k])[0, 1]) <= limit for k in kept):
            kept.append(f)
    return sorted(kept)


@pytest.mark.parametrize("task_cells, round_size", [(1_000_000, 256), (0, 4)])
def test_greedy_redundancy(spark, task_cells, round_size):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 50)).cumsum(axis=1)
    cols = {f"f{i:02d}": (base[i % 3] * (-1) ** i * (1 + i / 50) + rng.normal(scale=0.05 * i, size=50)).round(6) for i in range(15)}
    cols |= {"copy": cols["f05"], "flat": np.ones(50)}
    got = select.remove_redundant(long_features(spark, cols), "series_id", 0.95, task_cells=task_cells, round_size=round_size)
    assert [f for (_, f) in rows(got, "series_id", "feature_id")] == brute_redundant(cols, 0.95)


def dense_adf(y, lags):
    dy = np.diff(y)
    x = np.column_stack([np.ones(len(dy)), np.arange(len(dy)), y[:-1]] + [np.concatenate([np.zeros(k), dy[:-k]]) for k in range(1, lags + 1)])
    beta, *_ = np.linalg.lstsq(x, dy, rcond=None)
    residual = dy - x @ beta
    se = math.sqrt(residual @ residual / (len(dy) - x.shape[1]) * np.linalg.inv(x.T @ x)[2, 2])
    return beta[2] / se, beta[2]


def test_unit_root_statistic(spark):
    rng = np.random.default_rng(5)
    data = {"noise": rng.normal(size=200), "walk": rng.normal(size=200).cumsum() + 50, "short": rng.normal(size=40), "flat": np.ones(80)}
    got = {r.series_id: r for r in stationarity.adf_test(panel(spark, data).withColumn("version", F.lit("raw"))).collect()}
    for name in ("noise", "walk"):
        t, gamma = dense_adf(data[name], 5)
        assert got[name].t_stat == pytest.approx(t, rel=1e-6) and got[name].gamma == pytest.approx(gamma, rel=1e-6)
    assert got["noise"].verdict == "stationary 99%"
    assert got["short"].t_stat is None and got["short"].verdict is None and got["flat"].t_stat is None


def test_unit_root_where_regressors_depend_on_each_other(spark):
    rng = np.random.default_rng(6)
    walk = np.concatenate([[0], rng.normal(size=299).cumsum()])
    data = {"line": np.arange(100.0), "walk": walk, "far": walk * 1e-3 + 1e6, "gaps": [None if i % 3 == 0 else v for i, v in enumerate(walk)]}
    got = {r.version: r for r in stationarity.adf_test(panel(spark, data).withColumnRenamed("series_id", "version").withColumn("series_id", F.lit(7))).collect()}
    assert got["line"].t_stat is None and got["line"].gamma is None and got["line"].verdict is None
    assert got["walk"].verdict == "not stationary" and got["walk"].series_id == 7
    assert got["far"].t_stat == pytest.approx(got["walk"].t_stat, rel=1e-4)
    seen = np.array([v for i, v in enumerate(walk) if i % 3])
    assert got["gaps"].n == len(seen) and got["gaps"].t_stat == pytest.approx(dense_adf(seen, 5)[0], rel=1e-6)
    assert stationarity.adf_test(panel(spark, {}).withColumn("version", F.lit("raw"))).count() == 0


def test_autocorrelation_of_constant_is_null(spark):
    got = stationarity.autocorrelation(panel(spark, {"flat": [1.0] * 120, "line": range(120)})).orderBy("series_id").collect()
    assert got[0].acf_1 is None and got[1].acf_1 == pytest.approx(1.0)


def test_panel_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿data_date,A,B\ndata_date,Name A,Name B\n2020-01-01,1.5,\n2020/01/02 00:00:00,x,nan\n,3,4\nbad,1,2\n", encoding="utf-8")
    catalog, p = panel_csv.read_panel_csv(spark, str(path), "daily")
    assert rows(catalog) == [("A", "Name A", "daily", 1), ("B", "Name B", "daily", 2)]
    assert rows(p) == [("A", day("2020-01-01"), 1.5), ("A", day("2020-01-02"), None), ("B", day("2020-01-01"), None), ("B", day("2020-01-02"), None)]
    later = tmp_path / "q.csv"
    later.write_text("data_date,B,C\ndata_date,Other B,Name C\n2020-01-01,7,8\n")
    catalog, p = panel_csv.read_panel_files(spark, [("daily", str(path)), ("none", str(tmp_path / "missing.csv")), ("weekly", str(later))])
    assert rows(catalog, "series_id", "series_name") == [("A", "Name A"), ("B", "Name B"), ("C", "Name C")]
    assert p.filter("series_id = 'B' AND value = 7").count() == 0
    out = str(tmp_path / "out")
    panel_csv.write_panel_csv(p, {"A": "Name A", "B": "Name B", "C": "Name C"}, out)
    text = "".join((tmp_path / "out" / f).read_text() for f in os.listdir(out) if f.endswith(".csv"))
    assert "1.500000" in text and "nu" not in text
    _, back = panel_csv.read_panel_csv(spark, out)
    assert rows(back) == rows(p.select("series_id", "d", "value").unionByName(spark.createDataFrame([("C", day("2020-01-02"), None)], "series_id string, d date, value double")))


def test_upsert_and_missing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, ts int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("b", 4, "q"), ("c", 0, "n")], "k string, ts int, v string")
    assert rows(records.upsert_latest(old, new, "k", "ts")) == [("a", 2, "z"), ("b", 5, "w"), ("c", 0, "n")]
    assert rows(records.append_missing(old, new, ["k"])) == [("a", 1, "x"), ("b", 5, "y"), ("c", 0, "n")]


def test_trees_beat_last_value(spark):
    rng = np.random.default_rng(6)
    data, feats = [], []
    level = 0.0
    for i in range(240):
        d, x = day("2020-01-01") + dt.timedelta(i), float(rng.normal())
        feats += [("t", d, "x", x), ("t", d, "level", level)]
        level = 3 * (x > 0) + 0.1 * float(rng.normal())
        data.append(("t", d, level, "train" if i < 180 else "test"))
    labels = spark.createDataFrame(data, "target_id string, d date, label double, split string")
    features = spark.createDataFrame(feats, "target_id string, d date, feature_id string, value double").filter("NOT (feature_id = 'level' AND value = 0)")
    names = model.feature_index(features)
    samples = model.assemble(features, labels, names)
    assert samples.count() == 240
    fitted, scored, got = model.refit_and_score(samples, {"max_depth": 3, "max_iter": 5})
    test = got.filter("split = 'test'").first()
    naive = np.mean(np.abs(np.diff([x[2] for x in data[179:]])))
    assert test.mae < naive / 2 and test.mda > 0.6
    top = select.cap_by_importance(model.feature_importance(spark, fitted, names, "t"), 1).first()
    assert top.feature_id == "x"
    trials = model.draw_trials(model.search_space({"max_depth": 3, "max_iter": 6}), 2)
    assert trials == model.draw_trials(model.search_space({"max_depth": 3, "max_iter": 6}), 2)
    assert all(lo <= t[k] <= hi for t in trials for k, (lo, hi, _) in model.search_space({"max_depth": 3, "max_iter": 6}).items())
    best = model.best_parameters(model.search_parameters(samples.filter("split = 'train'"), trials))
    assert best in trials
    skipped = model.train_targets(samples.unionByName(samples.limit(10).withColumn("target_id", F.lit("small"))), ["t", "small"], {"max_depth": 2, "max_iter": 2})
    assert rows(skipped.select("target_id").distinct()) == [("t",)]


def test_name_line_by_position_and_loose_dates(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("date,A,B\nname,Iron,Coal\n2024-1-5 08:30:00,1,2\n2024/01/06T00:00:00Z,3,x\nnot a date,5,6\n20240107,7,8\n")
    names, panel = panel_csv.read_panel_csv(spark, str(path))
    assert rows(names, "series_id", "series_name") == [("A", "Iron"), ("B", "Coal")]
    assert rows(panel.select(F.col("d").cast("string").alias("d"), "series_id", "value"), "d", "series_id", "value") == [
        ("2024-01-05", "A", 1.0), ("2024-01-05", "B", 2.0), ("2024-01-06", "A", 3.0), ("2024-01-06", "B", None), ("2024-01-07", "A", 7.0), ("2024-01-07", "B", 8.0),
    ]


def tasks_of(df):
    """Tasks that hold rows, and the most rows of one."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(sizes), max(sizes)


def test_days_grow_in_many_tasks(spark):
    """A small catalog of series grows to rows per day: neither days nor buckets are packed into a few tasks."""
    few = spark.range(400).select(F.concat(F.lit("S"), "id").alias("series_id"), F.lit("2020-01-05").cast("date").alias("d"), F.col("id").cast("double").alias("value"))
    ends = few.limit(1).withColumn("d", F.lit("2020-12-27").cast("date"))
    for grown in (align.align_asof(few, "2020-01-01", "2020-12-31"), resample.resample_mean(few.unionByName(ends), "week"), resample.resample_mean(few.unionByName(ends), "day")):
        n, most = tasks_of(grown)
        assert n > 16 and most < grown.count() / 8


def test_repeated_series_and_days_without_a_place(spark):
    """A series listed twice has its days twice; rows without a day keep their series in the panel."""
    data = [("a", "2020-01-02", 1.0), ("a", "2020-01-09", 9.0), ("a", None, 5.0), ("b", None, 2.0)]
    p = spark.createDataFrame(data, "series_id string, d string, value double").withColumn("d", F.to_date("d"))
    listed = spark.createDataFrame([("a",), ("a",), ("q",)], "series_id string")
    assert series(align.align_asof(p, "2020-01-01", "2020-01-03"), "value") == {"a": [None, 1, 1], "b": [None] * 3}
    assert series(align.align_asof(p, "2020-01-01", "2020-01-03", listed), "value") == {"a": [None, None, 1, 1, 1, 1], "q": [None] * 3}
    weeks = [(r["series_id"], str(r["d"]), r["value"]) for r in resample.resample_mean(p, "week").collect()]
    assert sorted(weeks, key=str) == [("a", "2020-01-05", 1.0), ("a", "2020-01-12", 9.0), ("a", "None", 5.0), ("b", "2020-01-05", None), ("b", "2020-01-12", None), ("b", "None", 2.0)]
