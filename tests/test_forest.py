"""Trees of many models against trees grown one by one in plain Python."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import forest

SCHEMA = "target_id string, d date, label double, split string, features array<double>, tree int, node int"
DAY = datetime.date(2020, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(t, DAY + datetime.timedelta(i), y, s, f, 7, 7) for t, i, y, s, f in rows], SCHEMA)


def signal(seed, n, target="a", test=20):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        x = [float(v) for v in rng.integers(0, 12, 4)]
        y = 3.0 * (x[0] > 5) - 2.0 * (x[1] > 8) + float(rng.normal(0, 0.1))
        f = [None if rng.random() < 0.1 else v for v in x]
        if rng.random() < 0.05:
            f[2] = float("nan")
        rows.append((target, i, y, "train" if i < n - test else "test", f))
    return rows


def brute(rows, params, bins=forest.BINS):
    """Predictions of one target, by the rules of the module."""
    p = forest.DEFAULTS | params
    train = [r for r in rows if r[3] == "train"]
    low, high = min(r[2] for r in train), max(r[2] for r in train)
    unit = (high - low) / forest.RANGE if high > low else 1.0
    base = low + unit * (sum(np.floor((r[2] - low) / unit + 0.5) for r in train) / len(train))
    there = lambda v: v is not None and not np.isnan(v)
    width = max(len(r[4]) for r in rows)
    lows = []
    for i in range(width):
        values = sorted(r[4][i] for r in train if there(r[4][i]))
        lows.append(sorted({np.floor(bins * values.index(v) / len(values)): v for v in reversed(values)}.values()))
    place = [[max(1, sum(e <= v for e in lows[i])) if there(v) else 0 for i, v in enumerate(r[4])] for r in rows]
    pred = [base] * len(rows)
    for _ in range(p["n_trees"]):
        g = [int(np.floor((r[2] - y) / unit + 0.5)) for r, y in zip(rows, pred)]
        node, open_ = [1] * len(rows), [True] * len(rows)
        for _level in range(p["max_depth"]):
            for k in sorted(set(node)):
                mine = [j for j in range(len(rows)) if node[j] == k and open_[j]]
                learn = [j for j in mine if rows[j][3] == "train"]
                power = lambda js: float(sum(g[j] for j in js)) * float(sum(g[j] for j in js)) / (len(js) + p["reg_lambda"])  # noqa: B023,E731
                best = None
                for i in range(width):
                    for b in range(bins + 1):
                        left = [j for j in learn if place[j][i] <= b]
                        right = [j for j in learn if place[j][i] > b]
                        if b in {place[j][i] for j in learn} and len(left) >= p["min_leaf"] and len(right) >= p["min_leaf"]:
                            gain = power(left) + power(right) - power(learn)
                            if gain >= 1 and (best is None or gain > best[0]):
                                best = gain, i, b
                for j in mine:
                    open_[j] = best is not None
                    if best:
                        node[j] = 2 * k + (place[j][best[1]] > best[2])
        for k in set(node):
            learn = [j for j in range(len(rows)) if node[j] == k and rows[j][3] == "train"]
            value = p["step_size"] * unit * sum(g[j] for j in learn) / (len(learn) + p["reg_lambda"])
            pred = [y + value if node[j] == k else y for j, y in enumerate(pred)]
    return pred


def test_many_targets_equal_trees_of_their_own(spark):
    data = {"a": signal(1, 90), "b": signal(2, 130, "b"), "c": [("c", i, 4.0, "train", [float(i)] * 4) for i in range(60)]}
    params = {"n_trees": 3, "max_depth": 2, "step_size": 0.5, "subsample": 1.0, "min_leaf": 4, "reg_lambda": 0.5}
    samples = frame(spark, [r for rows in data.values() for r in rows]).repartition(5)
    scored, nodes, _ = forest.fit(samples, forest.parameters(spark, forest.one_model_each(samples), params))
    got = {(r["target_id"], (r["d"] - DAY).days): r["y_pred"] for r in scored.collect()}
    for name, rows in data.items():
        for (_, i, *_), y in zip(rows, brute(rows, params)):
            assert got[name, i] == pytest.approx(y, rel=1e-12, abs=1e-12)
    assert {r["model_id"] for r in nodes.filter("feature is not null").collect()} == {"a", "b"}  # labels that never change split nothing
    top = forest.feature_importance(nodes, ["p", "q", "r", "s"]).orderBy(F.desc("importance")).collect()
    assert {r["feature_id"] for r in top[:2]} == {"p"} and abs(sum(r["importance"] for r in top) - 2) < 1e-9


def test_failed_targets_are_rows_with_a_reason(spark):
    rows = signal(3, 100, "good") + signal(4, 30, "small") + signal(5, 100, "bad") + [("bad", 500, None, "train", [1.0] * 4), ("inf", 0, float("inf"), "train", [1.0])] + [(None, 1, 1.0, "train", [1.0])]
    got = forest.train_targets(frame(spark, rows), {"n_trees": 2, "max_depth": 2, "min_leaf": 3}, min_rows=10)
    by = {(r["target_id"], r["split"]): r for r in got.collect()}
    assert set(by) == {("good", "train"), ("good", "test"), ("small", "train") , ("small", "test"), ("bad", None), ("inf", None)}
    assert by["bad", None]["reason"] == "a label is missing or not finite" and by["inf", None]["reason"] == "training rows: 1"
    assert by["good", "test"]["n"] == 20 and by["good", "train"]["reason"] is None
    none = forest.train_targets(frame(spark, rows).limit(0), {"n_trees": 1})
    assert none.count() == 0


def test_early_stopping_keeps_the_best_tree(spark):
    rng = np.random.default_rng(6)
    noise = [("noise", i, float(rng.normal()), "train" if i < 80 else "holdout", [float(v) for v in rng.integers(0, 9, 3)]) for i in range(100)]
    rows = [(t, i, y, "holdout" if 70 <= i < 90 else s, f) for t, i, y, s, f in signal(7, 110, "signal")] + noise
    samples = frame(spark, rows)
    params = forest.parameters(spark, forest.one_model_each(samples), {"n_trees": 8, "max_depth": 2, "step_size": 0.9, "subsample": 1.0, "min_leaf": 2})
    scored, nodes, _ = forest.fit(samples, params, patience=2)
    stopped = {r["target_id"]: r["stopped_at"] for r in scored.select("target_id", "stopped_at").distinct().collect()}
    trees = {r["model_id"]: r["n"] for r in nodes.groupBy("model_id").agg(F.countDistinct("tree").alias("n")).collect()}
    assert stopped["noise"] < stopped["signal"] and trees["noise"] == stopped["noise"] + 2
    short = forest.fit(samples, params.withColumn("n_trees", F.when(F.col("target_id") == "noise", max(stopped["noise"], 0)).otherwise(8)))[0]
    want = {r["d"]: r["y_pred"] for r in short.filter("target_id = 'noise'").collect()}
    got = {r["d"]: r["y_pred"] for r in scored.filter("target_id = 'noise'").collect()}
    assert all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_halving_and_warm_start(spark):
    rows = [(t, i, y, "train" if i < 90 else "holdout", f) for t, i, y, s, f in signal(8, 120, "a") + signal(9, 120, "b")]
    samples = frame(spark, rows)
    trials = forest.draw_trials(samples, 6, {**forest.SPACE, "max_depth": (1, 2, False)})
    assert trials.collect() == forest.draw_trials(samples, 6, {**forest.SPACE, "max_depth": (1, 2, False)}).collect()
    done = forest.halving(samples, trials, (1, 2, 3))
    found = done.collect()
    for target in "ab":
        mine = sorted((r for r in found if r["target_id"] == target), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5, 6] and [r["rung"] for r in mine] == [2, 2, 1, 0, 0, 0]
        assert [r["trees"] for r in mine] == [3, 3, 2, 1, 1, 1]
        last = [r["mda"] for r in mine[:2]]
        assert last == sorted(last, reverse=True)
        # a survivor's score is that of its trees grown at once
    one = next(r for r in found if r["target_id"] == "a" and r["rank"] == 1)
    alone = trials.filter(F.col("target_id") == "a").filter(F.col("number") == one["number"]).withColumn("model_id", F.lit("a")).withColumn("n_trees", F.lit(3))
    scored = forest.fit(samples.filter("target_id = 'a'"), alone.select("model_id", "target_id", *forest.TYPES))[0]
    m = forest.forecast_metrics(scored.filter("split = 'holdout'")).first()
    assert one["mda"] == pytest.approx(m["mda"]) and one["mae"] == pytest.approx(m["mae"], abs=1e-5)
    again = forest.draw_trials(samples, 3, {**forest.SPACE, "max_depth": (1, 2, False)}, known=done)
    first = {r["target_id"]: r for r in again.filter("number = 0").collect()}
    best = {r["target_id"]: r for r in found if r["rank"] == 1}
    assert all(first[t][c] == best[t][c] for t in "ab" for c in ("n_trees", "max_depth", "min_leaf", "step_size"))


def test_jobs_do_not_follow_the_number_of_targets(spark):
    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"forest-{n}"
        spark.sparkContext.setJobGroup(group, group)
        samples = frame(spark, [r for k in range(n) for r in signal(k, 70, f"t{k}")])
        forest.fit(samples, forest.parameters(spark, forest.one_model_each(samples), {"n_trees": 1, "max_depth": 1}))
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(group))

    assert abs(jobs(2) - jobs(12)) <= 2


def test_targets_grown_in_a_task_equal_those_grown_by_levels(spark, monkeypatch):
    data = [*signal(1, 90), *signal(2, 120, "b"), *signal(3, 70, "c"), *signal(4, 30, "few")]
    data += [("a", 500, None, "test", data[0][4]), ("b", 501, float("nan"), "other", data[1][4]), ("b", 502, 1.0, None, data[2][4])]
    data += [(t, i, y, s, f[:2] if i % 7 == 0 else f) for t, i, y, s, f in signal(5, 80, "ragged")]
    data += [(t, i, y, s, None if i == 3 else f) for t, i, y, s, f in signal(6, 80, "absent")]
    data += [("same", i, 2.5, "train", [1.0, None, float("nan"), float(i)]) for i in range(60)]
    data += [("bad", i, None if i == 9 else 1.0 * i, "train", [1.0, 2.0, 3.0, float(i)]) for i in range(60)]
    samples = frame(spark, data)
    models = forest.one_model_each(samples)
    params = forest.parameters(spark, models, {"n_trees": 2, "max_depth": 2}).unionByName(forest.parameters(spark, models.withColumn("model_id", F.concat("model_id", F.lit("2"))), {"n_trees": 1, "max_depth": 3, "subsample": 1.0, "min_leaf": 3}))

    def found():
        scored, nodes, scale = forest.fit(samples, params)
        return [sorted(map(str, x.collect())) for x in (scored, nodes, scale.select("target_id", "n", "reason"))]

    mixed = found()
    monkeypatch.setattr(forest, "ALONE", 0)
    assert found() == mixed


def test_small_targets_are_trained_without_rows_written_per_tree(spark, monkeypatch):
    """Jobs and written tables do not follow the number of trees."""
    names, kept = [], forest._kept
    monkeypatch.setattr(forest, "_kept", lambda df, name: names.append(name) or kept(df, name))
    samples = frame(spark, signal(1, 90))
    forest.fit(samples, forest.parameters(spark, forest.one_model_each(samples), {"n_trees": 6}))[0].count()
    assert len(names) <= 3
