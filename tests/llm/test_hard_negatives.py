"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key long, means int, part string, lows string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, 2, "p", "l") for i, v, k in rows], SCHEMA)


def clustered(seed, n=420, size=17, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, size))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i, (centres[label] * 0.5 + rng.standard_normal(size)).round(2).astype(np.float32).tolist(), label))
    return rows + [(i + n, rows[60][1], rows[60][2]) for i in range(20)] + [(i + 2 * n, rows[61][1], (rows[61][2] + 1) % labels) for i in range(20)]  # ties


def odd(size):
    return [(None, [0.5] * size, 1), (2050, None, 1), (2051, [float("nan")] * size, 1), (2052, [float("-inf")] * size, 1), (2100, [None] * size, 1), (2150, [0.25] * size, None), (2200, [0.0] * size, 1), (2250, [0.5] * (size + 1), 1), (2251, [0.5] * (size + 1), 2), (2300, [], 1), (2301, [-0.5] * (size + 1), 2)]


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = []
    for i, v, k in rows:
        if i is not None and v and k is not None and None not in v and np.isfinite(v).all():
            kept.append((i, np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64), k))
    out = []
    for i, a, k in kept:
        if i % every:
            continue
        others = [(-int(a @ v), j, m) for j, v, m in kept if len(v) == len(a)]
        for s, p, _ in sorted(x for x in others if x[2] == k and x[1] != i)[:positives]:
            fit = sorted(x for x in others if x[2] != k and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(df, every=50, **how):
    rows = hard_negatives.whole_numbers(df, "vec_id", "embedding", F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(rows, F.col("id") % every == 0, **how).collect())


def test_blocks_and_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    rows = clustered(1) + odd(17)
    got = mined(frame(spark, [*rows, rows[7], rows[100]]))
    assert got == brute(rows) and len({r[0] for r in got}) > 5
    assert mined(frame(spark, rows), 70, positives=2, negatives=6, low=10, high=80) == brute(rows, 70, 2, 6, 10, 80)


def test_whole_table_in_one_block(spark):
    rows = clustered(2, 200, 6, 5)
    assert mined(frame(spark, rows)) == brute(rows)


def test_bounds_hold_at_every_level_and_tighten():
    rng = np.random.default_rng(3)
    for size in (1, 3, 8, 20):
        v, w = rng.integers(-300, 300, (50, size)), rng.integers(-300, 300, (9, size)) + 100
        true, widths = v @ w.T, []
        for level in hard_negatives.bounds(*hard_negatives.summaries(v), *hard_negatives.summaries(w), size):
            low, high = level(np.arange(50))
            assert (low <= true).all() and (true <= high).all()
            widths.append((high - low).mean())
        assert widths[-1] <= widths[0] + 1e-3


def test_bounds_spare_rows_the_exact_score():
    rng = np.random.default_rng(4)
    level = np.repeat(np.arange(-20, 20), 50)[:, None] * 10
    v = level + rng.integers(-5, 6, (2000, 16))  # segments of nearly one value
    m, s = hard_negatives.summaries(v)
    ids, labels = np.arange(2000), np.array(["a"] * 2000, object)
    some = np.array([1999])
    found, scored = hard_negatives.first_in_bands((ids, labels, v, m, s), (ids[some], labels[some], v[some], m[some], s[some], [[-(2**62)]], [[2**62]]), 5, True)
    want = sorted((-int(v[1999] @ x), i) for i, x in enumerate(v) if i != 1999)[:5]
    assert [(-x[3], x[2]) for x in found] == want and scored < 300


def test_large_numbers_stay_whole():
    v = np.array([[2**30 + 1, 2**30 - 1], [3, 2**31]], np.int64)
    assert hard_negatives.products(v, v)[0, 0] == (2**30 + 1) ** 2 + (2**30 - 1) ** 2


def test_edges(spark):
    df = frame(spark, clustered(5, 80))
    assert mined(df.limit(0)) == [] and mined(frame(spark, odd(17))) == brute(odd(17))
    same = [(i, [0.5, 0.25], 1) for i in range(120)]
    assert mined(frame(spark, same)) == []
    negative = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.6, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 0.5], 2)]
    assert mined(frame(spark, negative)) == brute(negative) != []
    twice = [(50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.7], 2)]  # an id with two vectors
    assert mined(frame(spark, twice)) == brute(twice)
