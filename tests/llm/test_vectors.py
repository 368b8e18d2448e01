"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, 2) for i, v, k in rows], SCHEMA)


def odd_rows(size):
    return [(None, [0.5] * size, 1), (900, None, 1), (901, [float("nan")] * size, 1), (902, [float("inf")] + [0.0] * (size - 1), 1), (903, [None] + [0.0] * (size - 1), 1), (904, [0.0] * size, 1), (905, [0.1] * (size + 1), 1), (906, [], 1)]


def test_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[50:80] = v[50]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    df = frame(spark, [*rows, rows[7], *odd_rows(16)])
    got = sorted(tuple(r) for r in topk.search(topk.whole_numbers(df, "vec_id", "embedding"), F.col("id") % 100 == 0, 10).collect())
    whole = {i: np.floor(np.float64(np.float32(x)) * 1024).astype(np.int64) for i, x in enumerate(v)} | {904: np.zeros(16, np.int64)}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    # the null vector 900 is no query; all rows have int ids
    assert got == sorted(want)
    assert topk.search(topk.whole_numbers(df.limit(0), "vec_id", "embedding"), F.col("id") % 100 == 0).count() == 0


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (2000, 8))
    pivots = v[:20].astype(np.float64)
    d = topk._distances(v.astype(np.float64), pivots)
    square = (v * v).sum(1).astype(np.float64)
    for q in (3, 11):
        got = topk.best_in_block(v[q], d[q], q, np.arange(2000), v, d, square, 5)
        assert got == sorted(((int(v[q] @ x), i) for i, x in enumerate(v) if i != q), key=lambda x: (-x[0], x[1]))[:5]


def brute(rows, least=0.98):
    good = [(i, np.asarray(v, np.float64), k) for i, v, k in rows if v is not None and k is not None and len(v) and None not in v and np.isfinite(np.asarray(v, np.float64)).all() and np.any(v)]
    links = {}
    for a in range(len(good)):
        for b in range(a):
            (i, x, k), (j, y, m) = good[a], good[b]
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    return links


def clustered(seed, groups=60, size=24):
    rng, rows, n = np.random.default_rng(seed), [], 0
    for g in range(groups):
        c = rng.standard_normal(size)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, (c + rng.standard_normal(size) * rng.choice([0, 0.02, 0.08, 0.14])).astype(np.float32).tolist(), g % 3))
            n += 1
    return rows


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 3)
    rows = clustered(3)
    links = brute(rows)
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(frame(spark, rows), "vec_id", "embedding", "label").collect()}
    all_links, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert found <= all_links and found >= 0.97 * all_links  # measured recall
    assert all(r["n_links"] <= len(links.get(i, ())) for i, r in got.items())
    for i, r in got.items():
        todo, seen = [i], {i}
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert r["component_id"] in seen and r["kept"] == (r["component_id"] == i)


def test_near_vector_edges(spark):
    base = np.linspace(1, 2, 12).tolist()
    rows = [(5, base, 1), (4, base, 1), (3, base, 2), (2, base, None), (6, [2 * x for x in base], 1), (6, base, 1), *odd_rows(12)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(frame(spark, rows), "vec_id", "embedding", "label").collect())
    assert [g for g in got if g[0] in (2, 3)] == [(2, 0, 2, True), (3, 0, 3, True)]
    assert [g for g in got if g[0] in (4, 5, 6)] == [(4, 3, 4, True), (5, 3, 4, False), (6, 3, 4, False), (6, 3, 4, False)]
    assert [g for g in got if g[0] == 0] == [(0, 0, None, False)]
    assert all(g[1] == 0 and g[3] for g in got if g[0] >= 900)
    assert near_vectors.near_duplicates(frame(spark, rows).limit(0), "vec_id", "embedding", "label").count() == 0
