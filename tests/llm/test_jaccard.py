"""The similarity join against all pairs."""

import random
import time

import numpy as np

from seriesloom.llm import common, jaccard

from .helpers import by_id, docs, prose


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def brute(rows):
    names = [i for i, _ in rows]
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(s[a] & s[b])
            if s[a] and s[b] and 100 * shared >= 85 * (len(s[a]) + len(s[b]) - shared):
                up[find(a)] = find(b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), names[i]), names[i])
    return {names[i]: (len(s[i]), least[find(i)]) for i in range(len(rows))}


def corpus(seed, originals=12, copies=14):
    rng = random.Random(seed)
    out, line = [], prose(rng, 60)
    for k in range(originals):
        base = (line + " " if k % 3 == 0 else "") + prose(rng, rng.randint(5, 120))
        for _ in range(rng.randint(1, copies)):
            w = base.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def found(df):
    return {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.components(df)).items()}


def test_components_are_those_of_all_pairs(spark):
    rows = corpus(1)
    assert found(docs(spark, rows)) == brute(rows)


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    rows = corpus(2, originals=4, copies=40)
    assert found(docs(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "a b c d"), (8, "x " * 50_000), (9, "x " * 50_001)]
    want = brute(rows)
    assert found(docs(spark, rows)) == want and want[5] == (1, 4) and want[9][1] == 8
    more = docs(spark, [*rows, (None, "a b c d"), (7, "a b c d"), (7, "a b c d")])
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.components(more).collect()]
    assert sorted(c for d, c in got if d == 7) == [7, 7, 7] and [c for d, c in got if d is None] == [7]
    kept = jaccard.without_copies(more)
    assert kept.columns == more.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert jaccard.components(more.limit(0)).count() == 0


def test_copies_are_decided_by_text(spark):
    """A repeated id with two texts, and near copies without ids."""
    rng = random.Random(9)
    one, two, three, four = (prose(rng, 60) for _ in range(4))
    rows = [(1, one), (2, one), (2, two), (2, two), (3, three), (3, four), (None, one + " end"), (None, one), (None, three), (None, ""), (None, " ")]
    alone = prose(rng, 60)
    rows += [(None, alone), (None, alone + " end"), (None, alone)]
    got = [(r["doc_id"], r["text"]) for r in jaccard.without_copies(docs(spark, rows)).collect()]
    assert sorted(got[k] for k in range(len(got)) if got[k][0]) == sorted([(1, one), (2, two), (3, three), (3, four)])
    nameless = [t for i, t in got if i is None]
    assert len(nameless) == 5 and sum(t.startswith(one) for t in nameless) == 1 and sum(t.startswith(alone) for t in nameless) == 1 and three in nameless


def test_first_shingles_meet_under_every_order():
    rng, levels = np.random.default_rng(3), np.random.default_rng(4).integers(0, 3, jaccard.SKETCH).astype(np.uint8)
    for n in (1, 2, 7, 40, 200):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for size in range(len(b), -1, -1):  # drop as many as a link allows
            c = b[:size]
            if 100 * len(c) < 85 * len(a):
                break
            for order in range(jaccard.ORDERS):
                assert len(np.intersect1d(jaccard.first(a, levels, order), jaccard.first(c, levels, order)))


def test_connected(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(45)] + [(7, 7)]
    up = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: r for n, r in up.items() if n != r}


def test_linked_sets_share_a_first_part():
    rng, levels = np.random.default_rng(3), np.random.default_rng(4).integers(8, 40, jaccard.SKETCH).astype(np.uint8)
    linked = 0
    for percent in (85, 80, 50):
        for _ in range(400):
            x = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
            gone, new = rng.integers(0, jaccard.most_apart(len(x), percent)[1] + 1, 2)
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(x) == len(y) == shared or 100 * shared < percent * (len(x) + len(y) - shared):
                continue
            linked += 1
            for salt in (0, 1):
                assert len(np.intersect1d(jaccard.first_parts(x, levels, percent, salt), jaccard.first_parts(y, levels, percent, salt)))
    assert linked > 100


def test_passages_shared_by_chance_make_no_groups(spark):
    rng = random.Random(9)
    own = [[f"w{rng.randrange(10**9)}" for _ in range(120)] for _ in range(60)]
    rows = [(i, " ".join([*w, *own[(i + 1) % 60][:12]])) for i, w in enumerate(own)]  # each has the first words of the next
    d = docs(spark, rows)
    levels = spark.sparkContext.broadcast(np.zeros(jaccard.SKETCH, np.uint8))  # as where all cells count alike
    assert jaccard.candidate_groups(d, levels).count() < 6
    assert found(d) == brute(rows)


def test_groups_of_several_blocks_are_parted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    rows = corpus(12, originals=6, copies=30)
    assert found(docs(spark, rows)) == brute(rows)


def test_no_shuffle_files_stay(spark):
    def files():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle_" in str(blocks.apply(i))}

    before = files()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    kept = jaccard.labels(docs(spark, corpus(2)), 4, 85)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert kept.count() == len(corpus(2))
