"""Mixing against its SQL and its promises."""

import random
from fractions import Fraction

from seriesloom.llm import mixing

from .helpers import docs, prose


def fill(sizes, weights, total, most=2):
    """Targets by giving out the rest again and again."""
    full, rest = {}, dict(zip(range(len(sizes)), sizes))
    while rest:
        left = total - sum(full.values())
        share = {i: left * Fraction(weights[i], sum(weights[j] for j in rest)) for i in rest}
        over = [i for i in rest if share[i] >= most * rest[i]]
        if not over:
            return [full.get(i, share.get(i)) for i in range(len(sizes))]
        for i in over:
            full[i] = Fraction(most * rest.pop(i))
    return [full[i] for i in range(len(sizes))]


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["b", "a", "a", "a", "a", "Z", "é", None])) for i in range(3000)]
    got = mixing.taken(docs(spark, rows)).collect()
    names = ["Z", "a", "b", "é", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = fill(sizes, [5, 2, 1, 5, 2], Fraction(3, 2) * sum(sizes))
    source = {i: s for i, _, s in rows}
    for n, size, target in zip(names, sizes, want):
        mine = [r for r in got if source[r["doc_id"]] == n]
        assert {r["source_size"] for r in mine} == {size} and all(abs(r["target"] - float(target)) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 180  # a few documents' words
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.taken(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "one two", "a"), (3, "one two", "a"), (3, "one two", "a"), (4, " \t\n", "b"), (5, "w " * 30_000, "c")]
    df = docs(spark, rows)
    got = sorted(((r["doc_id"] or 0), r["size"], r["source_size"]) for r in mixing.taken(df).collect())
    assert got == [(0, 2, 6), (1, 0, 0), (2, 0, 6), (3, 2, 6), (3, 2, 6), (4, 0, 0), (5, 30000, 30000)]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.filter("doc_id = 5").count() in (1, 2)
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_the_mixture_has_each_document_as_often_as_it_is_taken(spark):
    rng = random.Random(2)
    df = docs(spark, [(i, prose(rng, rng.randint(1, 30)), rng.choice("aaab")) for i in range(400)])
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(df).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.mix(df).groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}
