"""Small tables for the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node long"  # the last two clash with working columns


def docs(spark, rows, schema=DOCS):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 5, None) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(rng: random.Random, n: int, words=("the", "of", "and", "river", "stone", "green", "light", "winter", "morning", "walk", "house", "garden")) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "er", "ly", str(rng.randint(0, 99))]) for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
