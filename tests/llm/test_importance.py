"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import importance

from .helpers import docs, prose


def brute(rows, target, buckets=10_000, grams=1, least=20, percent=10):
    def found(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs], len(words)

    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(found(text)[0])
    for text in target:
        t.update(found(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for doc_id, text, *_ in rows:
        bs, words = found(text)
        weight = math.floor(sum(gain[b] for b in bs) / len(bs)) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: len(order) * percent // 100]


def bench(spark, texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "item_id long, text string, row long")


def collection(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60)) + rng.choice([" Été", " NAÏVE x_y", "\t日本 語", ""])) for i in range(n)]
    rows += [(None, rows[3][1]), (7, rows[9][1]), (8, None), (9, ""), (10, " \n"), *[rows[50]] * 30]
    return rows, [prose(rng, 30, words=("river", "stone", "harbour")) for _ in range(20)] + [None, ""]


def test_all_rows_against_brute_force(spark):
    for grams in (1, 2, 3):
        rows, target = collection(grams)
        want, order = brute(rows, target, 500, grams)
        got = importance.scored(docs(spark, rows), bench(spark, target), 500, grams)
        key = lambda r: (r[0] is None, *map(lambda x: x or 0, r))
        assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "n_words").collect()), key=key) == sorted(want, key=key)
        taken = got.join(importance.drawn(got), "row").orderBy("rank").select("doc_id", "score", "rank").collect()
        assert [(r["doc_id"], r["score"], r["rank"]) for r in taken] == [(r[0], r[3], i + 1) for i, r in enumerate(order)]


def test_slices_cut_no_word_and_no_run(spark, monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 3000) + " " + "x" * 5000 + " tail"
    known = importance.Buckets(1000)
    whole = np.concatenate([f for f, _ in importance.features(text.encode(), known, 3)])
    monkeypatch.setattr(importance, "SLICE", 64)
    monkeypatch.setattr(importance.slices, "__defaults__", (64,))
    cut = list(importance.features(text.encode(), known, 3))
    assert len(cut) > 100 and sorted(whole) == sorted(np.concatenate([f for f, _ in cut])) and sum(n for _, n in cut) == 3002


def test_cutoff_finds_every_place(spark):
    rng = random.Random(5)
    keys = [(rng.randint(-9, 9), rng.randint(0, 1), rng.randint(0, 3)) for _ in range(300)] + [(5, 0, 1)] * 200
    df = spark.createDataFrame(keys, "down long, unnamed long, id long").repartition(5)
    for k in (1, 2, 99, 250, 300, 499, 500):
        assert importance.cutoff(df, k) == sorted(keys)[k - 1]


def test_a_weighted_median_halves_the_weight():
    rng = np.random.default_rng(6)
    for _ in range(50):
        keys, weights = rng.integers(0, 5, (9, 2)), rng.integers(1, 20, 9)
        one = tuple(keys[importance._weighted_median(keys, weights)])
        before = sum(w for k, w in zip(map(tuple, keys), weights) if k < one)
        after = sum(w for k, w in zip(map(tuple, keys), weights) if k > one)
        assert 2 * before <= weights.sum() and 2 * after <= weights.sum()


def test_edges(spark):
    rows, target = collection(7, 60)
    df = docs(spark, rows).withColumnRenamed("size", "whole").withColumnRenamed("node", "row").withColumn("rank", F.lit(1)).withColumn("t", F.lit("t"))
    kept = importance.resample(df, bench(spark, target))
    _, order = brute(rows, target)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in order)
    none = importance.scored(df.limit(0), bench(spark, target))
    assert none.count() == 0 and importance.drawn(none).count() == 0
    alone = importance.scored(df, bench(spark, []))
    assert alone.count() == len(rows) and importance.resample(df.filter("doc_id < 5"), bench(spark, [])).count() == 0
