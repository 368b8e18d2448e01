"""Importance resampling towards a target distribution: features in hashed buckets, array-scored
weights, and a distributed selection of the highest keys.

1. Counts: words are hashed into ``BUCKETS`` buckets; one pass over the corpus and one over the
   target texts count them, an array of that fixed length per task, summed by bucket.
2. Weights: a bucket's gain is the logarithm of its smoothed share in the target over that in the
   corpus, in whole thousandths. A text's weight is the floored mean of the gains of its features,
   looked up in one array; Gumbel noise from the id's digest makes its score. Scores are written once.
3. Selection: of the texts with enough words the highest scores are drawn. Every round asks each task
   for the median of its remaining keys, weighted by how many remain; the weighted median of those
   splits the rest, and the side without the cutoff goes. A task's median is the weighted median of
   its batches' medians, so a task holds one batch, and a guaranteed fraction (an eighth at least) goes
   each round. What the driver sees is one row per task.
4. Order: only the drawn rows are sorted, in ranges, and numbered.

Words are runs of ``[0-9a-z]`` and of characters beyond ASCII after lower-casing A to Z. Null and empty
texts have no features and weight 0. A row without an id takes the noise of the empty id and comes
after named ones in a tie. Rows equal in score and id are told apart by their features, weight and
text's hash; repeated rows are drawn as often as places are left. No documents: no rows; no target texts:
all counts of the target are 0. Texts of any length are read whole, a slice at a time. Other columns,
whatever their names, are left out by ``scored`` and kept by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import global_rank
from ..session import cut_lineage, scratch_path
from ..sources.tables import table
from .common import documents, map_text

BUCKETS, GRAMS = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
SLICE = 1 << 20
KNOWN = 1 << 18  # buckets a task remembers before it starts anew
_MARKS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, of about ``size`` bytes at a time; no word is cut."""
    plain, at = text.translate(_MARKS), 0
    while at < len(plain):
        end = plain.find(b" ", at + size) if at + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Buckets(dict):
    """Bucket of a feature, remembered; emptied when full."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def features(text: bytes, known: Buckets, grams: int = GRAMS) -> Iterator[tuple[np.ndarray, int]]:
    """Per slice of a text: the buckets of its features (runs of 1 to ``grams`` words) and its number of words."""
    before: list[bytes] = []
    for words in slices(text):
        found = list(map(known.__getitem__, words))
        for n in range(2, grams + 1):
            run = before[-(n - 1) :] + words
            found += map(known.__getitem__, map(b" ".join, zip(*(run[i:] for i in range(n)))))
        before = (before + words)[-(grams - 1) :] if grams > 1 else before
        yield np.array(found, np.int64), len(words)


def _bytes(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """Features per bucket over all rows; one row per bucket reaches the driver."""

    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for found, _ in features(text.as_py(), known, grams):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for row in map_text(_bytes(texts), run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[row["b"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in whole thousandths from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """Per row, from a written table: ``doc_id, n_features, n_words, weight, score``, ``t`` (a hash of
    its text) and ``row`` (a number of its own); with ``whole`` the row's own columns too, as a struct."""
    gain = gains(bucket_counts(docs, buckets, grams), bucket_counts(target, buckets, grams))
    kept = ["doc_id", "t", *["whole"] * whole]

    def run(batches):
        known = Buckets(buckets)
        for batch in batches:
            n_features, n_words, weights = [], [], []
            for text in batch.column("text"):
                total = count = words = 0
                for found, n in features(text.as_py(), known, grams):
                    total, count, words = total + int(gain[found].sum()), count + len(found), words + n
                n_features.append(count)
                n_words.append(words)
                weights.append(total // count if count else 0)
            made = [pa.array(c, pa.int64()) for c in (n_features, n_words, weights)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n_features", "n_words", "weight"])

    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = _bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), own, "text"), *kept)
    schema = rows.select(*kept).schema
    for name in ("n_features", "n_words", "weight"):
        schema = schema.add(name, "long")
    path = scratch_path(docs.sparkSession, "importance")
    found = rows.mapInArrow(run, schema)
    found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


KEY = ("down", "unnamed", "id")  # score from the highest, then the smaller id, none last


def _weighted_median(keys: np.ndarray, weights: np.ndarray) -> int:
    """Place of the first key, in order, with half of all weight at or before it."""
    order = np.lexsort(keys.T[::-1])
    upto = np.cumsum(weights[order])
    return int(order[np.searchsorted(upto, -(-int(upto[-1]) // 2))])


def cutoff(rows: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th smallest key of ``rows`` (columns ``KEY``; 1 <= k <= number of rows), by weighted
    medians of medians."""

    def ask(pivot, low, high):
        """Per task: remaining keys before, at and after the pivot, and a median of either side."""

        def side(before: np.ndarray, found: list):
            if len(before):
                found.append((before[np.lexsort(before.T[::-1])[(len(before) - 1) // 2]], len(before)))

        def run(batches):
            at, left, right = 0, [], []
            for batch in batches:
                keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
                inside = np.ones(len(keys), bool)
                if low is not None:
                    inside &= _after(keys, low)
                if high is not None:
                    inside &= _after(-keys, tuple(-x for x in high))
                keys = keys[inside]
                if pivot is None:
                    side(keys, left)
                    continue
                larger, smaller = _after(keys, pivot), _after(-keys, tuple(-x for x in pivot))
                side(keys[smaller], left)
                side(keys[larger], right)
                at += int((~larger & ~smaller).sum())
            out = []
            for found in (left, right):
                total = sum(n for _, n in found)
                if total:
                    every = np.array([x for x, _ in found])
                    out += [[int(x) for x in every[_weighted_median(every, np.array([n for _, n in found]))]], total]
                else:
                    out += [None, 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([out[0]], pa.list_(pa.int64())), pa.array([out[1]], pa.int64()), pa.array([at], pa.int64()), pa.array([out[2]], pa.list_(pa.int64())), pa.array([out[3]], pa.int64())],
                ["left", "n_left", "n_at", "right", "n_right"],
            )

        left = rows.select(*KEY)
        if low is not None:
            left = left.filter(F.col(KEY[0]) >= low[0])
        if high is not None:
            left = left.filter(F.col(KEY[0]) <= high[0])
        return map_text(left, run, "left array<long>, n_left long, n_at long, right array<long>, n_right long").collect()

    def median(found, name):
        some = [r for r in found if r[f"n_{name}"]]
        keys = np.array([r[name] for r in some], np.int64)
        return tuple(int(x) for x in keys[_weighted_median(keys, np.array([r[f"n_{name}"] for r in some], np.int64))])

    low = high = None
    pivot = median(ask(None, None, None), "left")
    while True:
        found = ask(pivot, low, high)
        before, at = sum(r["n_left"] for r in found), sum(r["n_at"] for r in found)
        if before < k <= before + at:
            return pivot
        if k <= before:
            high, pivot = pivot, median(found, "left")
        else:
            k -= before + at
            low, pivot = pivot, median(found, "right")


def _after(keys: np.ndarray, key: tuple) -> np.ndarray:
    """Rows of ``keys`` that come after ``key``."""
    out, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for c, x in enumerate(key):
        out |= same & (keys[:, c] > x)
        same &= keys[:, c] == x
    return out


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``row, rank`` of the drawn rows of ``scored``."""
    enough = rows.filter(F.col("n_words") >= least_words)
    k = enough.count() * percent // 100
    if not k:
        return rows.limit(0).select("row", F.lit(0).cast("long").alias("rank"))
    key = {"down": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))}
    keyed = enough.withColumns(key)
    cut = cutoff(keyed, k)
    upto = F.struct(*KEY) <= F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(KEY, cut)))
    # a row's own number tells apart only rows that agree in all else
    placed = global_rank(keyed.filter(upto).select("row", F.struct(*KEY, "n_features", "weight", "t", "row").alias("place")), "place", "rank")
    return placed.filter(F.col("rank") < k).select("row", (F.col("rank") + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """The drawn documents with their own columns; ``how`` goes to ``scored``."""
    rows = scored(docs, target, whole=True, **how)
    return rows.select("row", "whole").join(drawn(rows.drop("whole"), least_words, percent), "row", "left_semi").select("whole.*")


def op13_importance_resampling(spark, sf):
    rows = scored(documents(spark, sf), table(spark, sf, "benchmark"))
    return rows.join(drawn(rows), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op13_importance_resampling": f"""WITH steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOWER}, '{_WORDS}')) AS w FROM benchmark) GROUP BY ALL),
ws AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(h) // 2)],
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM ws, steps),
s AS (SELECT b, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {BUCKETS})
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (b)),
x AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (b) GROUP BY r),
y AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= {LEAST_WORDS}) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM k"""
}
