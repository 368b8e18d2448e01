"""Exact mining of hard negatives by summaries of vector segments.

Every vector is cut into segments, at several levels (1, 2, 4, ... segments), and each segment's mean
and deviation (root of the summed squares around it) are stored. For segments x and y of n components
the inner product is ``n * mean(x) * mean(y)`` give or take ``deviation(x) * deviation(y)``, so the sums over
a level bound a score from both sides. Candidates are dropped level by level, the coarsest first;
only what no level rules out is scored exactly.

A search asks, per anchor, for the first k rows of each of its bands of scores. First the positives:
one band without limits among the anchor's own label. Their scores give the bands of the negatives,
among all other labels. Rows meet anchors block against block, ``BLOCK`` rows and ``GROUP`` anchors at
most (hashed, so about that many), whatever the labels' sizes. One block is searched first; the k-th
score found there is the least that the other blocks must reach, so they give few rows.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Equal rows
(id, label and vector) are one row; an id with several vectors has a row for each, none of which is a
positive of its own id. Vectors of different lengths have no score. Ties go to the smaller id.
Products must fit 63 bits. Other columns, whatever their names, are left out. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from .vectors import usable

LEVELS = (1, 2, 4, 8)
BLOCK, GROUP, CHUNK = 16_384, 4_096, 64
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score

ROWS = "id long, label string, v array<long>, key long, means array<double>, spreads array<double>"
FOUND = "key long, anchor_id long, band int, id long, score long"


def summaries(v: np.ndarray, levels=LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, side by side."""
    means, spreads = [], []
    for count in levels:
        for a, b in edges(v.shape[1], count):
            part = v[:, a:b].astype(np.float64)
            mean = part.mean(1)
            means.append(mean)
            spreads.append(np.sqrt(((part - mean[:, None]) ** 2).sum(1)))
    return np.stack(means, 1), np.stack(spreads, 1)


def edges(size: int, count: int) -> list[tuple[int, int]]:
    """Places of the segments of a level; a vector shorter than the level has one per component."""
    cuts = sorted({i * size // count for i in range(count + 1)})
    return list(zip(cuts[:-1], cuts[1:]))


def summarised(rows: DataFrame) -> DataFrame:
    """``ROWS`` of ``id, label, v``, from a written table."""
    keyed = rows.filter("id is not null and label is not null and size(v) > 0").select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v")
    keyed = keyed.dropDuplicates(["id", "label", "v"]).withColumn("key", F.xxhash64("id", "label", "v"))

    def run(frames):
        for pdf in frames:
            pdf = pdf.reset_index(drop=True)
            means, spreads = [None] * len(pdf), [None] * len(pdf)
            for size, at in pdf.groupby(pdf["v"].map(len)).groups.items():
                m, s = summaries(np.stack(pdf["v"].loc[at].to_list()).reshape(len(at), size))
                for i, x, y in zip(at, m, s):
                    means[i], spreads[i] = x, y
            yield pdf.assign(means=means, spreads=spreads)

    path = scratch_path(rows.sparkSession, "segments")
    keyed.mapInPandas(run, ROWS).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def bounds(mx, sx, my, sy, size: int, levels=LEVELS):
    """Per level, the scores' bounds for all rows and anchors: a function of the rows still asked for."""
    at = 0
    for count in levels:
        parts = edges(size, count)
        cols = slice(at, at + len(parts))
        at += len(parts)
        n = np.array([b - a for a, b in parts], np.float64)

        def level(some, cols=cols, n=n):
            mid = (mx[some, cols] * n) @ my[:, cols].T
            off = sx[some, cols] @ sy[:, cols].T
            slack = 1e-9 * (np.abs(mx[some, cols] * n) @ np.abs(my[:, cols]).T + off) + 1e-6  # rounding
            return mid - off - slack, mid + off + slack

        yield level


def products(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products."""
    largest = float(np.abs(v).max(initial=0)) * float(np.abs(w).max(initial=0)) * v.shape[1]
    if largest < 2**53:
        return (v.astype(np.float64) @ w.astype(np.float64).T).astype(np.int64)
    return v @ w.T


def first_in_bands(rows, anchors, k: int, same: bool) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(anchor, band, id, score)`` of each band's first k rows, and how many rows were scored.

    ``rows``: ids, labels, v, means, spreads; ``anchors``: the same and per anchor lists of its
    bands' lowest and highest scores. ``same``: rows of the anchor's label, else of the others."""
    ids, labels, v, mx, sx = rows
    own, marks, w, my, sy, lows, highs = anchors
    out, scored = [], 0
    for a in range(0, len(own), CHUNK):
        some = slice(a, a + CHUNK)
        fits = labels[:, None] == marks[None, some]
        fits = fits & (ids[:, None] != own[None, some]) if same else ~fits
        low = [np.array(x, np.float64) for x in lows[some]]
        high = [np.array(x, np.float64) for x in highs[some]]
        floor, roof = np.array([x.min() for x in low]), np.array([x.max() for x in high])
        alive = np.flatnonzero(fits.any(1))
        for level in bounds(mx, sx, my[some], sy[some], v.shape[1]):
            if not len(alive):
                break
            least, most = level(alive)
            if same and len(alive) >= k:  # one band without an upper end: k rows score this at least
                sure = np.where(fits[alive], least, -np.inf)
                floor = np.maximum(floor, np.partition(sure, len(sure) - k, axis=0)[len(sure) - k])
            kept = fits[alive] & (most >= floor) & (least <= roof)
            fits[alive] = kept
            some_left = kept.any(1)
            alive, least, most = alive[some_left], least[some_left], most[some_left]
        if not len(alive):
            continue
        if not same:  # the finest bounds, band by band
            for j in range(fits.shape[1]):
                at = np.flatnonzero(fits[alive, j])
                kept = np.zeros(len(at), bool)
                for lo, hi in zip(low[j], high[j]):
                    sure = np.where(most[at, j] <= hi, least[at, j], -np.inf)
                    if len(sure) >= k:
                        lo = max(lo, np.partition(sure, len(sure) - k)[len(sure) - k])
                    kept |= (least[at, j] <= hi) & (most[at, j] >= lo)
                fits[alive[at[~kept]], j] = False
            alive = alive[fits[alive].any(1)]
            if not len(alive):
                continue
        scored += len(alive)
        scores, asked = products(v[alive], w[some]), fits[alive]
        for j in range(asked.shape[1]):
            at = np.flatnonzero(asked[:, j])
            mine, names = scores[at, j], ids[alive[at]]
            for b, (lo, hi) in enumerate(zip(lows[a + j], highs[a + j])):
                inside = (mine >= lo) & (mine <= hi)
                s, n = mine[inside], names[inside]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    s, n = s[s >= edge], n[s >= edge]
                for i in np.lexsort((n, -s))[:k]:
                    out.append((a + j, b, int(n[i]), int(s[i])))
    return out, scored


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again, with a known size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _search(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``FOUND`` of the cells of blocks and groups of ``anchors`` (``ROWS`` and ``lows, highs``), each
    band's first k within each cell that can be among the first k of all."""
    cell = ["part", "block", "grp"]
    spot = lambda count: F.pmod(F.xxhash64("key", F.lit(7)), F.col(count))
    every = lambda a, b: F.explode(F.sequence(a, b - 1))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = lambda count, size: F.greatest(F.ceil(count / size), F.lit(1)).cast("long")
    if same:  # each label has its own blocks and groups
        sizes = rows.groupBy("label").agg(parts(F.count(F.lit(1)), BLOCK).alias("blocks"))
        groups = anchors.groupBy("label").agg(parts(F.count(F.lit(1)), GROUP).alias("groups"))
        grid = _kept(sizes.join(groups, "label"), "grid")
        most = grid.agg(F.max("blocks")).first()[0] or 1
        placed_in = lambda df: df.join(grid, "label").withColumn("part", F.col("label"))
    else:
        most, groups = -(-rows.count() // BLOCK) or 1, -(-anchors.count() // GROUP) or 1
        placed_in = lambda df: df.withColumns({"part": F.lit(""), "blocks": F.lit(most).cast("long"), "groups": F.lit(groups).cast("long")})
    placed = placed_in(rows).withColumn("block", spot("blocks"))

    def met(asked: DataFrame, first: bool) -> DataFrame:
        left = placed.filter(F.col("block") == 0 if first else F.col("block") > 0).withColumn("grp", every(zero, F.col("groups")))
        right = placed_in(asked).withColumn("grp", spot("groups"))
        right = right.withColumn("block", zero) if first else right.filter("blocks > 1").withColumn("block", every(one, F.col("blocks")))
        left = left.select(*cell, "id", "label", "v", "means", "spreads")
        right = right.select(*cell, "key", "id", "label", "v", "means", "spreads", "lows", "highs")
        right = right.toDF(*right.columns)  # columns of their own
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, FOUND)

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        length = lambda t: t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
        here, there = length(data), length(asked)
        for size in np.unique(there):
            mine, theirs = data.filter(pa.array(here == size)), asked.filter(pa.array(there == size))
            if not mine.num_rows:
                continue
            width = sum(len(edges(int(size), c)) for c in LEVELS)

            def columns(t: pa.Table):
                arrays = [t.column(c).combine_chunks() for c in ("v", "means", "spreads")]
                return t.column("id").to_numpy(), np.array(t.column("label").to_pylist(), object), _matrix(arrays[0], size), _matrix(arrays[1], width), _matrix(arrays[2], width)

            lows, highs = theirs.column("lows").to_pylist(), theirs.column("highs").to_pylist()
            keys, names = theirs.column("key").to_numpy(), theirs.column("id").to_numpy()
            some, _ = first_in_bands(columns(mine), (*columns(theirs), lows, highs), k, same)
            found += [(int(keys[a]), int(names[a]), b, i, s) for a, b, i, s in some]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names=[c.split()[0] for c in FOUND.split(", ")])

    start = _kept(met(anchors, True), "first-block")
    if most == 1:
        return start
    # k rows of a band found so far: nothing below the k-th is asked for any more
    reached = start.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    reached = reached.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("reached"))
    raised = anchors.join(reached, "key", "left").withColumn(
        "lows", F.transform("lows", lambda low, b: F.greatest(low, F.coalesce(F.try_element_at(F.col("reached"), b), low)))
    )
    return start.unionByName(met(raised.drop("reached"), False))


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("key", "band").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``id, label, v``
    (whole numbers): per anchor and each of its first ``positives`` rows of the same label the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive."""
    stored = summarised(rows)
    anchors = stored.filter(is_anchor)
    none = F.lit(np.iinfo(np.int64).min).cast("long"), F.lit(np.iinfo(np.int64).max).cast("long")
    near = _search(stored, anchors.withColumns({"lows": F.array(none[0]), "highs": F.array(none[1])}), positives, True)
    near = _first(near, positives).select("key", "id", "score")
    # whole scores s with low * p <= 100 * s <= high * p; a negative p leaves none
    lowest = F.expr(f"(score * {low} + IF(score > 0, 99, 0)) div 100")
    highest = F.expr(f"(score * {high} - IF(score < 0, 99, 0)) div 100")
    bands = near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), lowest.alias("low"), highest.alias("high"))
    lists = bands.filter("low <= high").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score", "low", "high"))).alias("bands"))
    lists = _kept(lists, "bands")
    asked = anchors.join(lists, "key").withColumns({"lows": F.transform("bands", lambda b: b["low"]), "highs": F.transform("bands", lambda b: b["high"])}).drop("bands")
    asked = _kept(asked, "asked")
    found = _first(_search(stored, asked, negatives, False), negatives)
    out = found.join(lists, "key").withColumn("p", F.element_at("bands", F.col("band") + 1))
    return out.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))


def whole_numbers(df: DataFrame, vec_id: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``id, label, v``: components times ``scale``, rounded down."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), label.alias("label"), v.alias("v"))


def op11_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_numbers(table(spark, sf, "embeddings"), "vec_id", "embedding", label), F.col("id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": f"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= {NEGATIVES}"""
}
