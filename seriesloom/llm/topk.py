"""Exact top-k search by inner product with a pivot table.

Every vector's distances to the pivots are computed once. For a query q and a vector x no pivot p can
be further from one than from the other by more than their distance, so ``max_p |d(q, p) - d(x, p)|``
bounds it from below and, with the norms, the inner product from above. A query's candidates are
evaluated in order of that bound until it falls below the k-th best score, so the result is exact.

The stated queries meet all vectors block against block: a block holds ``BLOCK`` vectors and a group
``GROUP`` queries at most (hashed, so about that many), whatever the data's distribution. A block
gives k rows per query; those meet in one top-k with a limit per task before the shuffle.

Null vectors and vectors with null or non-finite components take no part, nor do rows without an id.
Vectors of different lengths have no score. Equal rows (same id, same vector) are one row; an id with
several vectors has a row for each, and none is a candidate of its own id's query, whose scores are
those of all its vectors together. Ties go to the smaller id. Other columns, whatever their names,
are left out. No vectors: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .vectors import usable

PIVOTS = 32
BLOCK, GROUP = 16_384, 1_024
STEP = 256
SCALE = 1024


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def pivoted(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``id, v, d``: whole-number vectors and their distances to the pivots, which are so many
    vectors of their length, the first by hash."""
    chosen = vectors.withColumn("_h", F.xxhash64("id", "v")).withColumn("_n", F.size("v"))
    lengths = chosen.groupBy("_n").agg(F.min_by("v", "_h").alias("v")).orderBy("_n").limit(pivots)
    some = chosen.orderBy("_h").limit(pivots)
    kept: dict[int, list] = {}
    for row in [*some.select("v").collect(), *lengths.select("v").collect()]:  # a fixed number of rows
        kept.setdefault(len(row["v"]), []).append(row["v"])
    tables = {n: np.array(v, np.float64).reshape(len(v), n) for n, v in kept.items()}

    def run(frames):
        for pdf in frames:
            out = []
            for v in pdf["v"]:
                p = tables.get(len(v))
                out.append(_distances(np.array(v, np.float64)[None], p)[0].tolist() if p is not None and len(v) else [])
            yield pdf.assign(d=out)

    return vectors.mapInPandas(run, "id long, v array<long>, d array<double>")


def best_in_block(q: np.ndarray, qd: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, d: np.ndarray, square: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``(score, id)`` of the k best vectors for one query, in order of their bounds."""
    apart = np.abs(d - qd).max(1) if d.shape[1] else np.zeros(len(ids))
    bound = (float((q * q).sum()) + square - apart * apart) / 2
    bound += 1e-9 * (np.abs(bound) + float((q * q).sum()) + square) + 1e-6  # rounding of the distances
    order = np.argsort(-bound, kind="stable")
    order = order[ids[order] != own]
    scores, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(order), STEP):
        if len(scores) == k and bound[order[a]] < scores[-1]:
            break
        at = order[a : a + STEP]
        scores, names = np.concatenate([scores, v[at] @ q]), np.concatenate([names, ids[at]])
        by = np.lexsort((names, -scores))[:k]
        scores, names = scores[by], names[by]
    return list(zip(scores.tolist(), names.tolist()))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row of ``vectors`` (``id
    long, v array<long>``) that is a query."""
    rows = cut_lineage(pivoted(vectors.filter("id is not null").dropDuplicates(["id", "v"])))
    queries = rows.filter(is_query)
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // GROUP))
    spot = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("long")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = rows.select(spot(blocks).alias("block"), every(groups).alias("grp"), "id", "v", "d")
    right = queries.select(every(blocks).alias("block"), spot(groups).alias("grp"), "id", "v", "d")

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in {len(v) for v in asked["v"]}:
            mine, theirs = data[data["v"].map(len) == size], asked[asked["v"].map(len) == size]
            if not len(mine):
                continue
            v = np.array(mine["v"].tolist(), np.int64).reshape(len(mine), size)
            d = np.array(mine["d"].tolist(), np.float64).reshape(len(mine), -1)
            ids, square = mine["id"].to_numpy(), (v * v).sum(1).astype(np.float64)
            for own, q, qd in zip(theirs["id"], theirs["v"], theirs["d"]):
                found = best_in_block(np.array(q, np.int64), np.array(qd, np.float64), own, ids, v, d, square, k)
                out += [(own, name, score) for score, name in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, v``: components times ``scale``, rounded down."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def op1_topk(spark, sf):
    return search(whole_numbers(table(spark, sf, "embeddings"), "vec_id", "embedding"), F.col("id") % 100 == 0)


QUERIES = {"op1_topk": op1_topk}
ORACLES = {
    "op1_topk": f"""WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
