"""BM25, exact vector search, rank fusion and batch search for many queries at once.

Queries are ``(query_id, query_text[, query_vector])``, chunks ``(id, content[, embedding, …])``,
hits ``(query_id, id, score, rank)``. Scores are rounded before ranking and ties go to the smaller
id, so a result does not depend on the order in which partial sums arrive."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..session import cut_lineage, written
from .scan import top_per_group

K1, B = 1.5, 0.75
RRF_K = 60
SCORE_DIGITS = 6
# query vectors held by a task at once: 4,096 x 1,024 doubles are 32 MB
QUERY_BLOCK = 4_096
# word queries scored in one scan, and the query terms of a block: 256 queries x 20,000 terms are
# about 41 MB of weights in a task
WORD_BLOCK, BLOCK_PAIRS = 256, 20_000
# cells of a count or score table inside a task: 16 MB of doubles
SCORE_CELLS = 2_000_000


def term_postings(chunks: DataFrame, terms: DataFrame | None = None, cjk: bool = False) -> DataFrame:
    """(term, id, tf, dl). With ``terms`` only those terms are kept, before the counts are
    shuffled; the join side is chosen by Spark from its measured size. Without, the chunks are dealt by id,
    so that their terms are counted where they are: a chunk's text is shuffled, not a row for each term."""
    base = token_index(chunks if terms is not None else chunks.select("id", "content").repartition("id"), cjk)
    exploded = base.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    if terms is not None:
        exploded = exploded.join(terms.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_size(chunks: DataFrame, cjk: bool = False) -> DataFrame:
    """One row: number of chunks and mean length in tokens."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(tokens(F.col("content"), cjk))).alias("avg_len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, cjk: bool = False) -> DataFrame:
    """(query_id, term, qtf): a term asked for twice counts twice."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("query_text"), cjk)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, cjk: bool = False) -> DataFrame:
    """(query_id, id, score) for every chunk sharing a term with a query."""
    asked = query_terms(queries, cjk)
    postings = term_postings(chunks, asked, cjk)
    df = document_frequencies(postings)
    size = corpus_size(chunks, cjk)
    weighted = asked.join(df, "term").withColumns({"n_chunks": size.select("n_chunks").scalar(), "avg_len": size.select("avg_len").scalar()})
    idf = F.log1p((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avg_len")
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * length)
    scored = postings.join(weighted, "term").select("query_id", "id", part.alias("s"))
    return scored.groupBy("query_id", "id").agg(F.round(F.sum("s"), SCORE_DIGITS).alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_per_group(scores, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def token_index(chunks: DataFrame, cjk: bool = False) -> DataFrame:
    """(id, t): the tokens of every chunk, with pairs of Chinese characters if ``cjk``. Write it
    next to the chunk table and hand it to ``search`` to search an unchanged corpus again."""
    return chunks.select("id", tokens(F.col("content"), cjk).alias("t"))


def _score_block(names: list, terms: list[str], weights: np.ndarray, avg_len: float, k: int, k1: float, b: float, schema: pa.Schema):
    """Scores a partition of tokens against one block of queries: the asked terms that a chunk has,
    saturated, times their query weights; k chunks per query stay. Work follows the terms of the
    chunks, not the vocabulary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = pa.array(terms, pa.string()), len(terms)
        by_term = np.ascontiguousarray(weights.T)
        most = max(1, SCORE_CELLS // len(names))
        best = _no_hits()
        for batch in batches:
            all_ids, lists = batch.column(0), batch.column(1)
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known].astype("int64")
            cells, tf = np.unique(rows * width + pc.drop_null(at).to_numpy(zero_copy_only=False), return_counts=True)
            if not len(cells):
                continue
            row, col = cells // width, cells % width
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avg_len))
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            # as many whole chunks at once as have ``most`` terms, one at least
            first = 0
            while first < len(starts):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, side="right")) - 1)
                last = len(starts) if starts[first] + most >= len(cells) else last
                lo, hi = starts[first], len(cells) if last == len(starts) else starts[last]
                sums = np.add.reduceat(share[lo:hi, None] * by_term[col[lo:hi]], starts[first:last] - lo, axis=0)
                ids = np.array(all_ids.take(pa.array(row[starts[first:last]])).to_pylist())
                best = _keep_best(best, np.round(sums.T, SCORE_DIGITS), ids, k, positive=True)
                first = last
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in best["q"]], schema.field(0).type), pa.array(best["id"].to_list(), schema.field(1).type), pa.array(best["score"])],
                schema=schema,
            )

    return scan


def bm25_search(
    chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, index: DataFrame | None = None,
    block: int = WORD_BLOCK, cjk: bool = False,
) -> DataFrame:
    """Best k chunks per query. The tokens are scanned where they lie and never shuffled: a first
    pass counts lengths and document frequencies of the asked terms, then each block of queries
    is scored in one scan that keeps k chunks per query and task. A block has about ``block``
    queries, fewer where they have many terms."""
    index = written(token_index(chunks, cjk), "token-index") if index is None else index
    asked = cut_lineage(query_terms(queries, cjk))
    sizes = asked.agg(F.count_distinct("query_id"), F.count(F.lit(1))).first()
    n_blocks = max(1, math.ceil(sizes[0] / (block * 0.8)), math.ceil(sizes[1] / (BLOCK_PAIRS * 0.8)))
    in_block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    corpus = index.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avg_len")).first()
    vocabulary = asked.select("term").distinct()
    df = index.select(F.explode(F.array_distinct("t")).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = cut_lineage(asked.join(df, "term").withColumn("w", F.col("qtf") * F.log1p((corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    id_type, query_type = dict(index.dtypes)["id"], dict(asked.dtypes)["query_id"]
    ddl = f"query_id {query_type}, id {id_type}, score double"
    found = None
    for part in range(n_blocks):
        mine = weighted.filter(in_block == part).select("query_id", "term", "w").toPandas()
        if not len(mine):
            continue
        q, names = pd.factorize(mine["query_id"])
        t, terms = pd.factorize(mine["term"], sort=True)
        weights = np.zeros((len(names), len(terms)))
        weights[q, t] = mine["w"]
        schema = to_arrow_schema(index.sparkSession.createDataFrame([], ddl).schema)
        scan = _score_block(names.tolist(), terms.tolist(), weights, float(corpus["avg_len"]), k, k1, b, schema)
        hits = index.mapInArrow(scan, ddl)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = index.sparkSession.createDataFrame([], ddl)
    return ranked(found, k)


def _no_hits() -> pd.DataFrame:
    return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})


def _floors(best: pd.DataFrame, n: int, k: int) -> np.ndarray:
    """The k-th best score of every query that has k already; below every score for the others."""
    floor = np.full(n, -np.inf)
    if len(best):
        q = best["q"].to_numpy().astype("int64")
        last = np.append(q[1:] != q[:-1], True) & (np.bincount(q, minlength=n)[q] >= k)
        floor[q[last]] = best["score"].to_numpy()[last]
    return floor


def _keep_best(best: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, k: int, positive: bool = False) -> pd.DataFrame:
    """The k best per query of what was kept and a new (queries x chunks) score table, ties by id. Scores
    below a query's k-th are passed over."""
    floor = _floors(best, len(scores), k)
    if scores.shape[1] > k:
        open_ = np.isinf(floor)
        if open_.any():
            floor[open_] = np.partition(scores[open_], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    take = scores >= floor[:, None]
    if positive:
        take &= scores > 0
    return _with(best, scores, ids, take, k)


def _with(best: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, take: np.ndarray, k: int) -> pd.DataFrame:
    q, c = np.nonzero(take)
    return _best(pd.concat([best, pd.DataFrame({"q": q, "id": ids[c], "score": scores[q, c]})]), k) if len(q) else best


def _keep_nearest(best: pd.DataFrame, raw: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The same for cosines, not yet rounded and below zero at times: only those that can reach the k-th
    score are rounded. (Cosines below zero count as zero and tie.)"""
    near = 10.0**-SCORE_DIGITS
    floor = _floors(best, len(raw), k)
    open_ = np.isinf(floor)
    if raw.shape[1] > k and open_.any():
        floor[open_] = np.partition(raw[open_], raw.shape[1] - k, axis=1)[:, raw.shape[1] - k]
    take = raw >= np.where(floor > near, floor - near, -np.inf)[:, None]
    q, c = np.nonzero(take)
    if not len(q):
        return best
    scores = np.round(np.maximum(raw[q, c], 0.0), SCORE_DIGITS)
    return _best(pd.concat([best, pd.DataFrame({"q": q, "id": ids[c], "score": scores})]), k)


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
    return frame[frame.groupby("q").cumcount() < k]


def _scan_block(names: list, matrix: np.ndarray, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scores a partition against one block of queries and keeps k per query: what a task holds
    is queries x k rows, whatever the partition's size."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _no_hits()
        for pdf in batches:
            for start in range(0, len(pdf), 1_000):
                piece = pdf.iloc[start : start + 1_000]
                vectors = np.stack(piece["embedding"].to_numpy()).astype("float64")
                size = np.linalg.norm(vectors, axis=1)
                ids, vectors, size = piece["id"].to_numpy()[size > 0], vectors[size > 0], size[size > 0]
                if not len(ids):
                    continue
                best = _keep_nearest(best, matrix @ (vectors / size[:, None]).T, ids, k)
        if len(best):
            yield pd.DataFrame({"query_id": [names[i] for i in best["q"]], "id": best["id"].to_numpy(), "score": best["score"].to_numpy()})

    return scan


def knn_search(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest chunks by cosine. The chunk vectors are scanned where they lie, never
    shuffled; the query vectors travel in blocks of a checked size, one scan per block, so the
    number of queries is not limited. Chunks or queries without a vector take no part."""
    asked = queries.filter(F.col("query_vector").isNotNull()).select("query_id", "query_vector")
    have = chunks.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    id_type, query_type = dict(have.dtypes)["id"], dict(asked.dtypes)["query_id"]
    schema = f"query_id {query_type}, id {id_type}, score double"
    n_blocks = max(1, math.ceil(asked.count() / (block * 0.8)))
    found = None
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).limit(2 * block + 1).collect()
        if len(rows) > 2 * block:
            raise ValueError("query ids are not unique enough to be cut into blocks")
        vectors = np.array([r["query_vector"] for r in rows], dtype="float64").reshape(len(rows), -1)
        size = np.linalg.norm(vectors, axis=1) if len(rows) else np.zeros(0)
        names = [r["query_id"] for r, s in zip(rows, size) if s > 0]
        if not names:
            continue
        part = have.mapInPandas(_scan_block(names, vectors[size > 0] / size[size > 0][:, None], k), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = have.sparkSession.createDataFrame([], schema)
    return ranked(found, k)


def fuse(*rankings: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: an id scores the sum of 1 / (k + rank) over the lists it is in."""
    both = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", "id", "rank"))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), SCORE_DIGITS + 3).alias("score"))


def filter_hits(hits: DataFrame, start: str | None = None, end: str | None = None, source_type: int | None = None) -> DataFrame:
    """Publish-date bounds, which a hit without a date passes, and an exact source type."""
    t = F.col("publish_time")
    if start is not None:
        hits = hits.filter(t.isNull() | (t >= start))
    if end is not None:
        hits = hits.filter(t.isNull() | (t <= end))
    return hits if source_type is None else hits.filter(F.col("source_type") == source_type)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Second stage: ``scorer(query_text, content)`` gives a raw score; where it is null the
    fused score stands."""
    return pool.withColumn("score", F.coalesce(F.round(logistic(scorer(F.col("query_text"), F.col("content"))), SCORE_DIGITS), F.col("score")))


def search(
    chunks: DataFrame, queries: DataFrame, top_k: int = 10, mode: str = "mix", scorer: Callable[[Column, Column], Column] | None = None,
    start: str | None = None, end: str | None = None, source_type: int | None = None, prefilter: bool = False,
    index: DataFrame | None = None, cjk: bool = False,
) -> DataFrame:
    """Recall max(3k, 30) per query by BM25, vectors or both fused; filter; cut to max(2k, 20);
    rerank; cut to k. A query without a vector gets its BM25 list. The filter comes after the
    recall (so fewer than k hits can remain) unless ``prefilter`` is set. ``index``: the stored
    ``token_index`` of the chunks; ``cjk``: Chinese texts are searched by character pairs."""
    if mode not in ("knn", "bm25", "mix"):
        raise ValueError("mode is knn, bm25 or mix")
    meta = chunks.drop("embedding")
    if prefilter:
        chunks = filter_hits(chunks, start, end, source_type)
        index = None if index is None else index.join(chunks.select("id"), "id", "left_semi")
    pool_k, cut_k = max(3 * top_k, 30), max(2 * top_k, 20)
    words = bm25_search(chunks, queries, pool_k, index=index, cjk=cjk)
    if mode == "bm25" or "query_vector" not in queries.columns:
        merged = words
    else:
        near = knn_search(chunks, queries, pool_k)
        merged = fuse(near, words) if mode == "mix" else near
        if mode == "knn":
            no_vector = queries.filter(F.col("query_vector").isNull()).select("query_id")
            merged = near.unionByName(words.join(no_vector, "query_id", "left_semi"))
        else:
            # without a vector the BM25 list stands with its own scores
            with_vector = queries.filter(F.col("query_vector").isNotNull()).select("query_id")
            fused = merged.join(with_vector, "query_id", "left_semi")
            merged = fused.unionByName(words.join(with_vector, "query_id", "left_anti").select("query_id", "id", "score"))
    hits = merged.select("query_id", "id", "score").join(meta, "id")
    pool = ranked(filter_hits(hits, start, end, source_type), cut_k).drop("rank")
    if scorer is not None:
        pool = rerank(pool.join(queries.select("query_id", "query_text"), "query_id"), scorer)
    return as_results(ranked(pool, top_k))


def as_results(hits: DataFrame) -> DataFrame:
    """Fixed result schema; fields a corpus lacks are null, tags an empty list."""
    have = set(hits.columns)

    def field(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    tags = F.coalesce(F.col("content_tags"), F.array().cast("array<string>")) if "content_tags" in have else F.array().cast("array<string>")
    return hits.select(
        "query_id", "rank", "id", field("content", "string").alias("content"), field("file_id", "string").alias("file_id"),
        field("file_name", "string").alias("file_name"), tags.alias("content_tags"), field("publish_time", "string").alias("publish_time"),
        F.coalesce(field("source_type", "int"), F.lit(1)).alias("source_type"), field("source", "string").alias("source"),
        field("index_time", "string").alias("index_time"), F.round("score", SCORE_DIGITS).alias("score"),
    )


def query_hits(results: DataFrame, expected: DataFrame, name: str = "file_name") -> DataFrame:
    """Per labelled query whether a result's name contains an expected pattern. Results meet
    patterns by query id; a query without results counts as missed."""
    seen = expected.join(results.select("query_id", name), "query_id", "left")
    hit = F.coalesce(F.col(name).contains(F.col("pattern")), F.lit(False))
    return seen.groupBy("query_id").agg(F.max(hit.cast("int")).alias("hit"))


def hit_rate(hits: DataFrame, passing: float = 0.6) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("hit_rate")).withColumn("passed", F.col("hit_rate") >= passing)
