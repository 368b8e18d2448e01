"""Chunks, BM25, vectors, fusion and search over ``documents``, ``embeddings`` and ``pages``.

The queries are all texts of ``benchmark``; a query has a vector where ``embeddings`` has one for
its id and ``labels`` knows the id, so some fall back to BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine, l2_normalise
from ..operators import retrieval as rt
from ..operators.scan import top_per_group
from ..session import scratch_path, spread, written
from ..sources import corpus
from ..sources.tables import table
from .base import rounded


def page_texts(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


def corpus_scan(spark, sf):
    """Pages written one file each, read back as a folder of documents."""
    path = scratch_path(spark, "corpus")
    table(spark, sf, "pages").select("page_id", F.col("html").alias("value")).write.partitionBy("page_id").text(path)
    docs = corpus.scan_corpus(spark, path)
    return docs.select("doc_id", F.split_part("source", F.lit("/"), F.lit(1)).alias("folder"), F.length("content").alias("n_chars"), F.md5("content").alias("md5"))


def _docs(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.concat(F.lit("file_"), "source", F.lit("_"), "lang").alias("file_name"), "source", F.col("text").alias("content"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def chunk_table(spark, sf):
    """All documents cut, with metadata; vectors only marked here."""
    chunks = corpus.build_chunks(_docs(spark, sf), _vectors(spark, sf))
    return chunks.select("id", "content", F.col("metadata.fileName").alias("file_name"), F.col("metadata.chunkIndex").alias("chunk_index"), F.col("embedding").isNotNull().alias("has_vector"))


def chunk_index_rebuild(spark, sf):
    """The chunk table dropped and written anew, counts taken from the written files."""
    index = corpus.rebuild_index(corpus.build_chunks(_docs(spark, sf)), scratch_path(spark, "chunks"))
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


def token_counts(spark, sf):
    """Words per language."""
    words = table(spark, sf, "documents").select("lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))


def term_index(spark, sf):
    """Document frequency, occurrences and longest chunk per term."""
    postings = rt.term_postings(_chunks(spark, sf))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max("dl").alias("max_len"))


def corpus_size(spark, sf):
    return rounded(rt.corpus_size(_chunks(spark, sf)), 6)


def _chunks(spark, sf):
    """Chunks with their metadata flat and, by language, a publish date and a source type."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    chunks = corpus.build_chunks(_docs(spark, sf), _vectors(spark, sf)).join(d, "doc_id")
    date = F.when(F.col("lang") != "en", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int")).cast("string"))
    return chunks.select("id", "content", "embedding", F.col("metadata.fileName").alias("file_name"), F.col("metadata.source").alias("source"), date.alias("publish_time"), F.when(F.col("lang") == "de", 2).otherwise(1).alias("source_type"))


def _queries(spark, sf):
    v = table(spark, sf, "embeddings").join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    v = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(v, "query_id", "left")


def bm25_top(spark, sf):
    return rt.bm25_search(_chunks(spark, sf), _queries(spark, sf), 10)


def vector_norms(spark, sf):
    """Unit vectors, shown by their first and last entries and their length."""
    u = table(spark, sf, "embeddings").select("vec_id", l2_normalise(F.col("embedding")).alias("u"))
    return rounded(u.select("vec_id", F.get("u", 0).alias("first"), F.get("u", 63).alias("last"), F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("size")), 6)


def pair_similarity(spark, sf):
    """Similarity of each vector to the one with the next id."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rounded(e.join(following, "vec_id").select("vec_id", cosine(F.col("embedding"), F.col("next")).alias("similarity")), 6)


def nearest_vectors(spark, sf):
    """Exact nearest five for every vector of the table."""
    e = table(spark, sf, "embeddings")
    return rt.knn_search(e.select(F.col("vec_id").alias("id"), "embedding"), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5)


def nearest_chunks(spark, sf):
    return rt.knn_search(_chunks(spark, sf), _queries(spark, sf), 10)


def fused_ranks(spark, sf):
    chunks, asked = written(_chunks(spark, sf), "chunk-rows"), _queries(spark, sf)
    return rt.fuse(rt.knn_search(chunks, asked, 30), rt.bm25_search(chunks, asked, 30))


def overlap_score(query, content):
    """A simple second-stage scorer: distinct words in common, in tens."""
    return F.size(F.array_intersect(tx.tokens(query), tx.tokens(content))) / 10


def _search(spark, sf, **kw):
    return rt.search(written(_chunks(spark, sf), "chunk-rows"), _queries(spark, sf), 10, **kw)


def _shown(hits):
    return hits.select("query_id", "rank", "id", "file_name", F.size("content_tags").alias("n_tags"), "publish_time", "source_type", "source", "score")


def search_mixed(spark, sf):
    """Both recalls fused, reranked; results in the fixed schema."""
    return _shown(_search(spark, sf, scorer=overlap_score))


def search_vectors_filtered(spark, sf):
    """Vector recall with BM25 fallback, date bounds and source type applied after the recall."""
    return _shown(_search(spark, sf, mode="knn", start="2021-01-01", end="2035-12-31", source_type=1))


def search_words_prefiltered(spark, sf):
    return _shown(_search(spark, sf, mode="bm25", source_type=2, prefilter=True))


def _expected(spark, sf):
    """A query is answered by any file of the source its own document came from."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.concat("source", F.lit("_")).alias("pattern"))
    return b.join(d, "query_id")


def hits_per_query(spark, sf):
    return rt.query_hits(_search(spark, sf, mode="bm25"), _expected(spark, sf))


def hit_rate(spark, sf):
    return rounded(rt.hit_rate(rt.query_hits(_search(spark, sf, mode="bm25"), _expected(spark, sf))), 6)


def candidate_pools(spark, sf):
    """Pools narrowing from 30 to 20 to 10 per query, on vector scores."""
    e = table(spark, sf, "labels").select(F.col("quality").alias("query_id"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    wide = top_per_group(e, ["query_id"], order, max(3 * 10, 30), "wide")
    middle = top_per_group(wide, ["query_id"], order, max(2 * 10, 20), "middle")
    return top_per_group(middle, ["query_id"], order, 10, "narrow")


def _html_sql() -> str:
    t = "html"
    for tag in ("script", "style"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)', '', 'g')"
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    names = "p|div|br|li|tr|h1|h2|h3|h4"
    t = rf"regexp_replace({t}, '(?i)</({names})\s*>|<({names})\b[^>]*/>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?s)<[!/a-zA-Z][^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", "chr(160)"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&quot;?", "'\"'"), ("&#39;", "chr(39)"), ("&copy;?", "chr(169)"), ("&middot;?", "chr(183)"), ("&amp;?", "'&'")):
        t = f"regexp_replace({t}, '{entity}', {char}, 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({t}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def _chunk_sql() -> str:
    p = "[text]"
    for mark in ("\n\n", "\n", "。", "!", "?", ";", ",", "，", " "):
        m = {"\n\n": "chr(10) || chr(10)", "\n": "chr(10)"}.get(mark, f"'{mark}'")
        p = f"flatten(list_transform({p}, lambda x: CASE WHEN length(x) <= 500 THEN [x] ELSE string_split(x, {m}) END))"
    p = f"flatten(list_transform({p}, lambda x: CASE WHEN length(x) <= 500 THEN [x] ELSE list_transform(range(0, (length(x) + 499) // 500), lambda i: substr(x, i * 500 + 1, 500)) END))"
    p = rf"list_filter(list_transform({p}, lambda x: regexp_replace(x, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"
    return f"""pcs AS (SELECT doc_id, source, lang, n_chars, {p} AS p FROM documents),
folded AS (SELECT doc_id, source, lang, n_chars, list_reduce(p, lambda a, x: CASE WHEN a.cur = '' OR length(a.cur) + length(x) <= 500 THEN {{'done': a.done, 'cur': a.cur || x}} ELSE {{'done': list_append(a.done, a.cur), 'cur': right(a.cur, 50) || x}} END, {{'done': []::VARCHAR[], 'cur': ''}}) AS f FROM pcs),
whole AS (SELECT doc_id, source, lang, n_chars, CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS c FROM folded),
raw_chunks AS (SELECT doc_id, source, lang, n_chars, unnest(c) AS content, unnest(range(len(c))) AS i FROM whole),
chunks AS (SELECT printf('%d_%04d', doc_id, i) AS id, r.doc_id, content, 'file_' || source || '_' || lang AS file_name, source, CAST(i AS INTEGER) AS chunk_index, e.embedding,
  CASE WHEN lang <> 'en' THEN CAST(DATE '2020-01-01' + CAST(n_chars AS INTEGER) AS VARCHAR) END AS publish_time, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS source_type FROM raw_chunks r LEFT JOIN embeddings e ON e.vec_id = r.doc_id)"""


def _bm25_sql(where: str = "true", k: int = 30) -> str:
    return f"""tok AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks WHERE {where}),
cs AS (SELECT count(*) AS n_chunks, avg(len(t)) AS avg_len FROM tok), post AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY 1, 2),
bs AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score FROM qt JOIN dfs USING (term) JOIN post USING (term), cs GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= {k})"""


_QV = "qv AS (SELECT item_id AS query_id, b.text AS query_text, e.embedding AS v FROM benchmark b LEFT JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) e ON e.vec_id = b.item_id)"


def _knn_sql(k: int = 30) -> str:
    return f"""{_QV}, ks AS (SELECT query_id, id, round(greatest(0, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM qv, chunks WHERE v IS NOT NULL AND embedding IS NOT NULL),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ks) WHERE rank <= {k})"""


_FUSE = "fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM kn UNION ALL SELECT query_id, id, rank FROM bm) GROUP BY 1, 2)"
_SHOW = "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, file_name, 0 AS n_tags, publish_time, source_type, source, round(score, 6) AS score FROM res WHERE rank <= 10"


def _ranked_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source})"


_WORDS_HITS = "WITH " + _chunk_sql() + ", " + _bm25_sql() + """, ex AS (SELECT item_id AS query_id, source || '_' AS pattern FROM benchmark JOIN documents ON doc_id = item_id),
hits AS (SELECT ex.query_id, CAST(max(coalesce(contains(c.file_name, pattern), false)::INTEGER) AS INTEGER) AS hit FROM ex LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) b ON b.query_id = ex.query_id LEFT JOIN chunks c ON c.id = b.id GROUP BY 1)
"""

QUERIES = {
    "page_texts": page_texts,
    "corpus_scan": corpus_scan,
    "chunk_table": chunk_table,
    "chunk_index_rebuild": chunk_index_rebuild,
    "token_counts": token_counts,
    "term_index": term_index,
    "corpus_size": corpus_size,
    "bm25_top": bm25_top,
    "vector_norms": vector_norms,
    "pair_similarity": pair_similarity,
    "nearest_vectors": nearest_vectors,
    "nearest_chunks": nearest_chunks,
    "fused_ranks": fused_ranks,
    "search_mixed": search_mixed,
    "search_vectors_filtered": search_vectors_filtered,
    "search_words_prefiltered": search_words_prefiltered,
    "hits_per_query": hits_per_query,
    "hit_rate": hit_rate,
    "candidate_pools": candidate_pools,
}
_C = "WITH " + _chunk_sql()
ORACLES = {
    "page_texts": f"SELECT page_id, {_html_sql()} AS text FROM pages",
    "corpus_scan": """SELECT printf('doc_%03d', row_number() OVER (ORDER BY 'page_id=' || page_id || '/') - 1) AS doc_id, 'page_id=' || page_id AS folder, CAST(length(html) + 1 AS INTEGER) AS n_chars, md5(html || chr(10)) AS md5 FROM pages""",
    "chunk_table": _C + " SELECT id, content, file_name, chunk_index, embedding IS NOT NULL AS has_vector FROM chunks",
    "chunk_index_rebuild": _C + " SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunks GROUP BY 1",
    "token_counts": r"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2",
    "term_index": _C + ", " + _bm25_sql() + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(max(dl) AS INTEGER) AS max_len FROM post GROUP BY 1",
    "corpus_size": _C + ", " + _bm25_sql() + " SELECT n_chunks, round(avg_len, 6) AS avg_len FROM cs",
    "bm25_top": _C + ", " + _bm25_sql(k=10) + " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bm",
    "vector_norms": """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS size FROM u""",
    "pair_similarity": """SELECT a.vec_id, round(greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "nearest_vectors": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "nearest_chunks": _C + ", " + _knn_sql(10) + " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM kn",
    "fused_ranks": _C + ", " + _bm25_sql() + ", " + _knn_sql() + ", " + _FUSE + " SELECT * FROM fu",
    "search_mixed": _C + ", " + _bm25_sql() + ", " + _knn_sql() + ", " + _FUSE + """, mg AS (SELECT fu.* FROM fu WHERE query_id IN (SELECT query_id FROM qv WHERE v IS NOT NULL) UNION ALL SELECT query_id, id, score FROM bm WHERE query_id IN (SELECT query_id FROM qv WHERE v IS NULL)),
""" + _ranked_sql("mg", "po") + r""", re AS (SELECT po.query_id, c.id, file_name, publish_time, source_type, source, round(1.0 / (1.0 + exp(-(len(list_distinct(list_intersect(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+'), regexp_extract_all(lower(content), '[\p{L}\p{N}]+')))) / 10.0::DOUBLE))), 6) AS score
  FROM po JOIN chunks c USING (id) JOIN qv USING (query_id) WHERE rank <= 20), """ + _ranked_sql("re", "res") + " " + _SHOW,
    "search_vectors_filtered": _C + ", " + _bm25_sql() + ", " + _knn_sql() + """, mg AS (SELECT query_id, id, score FROM kn UNION ALL SELECT query_id, id, score FROM bm WHERE query_id IN (SELECT query_id FROM qv WHERE v IS NULL)),
fl AS (SELECT mg.query_id, c.id, mg.score, file_name, publish_time, source_type, source FROM mg JOIN chunks c USING (id) WHERE source_type = 1 AND (publish_time IS NULL OR publish_time BETWEEN '2021-01-01' AND '2035-12-31')), """ + _ranked_sql("fl", "res") + " " + _SHOW,
    "search_words_prefiltered": _C + ", " + _bm25_sql("source_type = 2") + ", fl AS (SELECT bm.query_id, c.id, bm.score, file_name, publish_time, source_type, source FROM bm JOIN chunks c USING (id)), " + _ranked_sql("fl", "res") + " " + _SHOW,
    "hits_per_query": _WORDS_HITS + "SELECT * FROM hits",
    "hit_rate": _WORDS_HITS + "SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, avg(hit) >= 0.6 AS passed FROM hits",
    "candidate_pools": """WITH r AS (SELECT quality AS query_id, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY quality ORDER BY n_chars DESC, doc_id) AS INTEGER) AS r FROM labels JOIN documents USING (doc_id))
SELECT doc_id, query_id, n_chars, r AS wide, r AS middle, r AS narrow FROM r WHERE r <= 10""",
}
