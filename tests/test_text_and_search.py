"""Text functions, retrieval, conversations and two-level scans on small frames."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import text as tx
from seriesloom.functions.vectors import cosine, l2_normalise
from seriesloom.operators import conversation as cv
from seriesloom.operators import retrieval as rt
from seriesloom.operators import scan, tables
from seriesloom.sources import corpus


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, size, overlap, want",
    [
        ("", 10, 3, []),
        ("abcdefghijklmnopqrstuvwxyz", 10, 0, ["abcdefghij", "klmnopqrst", "uvwxyz"]),
        ("abcdefghijklmnopqrstuvwxyz", 10, 3, ["abcdefghij", "hijklmnopqrst", "rstuvwxyz"]),
        ("one. two three four", 30, 3, ["one. two three four"]),
        ("aaaa bbbb\n\ncccc dddd", 10, 0, ["aaaa bbbb", "cccc dddd"]),
        ("aaaa\n\nbbbb\n\ncccc dddd", 8, 0, ["aaaabbbb", "ccccdddd"]),
        ("中文句子。第二句话", 5, 0, ["中文句子", "第二句话"]),
    ],
)
def test_chunks(spark, text, size, overlap, want):
    assert one(spark, text, lambda c: tx.chunk_array(c, size, overlap)) == want


def test_tokens(spark):
    assert one(spark, "Iron-ore 45 PORTS, été", tx.tokens) == ["iron", "ore", "45", "ports", "été"]
    assert one(spark, "数据表 lgbm 库", lambda c: tx.tokens(c, True)) == ["数据", "据表", "lgbm", "库"]
    assert one(spark, "", tx.tokens) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1} tail', '{"a": 1}'),
        ('[1, 2] and } more', "[1, 2]"),
        ('{"a": "}]"} x', '{"a": "}]"}'),
        ('{"a": "\\"}"} x', '{"a": "\\"}"}'),
        ('{"a": 1', '{"a": 1'),
        ("  no json ", "no json"),
        ("{a} b", "{a} b"),
    ],
)
def test_json_salvage(spark, text, want):
    assert one(spark, text, tx.salvage_json) == want


def test_hygiene(spark):
    assert one(spark, " a\x07b ", tx.sanitize) == "ab"
    assert one(spark, "x" * 12, lambda c: tx.sanitize(c, 5)) == "xxxxx..."
    assert one(spark, "a\\b\n\tc\x1b\x01", tx.escape_for_log) == "a\\\\b\\n\\tc\\x1b"
    assert one(spark, "y" * 30, lambda c: tx.escape_for_log(c, 10)) == "yyyyyyy..."
    assert one(spark, None, tx.escape_for_log) == "None"


def test_html(spark):
    html = '<html><style>p{}</style><script>var a="</p>";</script><h1>T</h1><p>a &amp; b&lt;c</p><!-- x --><div>  two   blanks</div>\n\n\n\n<ul><li>x</li></ul></html>'
    assert one(spark, html, tx.html_to_text) == "T\na & b<c\n two blanks\n\nx"


def test_token_estimate(spark):
    df = spark.createDataFrame([("user", "abcd efg"), ("assistant", "中文ab"), ("system", ""), ("tool", "x" * 40), ("user", None)], "role string, text string")
    got = [r[0] for r in df.select(cv.message_tokens(F.col("role"), F.col("text"))).collect()]
    # role names human, ai, system and tool add 1, 0, 1 and 1
    assert got == [3, 2, 1, 14, 1]


def test_scans_equal_plain_windows(spark):
    rng = np.random.default_rng(7)
    data = [(k, int(o), None if rng.random() < 0.4 else int(rng.integers(100))) for k in "ab" for o in rng.choice(200, 80, replace=False)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select(
        "k", "o",
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
    )
    two = scan.last_before(scan.running_sums(df, ["k"], "o", {"s": F.col("v")}, width=7), ["k"], "o", F.col("v"), "l", width=7)
    assert rows(two, "k", "o", "s", "l") == rows(plain)


def test_texts_of_a_group_are_one_row(spark):
    df = spark.createDataFrame([("a", i, f"{i:03d}") for i in range(50)] + [("b", 0, "x"), ("c", 3, None), ("a", 99, None)], "k string, o long, t string")
    assert rows(scan.joined_text(df, ["k"], "o", "t", "-", width=4), "k", "text") == [("a", "-".join(f"{i:03d}" for i in range(50))), ("b", "x"), ("c", "")]


def test_global_rank_and_top(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in range(300)], "s string").repartition(7)
    assert rows(scan.global_rank(df, "s", "n"), "s", "n") == [(f"{i:04d}", i) for i in range(300)]
    two = df.withColumn("k", F.lit(1))
    assert scan.top_per_group(two, ["k"], [F.col("s").desc()], 5).agg(F.min("s")).first()[0] == "0295"


def test_large_k_takes_the_salted_way(spark):
    df = spark.range(3000).withColumn("k", F.lit(1))
    got = scan.top_per_group(df, ["k"], [F.col("id").desc()], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 1500


def corpus_frames(spark, n=60, n_queries=9, dim=5):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 15))) for _ in range(n)]
    vectors = rng.normal(size=(n, dim)).round(1)
    chunks = spark.createDataFrame([(f"c{i:02d}", t, v.tolist() if i % 5 else None) for i, (t, v) in enumerate(zip(texts, vectors))], "id string, content string, embedding array<double>")
    asked = [" ".join(rng.choice(words + ["unknown"], 6)) for _ in range(n_queries)]
    qvec = rng.normal(size=(n_queries, dim)).round(1)
    queries = spark.createDataFrame([(i, t, v.tolist() if i % 3 else None) for i, (t, v) in enumerate(zip(asked, qvec))], "query_id long, query_text string, query_vector array<double>")
    return chunks, queries, texts, vectors, asked, qvec


def test_bm25_ways_agree_with_the_formula(spark):
    chunks, queries, texts, _, asked, _ = corpus_frames(spark)
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    want = []
    for q, query in enumerate(asked):
        scored = []
        for i, doc in enumerate(docs):
            total = 0.0
            for term in query.split():
                tf, df = doc.count(term), sum(term in d for d in docs)
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / avg))
            if total:
                scored.append((-round(total, 6), f"c{i:02d}"))
        want += [(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(scored)[:7])]
    by_scan = rows(rt.bm25_search(chunks, queries, 7, block=3), "query_id", "id", "score", "rank")
    by_join = rows(rt.ranked(rt.bm25_scores(chunks, queries), 7), "query_id", "id", "score", "rank")
    assert by_scan == by_join
    assert [r[:2] for r in by_scan] == [w[:2] for w in sorted(want, key=lambda r: tuple((False, str(x)) for x in r))]
    assert [r[2] for r in by_scan] == pytest.approx([w[2] for w in sorted(want, key=lambda r: tuple((False, str(x)) for x in r))], abs=2e-6)


def test_vector_search_in_blocks_is_exact(spark):
    chunks, queries, _, vectors, _, qvec = corpus_frames(spark)
    want = []
    for q, v in enumerate(qvec):
        if q % 3:
            s = sorted((-round(max(0.0, float(v @ x / np.linalg.norm(v) / np.linalg.norm(x))), 6), f"c{i:02d}") for i, x in enumerate(vectors) if i % 5)
            want += [(q, c, -score) for score, c in s[:4]]
    got = rows(rt.knn_search(chunks, queries, 4, block=3), "query_id", "id", "score")
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=lambda r: tuple((False, str(x)) for x in r))]


def test_fusion_uses_ranks_only(spark):
    a = spark.createDataFrame([(1, "x", 1, 5.0), (1, "y", 2, 4.0)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 0.1)], "query_id int, id string, rank int, score double")
    got = dict(rows(rt.fuse(a, b), "id", "score"))
    assert got == {"x": pytest.approx(1 / 61, abs=1e-8), "y": pytest.approx(1 / 62 + 1 / 61, abs=1e-8)}
    assert rows(rt.fuse(a.withColumn("score", F.col("score") * 1000), b)) == rows(rt.fuse(a, b))


def test_filter_lets_missing_dates_pass(spark):
    hits = spark.createDataFrame([("a", "2024-01-05", 1), ("b", None, 1), ("c", "2023-01-01", 1), ("d", "2024-02-01", 2)], "id string, publish_time string, source_type int")
    assert rows(rt.filter_hits(hits, "2024-01-01", "2024-12-31", 1), "id") == [("a",), ("b",)]


def test_search_falls_back_to_words(spark):
    chunks, queries, *_ = corpus_frames(spark)
    got = rt.search(chunks, queries, 5, mode="knn")
    words = rt.bm25_search(chunks, queries, 5)
    no_vector = [0, 3, 6]
    assert rows(got.filter(F.col("query_id").isin(no_vector)), "query_id", "id") == rows(words.filter(F.col("query_id").isin(no_vector)), "query_id", "id")
    # a scorer that fails everywhere leaves the fused order
    plain, failed = rt.search(chunks, queries, 5), rt.search(chunks, queries, 5, scorer=lambda q, c: F.lit(None).cast("double"))
    assert rows(plain, "query_id", "rank", "id") == rows(failed, "query_id", "rank", "id")
    first = got.first()
    assert first.content_tags == [] and first.source_type == 1 and first.file_id is None


def test_hit_rate(spark):
    results = spark.createDataFrame([(1, "report_a"), (1, "notes"), (2, "notes")], "query_id int, file_name string")
    expected = spark.createDataFrame([(1, "report"), (2, "report"), (2, "plan"), (3, "x")], "query_id int, pattern string")
    got = rt.hit_rate(rt.query_hits(results, expected)).first()
    assert got.n_queries == 3 and got.hit_rate == pytest.approx(1 / 3) and not got.passed


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [-3.0, -4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(l2_normalise(F.col("a")), cosine(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[0][1] == 0.0
    assert got[1][0] == [0.0, 0.0] and got[1][1] is None


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "docs" / "b").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("line 1\nline 2")
    (tmp_path / "docs" / "b" / "c.html").write_text("<p>hello</p><script>x</script>")
    (tmp_path / "docs" / "b" / "d.txt").write_text("  \n ")
    (tmp_path / "docs" / "e.csv").write_text("no")
    docs = corpus.scan_corpus(spark, str(tmp_path / "docs"))
    assert rows(docs, "doc_id", "file_name", "source", "content") == [("doc_000", "a.md", "a.md", "line 1\nline 2"), ("doc_001", "c.html", "b/c.html", "hello")]
    assert rows(corpus.build_chunks(docs), "id", "metadata.chunkIndex") == [("doc_000_0000", 0), ("doc_001_0000", 0)]


def trim_slowly(messages, budget, head):
    """Plain restatement: head first, then from the back, cutting where the budget ends."""
    cost = lambda r, t: max(1, int((len(re.sub(r"[^\x00-\x7f]", "", t)) // 4 + len(re.sub(r"[\x00-\x7f]", "", t)) + {"user": 1, "assistant": 0, "system": 1}[r]) * {"user": 1.0, "assistant": 1.2, "system": 1.1}[r]))
    order = list(range(min(head, len(messages)))) + list(range(len(messages) - 1, min(head, len(messages)) - 1, -1))
    out = {}
    for i in order:
        if budget <= 0:
            break
        role, text = messages[i]
        need = cost(role, text)
        out[i] = text if need <= budget else text[:budget]
        if need > budget:
            break
        budget -= need
    return sorted(out.items())


@pytest.mark.parametrize("budget, head", [(5, 1), (40, 0), (40, 2), (1, 3), (10_000, 1), (60, 9)])
def test_trim(spark, budget, head):
    rng = np.random.default_rng(9)
    data = {c: [(str(rng.choice(["user", "assistant", "system"])), "ab中 " * int(rng.integers(0, 12))) for _ in range(8)] for c in (1, 2, 3)}
    df = spark.createDataFrame([(c, i, r, t) for c, ms in data.items() for i, (r, t) in enumerate(ms)], "conv_id long, turn long, role string, text string")
    got = cv.trim_to_budget(df, budget, head)
    want = sorted((c, i, t) for c, ms in data.items() for i, t in trim_slowly(ms, budget, head))
    assert sorted(tuple(r) for r in got.select("conv_id", "turn", "text").collect()) == want


def test_markdown_round_trip(spark):
    text = "intro\n| 日期 | v | v |\n|---|---|---|\n| 2020-01-01 | 1 | 2 | 9 |\n| 2020-01-02 | 3 |\nend\n|a|\n|-|\n|x|"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = rows(tables.markdown_rows(df, "k", "t", {"日期": "data_date"}), "table_no", "row_no", "field", "value")
    assert got == [(0, 0, "data_date", "2020-01-01"), (0, 0, "v", "2"), (0, 1, "data_date", "2020-01-02"), (1, 0, "a", "x")]


def test_column_store_pads_short_columns(spark):
    schema = "k int, columns array<struct<id:int,value:string,indexName:string,unit:string,data:array<string>>>"
    df = spark.createDataFrame([(1, [(2, "b", "", "t", ["9"]), (0, "x", None, None, ["d1", "d2"]), (1, "a", "Name", " ", ["1", "2", "3"])])], schema)
    got = rows(tables.column_store_rows(df, "k"), "row_no", "position", "header", "cell")
    assert got == [(0, 0, "date", "d1"), (0, 1, "Name", "1"), (0, 2, "b (t)", "9"), (1, 0, "date", "d2"), (1, 1, "Name", "2"), (1, 2, "b (t)", "-")]


def test_chinese_search_with_a_stored_index(spark):
    chunks = spark.createDataFrame([("a", "铁矿石价格上涨", None), ("b", "今天下雨", None), ("c", "iron ore 价格", None)], "id string, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, "铁矿石价格"), (2, "ore")], "query_id int, query_text string")
    index = rt.token_index(chunks, cjk=True)
    found = rt.search(chunks, queries, 3, mode="bm25", index=index, cjk=True)
    assert rows(found, "query_id", "rank", "id") == [(1, 1, "a"), (1, 2, "c"), (2, 1, "c")]


def test_character_references_and_blanks(spark):
    df = spark.createDataFrame([("<p>It&rsquo;s &#8217;&#x27;&euro;&times; a &lt;b&gt;</p>　 ",), (None,)], "h string")
    assert [r[0] for r in df.select(tx.html_to_text(F.col("h"))).collect()] == ["It’s ’'€× a <b>", None]


def test_corpus_folder_with_odd_names(spark, tmp_path):
    for name, text in (("a b/corpus/z.md", "one"), ("x y+1.TXT", "two"), ("p.HTML", "<p>three &amp; four</p>"), ("skip.csv", "no")):
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = rows(corpus.scan_corpus(spark, str(tmp_path / "corpus")), "doc_id", "file_name", "source", "content")
    assert got == [("doc_000", "z.md", "a b/corpus/z.md", "one"), ("doc_001", "p.HTML", "p.HTML", "three & four"), ("doc_002", "x y+1.TXT", "x y+1.TXT", "two")]


def test_scores_below_the_kth_are_not_ranked_again(monkeypatch):
    """What cannot reach a query's k-th score is passed over; ties below zero and equal scores still go by id."""
    rng, k = np.random.default_rng(4), 3
    raw = np.round(rng.uniform(-1, 1, (5, 400)), 2)
    raw[3] = -np.abs(raw[3])
    ids = rng.permutation(400)
    seen, whole = [], rt._best
    monkeypatch.setattr(rt, "_best", lambda frame, n: (seen.append(len(frame)), whole(frame, n))[1])
    best = rt._no_hits()
    for at in range(0, 400, 20):
        best = rt._keep_nearest(best, raw[:3, at : at + 20], ids[at : at + 20], k)
    assert sum(seen) < 3 * 400 / 2
    best = rt._no_hits()
    for at in range(0, 400, 20):
        best = rt._keep_nearest(best, raw[:, at : at + 20], ids[at : at + 20], k)
    for q in range(5):
        want = sorted((-max(s, 0.0), int(i)) for s, i in zip(raw[q], ids))[:k]
        mine = best[best["q"] == q]
        assert [(-s, int(i)) for s, i in zip(mine["score"], mine["id"])] == want


def test_word_scores_follow_the_terms_of_the_chunks(spark, monkeypatch):
    """A task's score table has a column per chunk that has asked terms, none for the others."""
    terms, names, weights = ["a", "b", "c"], [7, 9], np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 0.0]])
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("score", pa.float64())])
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "z", "w"]), pa.array([["a", "a", "c"], ["q"], ["b"], []], pa.list_(pa.string()))], ["id", "t"])
    wide, kept = [], rt._keep_best
    monkeypatch.setattr(rt, "_keep_best", lambda best, scores, *a, **kw: (wide.append(scores.shape[1]), kept(best, scores, *a, **kw))[1])
    monkeypatch.setattr(rt, "SCORE_CELLS", 2)
    out = [r for b in rt._score_block(names, terms, weights, 2.0, 5, rt.K1, rt.B, schema)(iter([batch])) for r in b.to_pylist()]

    def part(w, tf, dl):
        return w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2.0))

    assert [(r["query_id"], r["id"], r["score"]) for r in out] == [(7, "x", round(part(1, 2, 3) + part(2, 1, 3), 6)), (9, "z", round(part(3, 1, 1), 6))]
    assert sum(wide) == 2


def test_corpus_files_are_opened_once(spark, tmp_path):
    """Numbering and contents come from one pass over the files: nothing reads them again."""
    (tmp_path / "docs").mkdir()
    for name in ("b.md", "a.txt"):
        (tmp_path / "docs" / name).write_text(name * 2)
    docs = corpus.scan_corpus(spark, str(tmp_path / "docs"))
    for name in ("b.md", "a.txt"):
        (tmp_path / "docs" / name).unlink()
    assert rows(docs, "doc_id", "content") == [("doc_000", "a.txta.txt"), ("doc_001", "b.mdb.md")]


def test_postings_are_counted_where_the_chunk_is(spark):
    """Chunks move, dealt by their id, and no row per term and chunk; an id that comes twice is one chunk."""
    chunks = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("a", "x y x"), (None, "z"), ("c", None)], "id string, content string")
    postings = rt.term_postings(chunks)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#", plan) == ["id"]
    assert rows(postings, "term", "id", "tf", "dl") == [("x", "a", 4, 3), ("y", "a", 2, 3), ("y", "b", 1, 1), ("z", None, 1, 1)]


def test_chunks_of_long_texts(spark):
    """Packing keeps every character but blanks, whatever a text's length; null has no chunks."""
    text = "　 ".join(f"w{i} {'y' * (i % 700)}\x85!" for i in range(400))
    pieces = tx.split_pieces(text, 50)
    assert max(map(len, pieces)) <= 50 and all(p == re.sub(r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "", p) != "" for p in pieces)
    assert "".join(tx.pack_pieces(pieces, 50, 0)) == "".join(pieces) and "".join(pieces).count("y") == text.count("y")
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "i int, t string")
    assert [r[0] for r in df.select(tx.chunk_array(F.col("t"), 50, 7)).collect()] == [tx.pack_pieces(pieces, 50, 7), None, []]
