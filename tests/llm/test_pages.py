"""Main text and archives of pages."""

import base64
import hashlib
import time

import pytest
import zstandard

from seriesloom.llm import page_text, warc
from seriesloom.session import scratch_path

SCHEMA = "page_id long, url string, html string, text string, bytes long"
HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
NAV = '<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy this.</div>'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text", "just text"),
        (HEAD + NAV + "<article><h1>Title</h1><p><b>One two.<br><p>Three\n four.</p><p>Yes.</p></article><footer>&copy; x</footer></body></html>", "Title\n\nOne two.\n\nThree four.\n\nYes."),
        (HEAD + NAV + "<article><h1>Cut &am</h1><p>Fish &amp chips &lt;b&gt; &#8217;&#x27;&euro; 1 < 2</p></article>", "Cut &am\n\nFish & chips <b> ’'€ 1 < 2"),
        ("<body><div id=main><p>First long paragraph of the story.</p><p>No.</p></div><div class='comments'><p>first!</p></div><aside>see also</aside></body>", "First long paragraph of the story.\n\nNo."),
        ("<body><div><div><p>One part of a story with words.</p></div><div><p>Another part of it with words.</p></div></div><form><p>Mail?</p></form></body>", "One part of a story with words.\n\nAnother part of it with words."),
        ("<article><p>The story has a few words here.</p><div class='cookie-notice'>We use cookies</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><p>after", "The story has a few words here.\n\na\n\nb\n\nc\n\nd"),
        ("<p>Read <a href='x>y'>this link</a> and\tthat one</p>", "Read this link and that one"),
        ("<!-- never closed", ""),
        ("<p>x</p><script>never closed <p>y", "x"),
    ],
)
def test_main_text(page, text):
    assert page_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav>m</nav><div class='content has-sidebar'><p>The story.</p><p>More of it here.</p></div><div class='sidebar'>side</div>", "The story.\n\nMore of it here."),
        ("<div class='post no-comments'><p>The story.</p></div>", "The story."),
        ("<div id='comments-enabled'><p>The story.</p></div>", "The story."),
        ("<div title='a hidden gem' data-x='class=ad'><p>The story.</p></div>", "The story."),
        ("<form action=x><div><p>The story is here.</p><p>Two.</p></div></form>", "The story is here.\n\nTwo."),
        ("<form><p>Mail?</p></form><p>The story is long enough.</p>", "The story is long enough."),
        ("<article><p>First story of words.</p></article><article><p>Second story with words.</p></article><footer>f</footer>", "First story of words.\n\nSecond story with words."),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>The story.</p></article>", "Head\n\nThe story."),
        ("<aside><article><header><h1>No</h1></header><p>x</p></article></aside><p>Yes it is a text.</p>", "Yes it is a text."),
        ("<p>Short.</p><div class='cookie-notice'>We use cookies and so on and on.</div><div id='comments-area'>a long, long, long comment</div>", "Short."),
        ("<main><p>Short.</p></main><div class='my-comments-x'>a long, long, long comment of a reader</div>", "Short."),
        ("<html><head><title>T</title><body><p>No end of head.</p>", "No end of head."),
        ("<p>Text with <span class='share-count'>12</span>and <a class='by-ads-x' href=x>a link</a> in it, more words.</p>", "Text with and in it, more words."),
        ("<div class=header><h1>All</h1><p>Everything inside.</p></div>", "All\n\nEverything inside."),
    ],
)
def test_marks_and_wrappers(page, text):
    assert page_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<a b='c " * 125_000, "<p>x</p>" + "<a b='c " * 125_000 + ">", "<a b=\"c ' " * 100_000 + ">", "<a " * 300_000 + "\"'" * 9, "<script>" + "</script " * 110_000, "<" * 1_000_000, "<a" * 500_000, "<! " * 300_000])
def test_hostile_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    page_text.main_text(page)
    assert time.perf_counter() - start < 5


def test_deep_and_long_pages():
    assert page_text.main_text("<div>" * 30_000 + "x") == "x"
    assert page_text.main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert page_text.main_text("<b>" * 30_000 + "y" + "</i>" * 30_000) == "y"


def test_page_rows(spark):
    rows = [(1, "u", "<p>a b"), (None, None, None), (1, "u", "<p>a b"), (2, "v", "")]
    df = pages(spark, rows)
    got = sorted((tuple(r) for r in page_text.main_texts(df).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (None, None, "", 0), (1, "u", "a b", 3), (2, "v", "", 0)], key=str)
    assert page_text.main_texts(df.limit(0)).count() == 0


def archive(spark, rows, **options):
    folder = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages(spark, rows), folder, **options)
    return folder, manifest


def test_round_trip(spark):
    long = "<p>" + "é" * 300_000
    rows = [(5, "http://a", "same"), (3, None, "same"), (9, "http://b\n c", "same"), (1, "u", None), (2, "u", ""), (7, "x", long), (None, "n", "same"), (8, "o", "other"), (3, None, "same")]
    folder, manifest = archive(spark, rows, bundle_bytes=200)
    got = sorted((r.asDict() for r in warc.read_records(manifest, folder).collect()), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [
        (None, "revisit", 3), (1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "response", None), (5, "revisit", 3), (7, "response", None), (8, "response", None), (9, "revisit", 3),
    ]
    payload = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        raw = payload[r["page_id"]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["payload"] == (None if r["record_type"] == "revisit" else raw)
    assert got[-1]["url"] == "http://b c"


def test_bundles_are_plain_streams_with_a_seek_table(spark):
    folder, manifest = archive(spark, [(i, f"u{i}", f"page {i}") for i in range(20)], bundle_bytes=1 << 20)
    frames = {(r["bundle"], r["frame_at"]): (r["frame_bytes"], r["plain_bytes"]) for r in manifest.collect()}
    for bundle in {b for b, _ in frames}:
        raw = open(f"{folder}/{bundle}", "rb").read()
        table = warc.read_seek_table(raw)
        assert {(bundle, at): (packed, plain) for at, packed, plain in table} == {k: v for k, v in frames.items() if k[0] == bundle}
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len(table) and len(whole) == sum(p for *_, p in table)


def test_least_size_and_no_rows(spark):
    folder, manifest = archive(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], least=3)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_records(manifest, folder).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder, manifest = archive(spark, [])
    assert warc.read_records(manifest, folder).count() == 0
