"""Prefix counts and chunk encoding against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seriesloom.llm import pieces, token_counts

from .helpers import by_id, docs

PATH = public_tokenizers.path(token_counts.VOCABULARY)
MODEL = public_tokenizers.path(pieces.MODEL)
LETTERS = [*"abcdehilnorst'   \n\t.,!0123éñß中文😀 　▁\x00́aa==--\x1c\x85 ²Ⅷ", "<|endoftext|>", "'ll", "'re", "  ", "\n\n", "\r\n", "the", " and", "</s>"]
TEXTS = [None, "", " ", "\n", "a", "▁", "x" * 70_000, "word " * 20_000, "<|endoftext|>" * 3, " <|endoftext|> a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_totals_are_the_library_counts(library):
    counter = token_counts.PrefixCounter(PATH, kept=500)
    texts = [t or "" for t in TEXTS] + random_texts(3000, 1)
    assert list(counter.totals(texts)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_prefix(library):
    counter = token_counts.PrefixCounter(PATH)
    for text in [*random_texts(400, 2, 25), "it's we'll they've 'l 've", " a<|endoftext|>  b"]:
        assert counter.prefixes(text) == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_character_classes_agree(library):
    """The splitting pattern and its form for ASCII texts, on every character of some ranges."""
    counter = token_counts.PrefixCounter(PATH)
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in [*range(1, 0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3100)]]
    assert list(counter.totals(texts)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_and_prefix_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "\n"), (3, "\n")]
    df = docs(spark, rows)
    found = token_counts.count_tokens(df, PATH)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    table = token_counts.prefix_table(df.filter("doc_id in (4, 7)"), PATH, part=1_000)
    long = sorted((r["first"], r["counts"]) for r in table.collect() if r["doc_id"] == 7)
    counts = [c for _, part in long for c in part]
    assert len(counts) == len(TEXTS[7]) and counts[-1] == len(library.encode(TEXTS[7], add_special_tokens=False).ids)
    cut = by_id(token_counts.longest_within(table, 100))
    assert cut[7]["n_chars"] == max(k + 1 for k, c in enumerate(counts) if c <= 100) and cut[4]["n_chars"] == 1
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_pieces_are_the_library_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(TEXTS + random_texts(1500, 3))) + [(None, "no id"), (5, "again"), (5, "again")]
    ids = {t: model.encode(t or "", add_eos=True) for _, t in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    df = docs(spark, rows)
    found = sorted((tuple(r) for r in pieces.encode_digests(df, MODEL).collect()), key=str)
    assert found == sorted(((i, len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(model.decode(ids[t]))) for i, t in rows), key=str)
    for r in pieces.encode(df.filter("doc_id > 100"), MODEL).collect():
        text = dict(rows[:-3])[r["doc_id"]]
        assert r["ids"] == ids[text] and r["decoded"] == model.decode(ids[text])
    assert pieces.encode_digests(df.limit(0), MODEL).count() == 0


def test_a_small_table_starts_anew():
    table = pieces.Chunks(MODEL, kept=5)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = random_texts(200, 4)
    assert [i for i, _ in table.encode(texts)] == model.encode(texts, add_eos=True)
