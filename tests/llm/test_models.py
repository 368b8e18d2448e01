"""Toxicity and language model: exact parts against brute force, the rest by held-out results."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import language_model, toxicity
from seriesloom.llm.common import learns
from seriesloom.sources.tables import table

from .helpers import by_id, docs, prose

DATA = "/root/testdata/sf0.01"


def part(i):
    return zlib.crc32(str(i).encode()) % 5


def test_gradients():
    rng = np.random.default_rng(0)
    known = [b"idiot", b"loser", b"the", "loweiä".encode()]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(known)}, 4, np.linspace(0, 1, 5).astype(np.float32), np.array([2**64 - 1], np.uint64), np.zeros(1, np.float32))
    own, grams, fixed = net.inputs(known)
    ids = np.sort(rng.integers(-1, 4, (5, toxicity.WIDTH)), 1)[:, ::-1].copy()
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def loss():
        e = toxicity.embed(net, own, grams, fixed)
        at, there = np.maximum(ids, 0).T, (ids.T >= 0)[:, :, None].astype(np.float32)
        x = toxicity.forward(net, (e @ net["xf"] + net["cf"])[at], (e @ net["xb"] + net["cb"])[at], there)[0].astype(np.float64)
        return float(np.mean(np.logaddexp(0, x) - y * x))

    for name, g in toxicity.gradients(net, own, grams, fixed, ids, y).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        at = net[name][i]
        net[name][i] = at + 1e-2
        up = loss()
        net[name][i] = at - 1e-2
        assert abs((up - loss()) / 2e-2 - g[i]) < 0.02 * abs(g[i]) + 1e-4, name
        net[name][i] = at


def test_windows_reach_the_end_and_overlap():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        s = list(toxicity.starts(n))
        assert s[-1] + toxicity.WIDTH >= n and all(b - a == toxicity.STRIDE for a, b in zip(s, s[1:]))
        assert len(s) == 1 or s[-2] + toxicity.WIDTH < n


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, marks = random.Random(4), [], []
    for i in range(400):
        toxic = int(i % 3 == 0)
        text = prose(rng, rng.randint(5, 120)).split()
        for _ in range(1 + len(text) // 25 if toxic else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["vileword", "nastyone"]) if i % 2 else "grumf" + rng.choice(["a", "ion", "est", "ou", "ing"]))
        rows.append((i, " ".join(text)))
        marks.append((i, toxic))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_held_out_accuracy(spark, labelled):
    df, labels, marks = labelled
    found = by_id(toxicity.scores(df, toxicity.train(df, labels)))
    held = [i for i in marks if part(i) == 0]
    right = sum((found[i]["toxicity"] >= 0.5) == bool(marks[i]) for i in held)
    assert right >= 0.95 * len(held)


def test_toxicity_edges(spark, labelled):
    df, labels, _ = labelled
    model = toxicity.train(df, labels)
    long = prose(random.Random(9), 50_000).split()
    odd = docs(spark, [(1, None), (2, ""), (3, "..."), (None, "vileword nastyone vileword"), (4, " ".join([*long, "vileword", *long])), (4, "plain"), (4, "plain"), (5, "é" * 100_000)])
    found = [(r["doc_id"], r["toxicity"]) for r in toxicity.scores(odd, model).collect()]
    assert all(0 <= s <= 1 for _, s in found) and {s for i, s in found if i in (1, 2, 3)} == {0.0}
    assert toxicity.clean_documents(df.limit(0), labels).columns == df.columns
    assert {r["toxicity"] for r in toxicity.scores(odd, toxicity.train(odd, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert toxicity.scores(odd.limit(0), model).count() == 0


def test_words_of_all_scripts():
    assert toxicity.words("One\u00a0two\u2014three\u3002\u56db\u3001five_six") == [b"one", b"two", b"three", "\u56db".encode(), b"five", b"six"]
    rng = random.Random(12)
    for run in ("\u6c49\u5b57" * 40, "a" * 25, "".join(rng.choice("ab\u00e9\u0435\u6c34\U0001f600") for _ in range(300))):
        raw, pieces = run.encode(), toxicity.words(run)
        assert max(map(len, pieces)) <= toxicity.LETTERS and all(x.decode() for x in pieces) and toxicity.words(" ".join(x.decode() for x in pieces)) == pieces
        half = toxicity.LETTERS // 2
        assert all(any(raw[i : i + half] in x for x in pieces) for i in range(len(raw) - half + 1))


def test_toxic_runs_behind_the_first_bytes(spark, labelled):
    df, labels, _ = labelled
    line = "".join(random.Random(13).choice("\u6c34\u706b\u5c71\u6728") for _ in range(120))
    odd = docs(spark, [(1, line), (2, line[:60] + "vileword" + line[60:]), (3, "a" * 40 + "vileword"), (4, "a" * 40 + "aaaaaaaa")])
    found = {i: r["toxicity"] for i, r in by_id(toxicity.scores(odd, toxicity.train(df, labels))).items()}
    assert found[2] > found[1] and found[3] > found[4]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_toxicity_query_on_whole_tables(spark):
    got = toxicity.op2_toxicity(spark, DATA)
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, DATA, "labels").collect()}
    rows = got.collect()
    assert len(rows) == table(spark, DATA, "documents").count() and all(r["held_out"] == (part(r["doc_id"]) == 0) for r in rows)
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in rows if r["doc_id"] in marks) >= 0.9 * len(marks)


def model_rows(spark, rows):
    df = docs(spark, rows)
    model, counts = language_model.train(df.filter(learns(F.col("doc_id"), 1)))
    return model, [r.asDict() for r in language_model.scores(df, model, counts).collect()]


def check_base(rows, got):
    c = collections.Counter()
    for i, t in rows:
        if i is None or part(i) != 1:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((i, len(tokens), sum(c[x] > 0 for x in tokens), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)))
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    for a, b in zip(sorted(want, key=key), sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * (1 + abs(a[3]))


@pytest.mark.parametrize("head", [1 << 18, 5, 0])
def test_counts_and_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 60)).replace("stone", "STONE\x85") + " \n Zażółć" * (i % 2)) for i in range(120)]
    rows += [(None, "no id here"), (500, None), (501, ""), (502, "the " * 30_000), (3, "again"), (3, "again"), (3, "again")]
    model, got = model_rows(spark, rows)
    check_base(rows, got)


def paths(model):
    """Per leaf its steps, root first."""
    return [list(zip(model.cls[a:b].tolist(), model.digit[a:b].tolist()))[::-1] for a, b in zip(model.start[:-1], model.start[1:])]


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_scores_by_brute_force(spark, monkeypatch, head):
    """Every word's probability in every context adds up to one, and texts score their product."""
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(7)
    rows = [(i, prose(rng, 40)) for i in range(60)]
    model, got = model_rows(spark, rows)
    counts = collections.Counter(w for i, t in rows if part(i) != 1 for w in [*t.encode().lower().split(), b"\n"])
    ways = paths(model)
    assert sorted(map(tuple, ways)) == sorted(set(map(tuple, ways)))
    hashes = {w: int(h) for w, h in zip(counts, language_model.word_hashes(list(counts)))}
    place = {int(h): k for k, h in enumerate(model.h)}
    bits = len(model.buckets).bit_length() - 1
    mask = (1 << 64) - 1

    def prob(word, before):
        h = hashes.get(word, language_model.xxhash.xxh3_64_intdigest(word))
        one, two = (before + [3, 3])[:2]
        mixed = (one, one * 0x9E3779B97F4A7C15 + two * 5, two)
        leaf = place.get(h, len(model.h) + (h >> (64 - bits) if bits else 0))
        p = 1.0 if h in place else (counts[word] + 0.5) / model.buckets[leaf - len(model.h)]
        for cls, digit in ways[leaf]:
            x = model.bias[cls].astype(float)
            for k, m in enumerate(mixed):
                v = ((m + k + 1) * 0xBF58476D1CE4E5B9 + (cls + 1) * 0x165667B19E3779F9) & mask
                x = x + model.weights[((v ^ (v >> 31)) * 0x94D049BB133111EB & mask) >> (64 - model.bits)]
            p *= math.exp(x[digit]) / np.exp(x).sum()
        return p

    context = [hashes[b"\n"], 12, 5]
    unknown = len(model.buckets)  # half a token in each bucket
    one = sum(prob(w, context) for w in counts)
    assert one < 1 and abs(one - 1) < 0.51 * unknown
    if unknown == 1:
        assert abs(one + prob(b"never seen", context) - 1) < 1e-4
    by = {r["doc_id"]: r["score"] for r in got}
    for i, t in rows[:8]:
        before, want = [], 0.0
        for w in [*t.encode().lower().split(), b"\n"]:
            want += math.log10(prob(w, before))
            before = [hashes.get(w, language_model.xxhash.xxh3_64_intdigest(w)), *before]
        assert abs(want - by[i]) < 1e-3 * abs(want)


def test_untrained_scores_are_the_base(spark):
    rng = random.Random(9)
    df = docs(spark, [(i, prose(rng, 30)) for i in range(50)])
    found = language_model.scores(df, *language_model.train(df.filter(learns(F.col("doc_id"), 1)), 0)).collect()
    assert len(found) == 50 and all(abs(r["score"] - r["base_score"]) < 1e-4 * abs(r["base_score"]) for r in found)


def test_tree_has_the_shortest_mean_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 31, 500):
        sizes = rng.permutation(1000)[:n] + 0.5
        start, cls, digit, bias = language_model.class_tree(sizes)
        logp = np.array([bias[cls[a:b], digit[a:b]].sum() for a, b in zip(start[:-1], start[1:])])
        assert np.allclose(np.exp(logp), sizes / sizes.sum(), rtol=1e-4)
        assert n > 16 or np.diff(start).max() == min(1, n - 1)
        assert (np.diff(start)[np.argsort(sizes)][::-1][:-1] <= np.diff(start)[np.argsort(sizes)][::-1][1:]).all()


def test_contexts_help_on_held_out_texts(spark):
    rng = random.Random(8)
    follow = {w: rng.sample("abcdefghijklmnopqrstuvwxyz", 3) for w in "abcdefghijklmnopqrstuvwxyz"}

    def walk():
        out = [rng.choice("abc")]
        for _ in range(40):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    _, got = model_rows(spark, [(i, walk()) for i in range(400)])
    held = [r for r in got if part(r["doc_id"]) == 1]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)  # log10: less negative


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_contexts_prefer_single_words(spark, monkeypatch, head):
    """Of 200 equally frequent words each has its one successor: the class alone cannot tell which."""
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(10)
    names = [f"word{i}" for i in range(200)]
    follow = dict(zip(names, rng.sample(names, 200)))

    def walk():
        out = [rng.choice(names)]
        while len(out) < 60:
            out.append(follow[out[-1]] if rng.random() < 0.9 else rng.choice(names))
        return " ".join(out)

    model, got = model_rows(spark, [(i, walk()) for i in range(400)])
    held = [r for r in got if part(r["doc_id"]) == 1]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_cells_grow_with_the_tokens():
    sizes = [len(language_model.Model(np.array([5, 9], np.uint64), np.array([3, 4]), n, 2).weights) for n in (7, 20_000_000, 10**12)]
    assert sizes == [1 << language_model.LEAST_BITS, 1 << 17, 1 << language_model.MOST_BITS]


def test_rows_are_added_as_one_by_one():
    rng = np.random.default_rng(5)
    for n, cells in ((1, 4), (300, 1), (300, 40), (300, 5000)):
        table, values = rng.random((cells, language_model.WAYS), np.float32), rng.random((n, language_model.WAYS), np.float32)
        at, want = rng.integers(0, cells, n), table.astype(float)
        np.add.at(want, at, values)
        order = np.argsort(at, kind="stable")
        language_model.add_rows(table, at[order], order, values)
        assert np.allclose(table, want, rtol=1e-6)


def test_rows_are_added_in_any_order():
    rng = np.random.default_rng(6)
    for dtype, n, cells in ((np.float32, 300, 40), (np.float64, 300, 1), (np.float32, 0, 3)):
        table, values = language_model.table_of(cells).astype(dtype), rng.random((n, language_model.WAYS)).astype(dtype)
        at, want = rng.integers(0, cells, n), table.astype(float)
        np.add.at(want, at, values)
        language_model.add_rows(table, at, slice(None), values)
        assert np.allclose(table, want, rtol=1e-6)
    assert language_model.table_of(5).ctypes.data % 64 == 0


@pytest.mark.parametrize("trained", [False, True])
def test_sums_of_a_task_are_those_of_its_steps(monkeypatch, trained):
    """Added up in blocks or at once, and before the first update without a look at the weights."""
    monkeypatch.setattr(language_model, "BLOCK", 7)
    monkeypatch.setattr(language_model, "PART", 5)
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 50)) for _ in range(30)] + [None, "", "stone " * 40]
    count = collections.Counter(w for t in texts for w in language_model.words(t or ""))
    head = [w for w, _ in count.most_common(60)]
    model = language_model.Model(language_model.word_hashes(head), np.array([count[w] for w in head]), sum(count.values()), len(count), np.array([9.0, 4.5]))
    if trained:
        model.weights += np.random.default_rng(1).normal(0, 0.3, model.weights.shape).astype(np.float32)
    else:
        monkeypatch.setattr(language_model, "logits", lambda m, cls, cells, at_once=language_model.logits: at_once(m, cls, cells) if not len(cells) else pytest.fail("weights were read"))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["text"]) for x in (texts[:20], texts[20:], [])]
    got = list(language_model.cell_sums(batches, model))
    seen, expected = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    reader = language_model.Reader(model)
    for h, sizes in reader.read([t or "" for t in texts]):
        for _, cls, digit, cells in reader.steps(h, model.at(h), sizes):
            x = model.bias[cls].astype(float) + sum(model.weights[f] for f in cells)
            p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
            for f in cells:
                np.add.at(seen, (f, digit), 1)
                np.add.at(expected, f, p)
    assert sum(len(b) for b in got) == len(model.weights) // language_model.RANGE
    for b in got:
        r, raw = b.column("cell")[0].as_py(), b.column("sums")[0].as_py()
        found = np.frombuffer(raw, np.int32)[: len(raw) // 8], np.frombuffer(raw, np.float32)[len(raw) // 8 :]
        assert (found[0].reshape(-1, language_model.WAYS) == seen[r : r + language_model.RANGE]).all()
        assert np.allclose(found[1].reshape(-1, language_model.WAYS), expected[r : r + language_model.RANGE], rtol=1e-4, atol=1e-6)
    assert list(language_model.cell_sums(batches[2:], model)) == []


def test_words_are_ordered_by_text_and_hash():
    rng = np.random.default_rng(7)
    for n in (0, 1, 400):
        h, text = rng.choice(np.array([0, 5, 2**63, 2**64 - 1], np.uint64), n), np.sort(rng.integers(0, 50, n))
        by, want = language_model.by_text(h, text), np.lexsort((h, text))
        assert sorted(by.tolist()) == list(range(n)) and (h[by] == h[want]).all() and (text[by] == text[want]).all()


def test_words_are_found_in_the_head_without_a_table_of_them():
    h = language_model.word_hashes(f"w{i}".encode() for i in range(500))  # any iterable
    assert h.tolist() == [language_model.xxhash.xxh3_64_intdigest(f"w{i}".encode()) for i in range(500)]
    edges = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    for head in (h[:0], h[:1], h[:300], np.concatenate([h[:300], edges])):
        model = language_model.Model(head, np.arange(len(head)) + 1, 10, len(head))
        place = model.at(np.concatenate([h, edges]))
        known = np.isin(np.concatenate([h, edges]), head)
        assert ((place >= 0) == known).all() and (model.h[place[known]] == np.concatenate([h, edges])[known]).all()


def test_sums_of_cells_meet_in_few_partitions(spark, monkeypatch):
    """By the number of tasks, not one for every range of cells."""
    asked, frame = [], type(spark.range(1))
    before = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: (asked.append(n), before(self, n, *by))[1])
    monkeypatch.setattr(language_model, "LEAST_BITS", 16)
    model, _ = language_model.train(docs(spark, [(i, "some few words") for i in range(20)]), 1)
    assert model.weights.any() and asked == [2 * spark.sparkContext.defaultParallelism]


def test_nothing_to_learn_from(spark):
    held = [i for i in range(40) if part(i) == 1][:3]
    rows = [(i, "some words") for i in held]
    _, got = model_rows(spark, rows)
    check_base(rows, got)
    assert model_rows(spark, [])[1] == []
