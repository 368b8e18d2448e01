"""Removal of repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import suffix_dedup as sd

from .helpers import by_id, docs, prose


def brute(texts, length):
    """Per text: covered bytes."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((len(r), [tuple(map(int, p)) for p in edges.reshape(-1, 2)], bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def check(spark, rows, length):
    got = sd.without_repeats(docs(spark, rows), length).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], length))]
    mine = [(r["doc_id"], r["n_bytes"], [(s["first"], s["last"]) for s in r["spans"]], bytes(r["kept"])) for r in got]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    assert sorted(mine, key=key) == sorted(want, key=key)
    return want


def collection(seed, n=90, length=200):
    """Texts with shared passages of about ``length`` bytes at any place, copies, near copies and runs."""
    rng = random.Random(seed)
    passages = [prose(rng, 60)[: length + rng.choice([-1, 0, 1, 9, 60])] for _ in range(8)] + ["ab" * length, "é" * length]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 20))]
        if i % 9 == 0:
            parts.append("a" * rng.randint(1, 3 * length))
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    near = rows[3][1] + prose(rng, 80)
    rows += [(1000 + k, near[:k] + "#" + near[k:]) for k in range(0, 400, 57)]
    return rows


@pytest.mark.parametrize("length", [200, 24])
def test_against_brute_force(spark, length):
    want = check(spark, collection(length, length=length), length)
    assert sum(len(x[2]) for x in want) > 20


def test_edges(spark):
    rng = random.Random(1)
    long = prose(rng, 60)
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, long), (None, "x" * 250), (None, None), (4, long[:199]), (5, long[:200]), (6, "x" * 201), (7, "y" * 199), (8, "z" * 200), (1, "another text of the same id " * 9)]
    check(spark, rows, 200)
    assert sd.without_repeats(docs(spark, rows).limit(0)).count() == 0
    check(spark, [(1, "z" * 201)], 200)  # a string that overlaps itself
    check(spark, [(1, prose(rng, 100)), (2, prose(rng, 100))], 200)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(2)
    long = prose(rng, 4000)
    monkeypatch.setattr(sd, "SLICE", 700)
    pieces = [(("r", 1), a, p) for a, p in _cut(long.encode(), 700, 50)]
    strings = [(s, n) for piece in pieces for _, _, s, n, _, _ in sd.Seeds(50).windows([piece])]
    assert sum(n for _, n in strings) == len(long) - 49


def _cut(raw, size, length):
    return [(a, raw[a : a + size + length - 1]) for a in range(0, len(raw) - length + 1, size)]


def groups(rng, length, n_groups, members):
    """Windows of aligned groups with many common strings."""
    gram = sd.gram_size(length)
    out = []
    for g in range(n_groups):
        base = bytes(rng.choice(b"ab") for _ in range(2 * length))
        for m in range(rng.randint(2, members)):
            text = bytearray(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(b"abc")
            low = rng.randint(gram - length, 0)
            strings = rng.randint(1, 1 - low)
            reach = length - gram
            out.append((g, low, strings, bytes(text[reach + low : reach + low + strings - 1 + length])))
    return out


def found_by_sort(rows, length, held, block, folder):
    spool = sd.Spool(str(folder), held)
    shard = sd.Shard(length, spool)
    for a in range(0, len(rows), 7):
        part = rows[a : a + 7]
        shard.add(*(np.array([r[i] for r in part]) for i in range(3)), [r[3] for r in part])
    got = set()
    for window, first, last in shard.repeated():
        got |= {(int(w), x) for w, a, b in zip(window, first, last) for x in range(a, b + 1)}
    spool.close()
    return got, spool.stored


@pytest.mark.parametrize("held,block", [(1 << 27, 1 << 17), (2000, 16), (0, 5), (0, 64)])
def test_queues_on_disk_sort_as_queues_in_memory(monkeypatch, tmp_path, held, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    length = 12
    for seed in range(3):
        rows = groups(random.Random(seed), length, 9, 30)
        strings = Counter((g, x, c[x - low : x - low + length]) for g, low, n, c in rows for x in range(low, low + n))
        want = {(i, x) for i, (g, low, n, c) in enumerate(rows) for x in range(low, low + n) if strings[g, x, c[x - low : x - low + length]] > 1}
        got, stored = found_by_sort(rows, length, held, block, tmp_path)
        assert got == want and (stored > 0) == (held < 10_000)


def test_common_prefixes_are_exact():
    """Prefix lengths of every column, carried through the queue, against the bytes themselves."""
    length, rng = 10, random.Random(4)
    rows = groups(rng, length, 5, 12)
    for block in (3, 1000):
        shard = sd.Shard(length, sd.Spool("", 1 << 30))
        shard.add(*(np.array([r[i] for r in rows]) for i in range(3)), [r[3] for r in rows])
        start = np.zeros(len(rows), sd.TUPLE)
        start["suffix"], start["key"] = np.arange(len(rows)), shard.group.astype(np.int64) << 9
        queue = sd.Queue(shard.spool)
        queue.push(start)
        for x in range(length - 1, -shard.reach - 1, -1):
            queue = shard.induced(queue.pop(block), x)
            order = np.concatenate(list(queue.pop(block)))
            rest = lambda i: rows[i][3][x - rows[i][1] :] if x >= rows[i][1] else b""  # noqa: E731,B023
            for one, two in zip(order[:-1], order[1:]):
                a, b = rest(one["suffix"]), rest(two["suffix"])
                if rows[one["suffix"]][0] == rows[two["suffix"]][0]:
                    same = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
                    assert a[:length] <= b[:length] and two["common"] == min(same, length)
                else:
                    assert two["common"] == 0
            queue = sd.Queue(shard.spool)
            queue.push(order)


def test_crowded_groups_are_halved(spark, monkeypatch):
    """Groups above the limit are parted by place until they are small or one class."""
    monkeypatch.setattr(sd, "LIMIT", 3)
    monkeypatch.setattr(sd, "SHARD", 5)
    rng = random.Random(5)
    passage = prose(rng, 60)[:60]
    rows = [(i, prose(rng, 8) + passage[: rng.choice([39, 40, 41, 60])] + prose(rng, 8)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    check(spark, rows, 40)


def test_a_task_passes_on_two_of_a_class(spark):
    text = prose(random.Random(6), 300)
    rows = sd.windows(docs(spark, [(i, text) for i in range(20)]).coalesce(1), 200)
    few = rows.filter(~F.col("known")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert few == 2 and rows.filter("known").count() == 18  # the known windows of a text are one


def test_query_columns(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, prose(rng, 50)) for i in range(6)]
    rows.append((9, rows[2][1] + " tail"))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(sd.op12_suffix_dedup(spark, str(tmp_path)))
    import hashlib

    for (i, _), (n, spans, kept) in zip(rows, brute([r[1] for r in rows], 200)):
        assert got[i] == {"doc_id": i, "n_bytes": n, "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
    assert got[9]["n_removed"] > 200
