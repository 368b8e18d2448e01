"""Log probabilities of whole texts under a hashed maximum-entropy model with factored word classes.

A token (a word, or the end of a text) is reached from the root of a tree of classes: at every class a
softmax over its ``WAYS`` children at most, the parts of the path multiplied. The logits of a class are
its children's shares in the training tokens, as a bias, plus the weights of hashed features of the
context: the last word, the last two, and the word before the last (a skip). The tree is
that of the shortest mean path (frequent words are near the root), so a token costs few softmaxes.

1. Counts: every training token is counted by a 64-bit hash of its word, with partial sums. For n
   words the chance of any clash is below n * n / 2^65.
2. Tree: its leaves are the ``HEAD`` most frequent words and, for all others, buckets by hash, as many as
   there are such words, ``BUCKETS`` at most. In a bucket a word has its share of the counts, all
   unknown ones together that of half a token.
3. Training: in ``ROUNDS`` rounds, each over its own part of the training documents by a hash of the text and
   all together over every one of them, the tasks sum for every feature cell the children seen and those expected; the step is the gradient (seen less expected) over their mean, a
   bound of its curvature. Weights are broadcast: a cell for every ``TOKENS_A_CELL`` training tokens,
   ``LEAST_BITS`` to ``MOST_BITS`` bits of them; sums are added up by cell range.
4. Scores: texts are scored in numpy over batches of tokens; words outside the head meet the table of counts by
   a join on their hash.

Null and empty texts are one end token. A row without an id is learned from and never held out.
Repeated rows are scored each for itself. Without training documents the counts are 0 and the scores
those of an empty table: every token is unknown. Texts of any length are taken whole, slice by slice.
Other columns, whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, learns, map_text, slices, text_of

HELD_OUT = 1
HEAD, BUCKETS = 1 << 17, 1 << 12
WAYS = 16
ONES = np.ones(WAYS, np.float32)
TOKENS_A_CELL, LEAST_BITS, MOST_BITS = 256, 13, 20
ROUNDS, RATE, SMOOTH = 3, 0.6, 2.0
STEPS_PER_DOUBLING = 8
TASK_TOKENS = 64_000_000
RANGE = 1_024
END = xxhash.xxh3_64_intdigest(b"\n")
SLICE = 250_000
BLOCK, PART = 4_096, 4_096
KEPT = 1 << 22


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64)


def word_hashes(found: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """Stored table ``h, c``: the count of every training token. A task sorts ``KEPT`` hashes at a time."""

    def run(batches):
        held: list[np.ndarray] = []
        n = ends = 0

        def rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], ["h", "c"])

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            last = np.append(np.flatnonzero(h[1:] != h[:-1]), len(h) - 1)
            return rows(h[last], np.diff(last, prepend=-1))

        for batch in batches:
            texts = text_of(batch.column("text"))
            ends += len(texts)
            for text in texts:
                held.append(word_hashes(words(text)))
                n += len(held[-1])
                if n >= KEPT:
                    yield flush()
                    n = 0
        if n:
            yield flush()
        if ends:
            yield rows(np.array([END], np.uint64), np.array([ends]))

    path = scratch_path(docs.sparkSession, "token-counts")
    map_text(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def class_tree(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of ``WAYS`` children a class with the shortest mean path: for every leaf where its path
    starts, the classes and children of all paths, and each class's children's log shares."""
    n = len(sizes)
    order = np.argsort(sizes, kind="stable")
    leaves, inner = [(float(sizes[i]), int(i)) for i in order], []
    classes = -(-(n - 1) // (WAYS - 1))
    up, child = np.full(n + classes, -1, np.int64), np.zeros(n + classes, np.int64)
    bias = np.full((max(classes, 1), WAYS), -1e30, np.float32)
    i = j = 0
    for c in range(classes):
        wide = 2 + (n - 2) % (WAYS - 1) if c == 0 else WAYS
        taken = []
        for _ in range(wide):  # both lists are sorted
            if j >= len(inner) or i < n and leaves[i] <= inner[j]:
                taken.append(leaves[i])
                i += 1
            else:
                taken.append(inner[j])
                j += 1
        whole = sum(x for x, _ in taken)
        for d, (x, node) in enumerate(taken):
            up[node], child[node], bias[c, d] = c, d, np.log(x / whole)
        inner.append((whole, n + c))
    steps, at = [], np.arange(n)
    while (up[at] >= 0).any():
        there = up[at] >= 0
        steps.append((np.flatnonzero(there), up[at[there]], child[at[there]]))
        at = np.where(there, n + up[at], at)
    if not steps:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), bias
    leaf, cls, digit = (np.concatenate(x) for x in zip(*steps))
    by = np.argsort(leaf, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))]), cls[by], digit[by], bias


def table_of(cells: int) -> np.ndarray:
    """Rows of ``WAYS`` zeros, each in one line of the processor's cache."""
    raw = np.zeros(cells * WAYS * 4 + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + cells * WAYS * 4].view(np.float32).reshape(cells, WAYS)


class Model:
    """Head words by hash with their counts, sums of the buckets of all others, the tree, and the weights
    of the feature cells."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int, buckets: np.ndarray | None = None):
        by = np.argsort(h)
        self.h, self.c, self.total, self.distinct = h[by], c[by], total, distinct
        self.near = np.uint64(64 - max(1, len(h).bit_length()))  # words by the first bits of their hashes: about one each
        self.first = np.searchsorted(self.h, np.arange(1 << (64 - int(self.near)), dtype=np.uint64) << self.near).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(h)))
        self.buckets = np.full(1, 0.5) if buckets is None else buckets  # counts and a half of their words, and a half
        self.shift = 65 - len(self.buckets).bit_length()
        self.start, self.cls, self.digit, self.bias = class_tree(np.concatenate([self.c + 0.5, self.buckets]))
        self.bits = max(LEAST_BITS, min(MOST_BITS, (max(1, total // TOKENS_A_CELL) - 1).bit_length()))
        self.weights = table_of(1 << self.bits)

    def __setstate__(self, state: dict) -> None:
        """In a task: the weights move out of the message that brought them, as its memory is slow to look things up in."""
        self.__dict__.update(state)
        weights = state.pop("weights")
        self.weights = table_of(len(weights))
        self.weights[:] = weights

    def at(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the head, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        first = (h >> self.near).astype(np.int64)
        at, end = self.first.take(first), self.first.take(first + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            some = at[left]
            same = self.h.take(some) == h[left]
            out[left[same]] = some[same]
            at[left] += 1
            left = left[~same & (some + 1 < end[left])]
        return out

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(h), np.int64)


class Reader:
    """Texts to tokens: their hashes, and the steps on their paths."""

    def __init__(self, model: Model):
        self.model = model
        self.salt = np.arange(1, len(model.bias) + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)

    def read(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per slice of texts: the tokens' hashes and each text's number of tokens."""
        for a, b in slices(texts, SLICE):
            lists = [words(t) for t in texts[a:b]]
            sizes = np.array([len(w) + 1 for w in lists])
            h = np.full(sizes.sum(), END, np.uint64)
            inside = np.ones(len(h), bool)
            inside[np.cumsum(sizes) - 1] = False
            h[inside] = word_hashes(chain.from_iterable(lists))
            yield h, sizes

    def contexts(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashed features of every token: (features, tokens). Before the text there is no word."""
        starts = np.cumsum(sizes) - sizes

        def back(k: int) -> np.ndarray:
            out = np.full(len(word), 3, np.uint64)
            out[k:] = word[:-k]
            for j in range(k):
                out[starts[sizes > j] + j] = 3
            return out

        one, two = back(1), back(2)
        mixed = (one, one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(5), two)
        return np.stack([(m + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9) for k, m in enumerate(mixed)])

    def steps(self, h: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of the steps on the tokens' paths: token, class, child, and feature cells (features, steps)."""
        m, found = self.model, self.contexts(h, sizes)
        leaves = np.where(place >= 0, place, len(m.h) + m.bucket(h))
        for a in range(0, len(h), BLOCK):
            leaf = leaves[a : a + BLOCK]
            start = m.start.take(leaf)
            deep = m.start.take(leaf + 1) - start
            token = np.repeat(np.arange(a, a + len(leaf)), deep)
            at = np.arange(len(token)) + np.repeat(start - (np.cumsum(deep) - deep), deep)
            cls = m.cls.take(at)
            x = found.take(token, 1)
            x += self.salt.take(cls)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x >>= np.uint64(64 - m.bits)
            yield token, cls, m.digit.take(at), x.view(np.int64)


def logits(model: Model, cls: np.ndarray, cells: Iterable[np.ndarray]) -> np.ndarray:
    """Of the children: (steps, ways). Small enough for exponentials, as every round adds 2 * ``RATE`` at most."""
    x = np.empty((len(cls), WAYS), np.float32)
    for a in range(0, len(cls), PART):  # small enough for the processor's cache
        part = x[a : a + PART]
        model.bias.take(cls[a : a + PART], 0, out=part, mode="clip")
        for f in cells:
            part += rows_at(model.weights, f[a : a + PART])
    return x


def rows_at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``WAYS`` numbers; ``take`` copies a row at once, an index only number by number."""
    return table.take(at, 0, mode="clip")


def shares(model: Model, cls: np.ndarray, cells: Iterable[np.ndarray] = ()) -> np.ndarray:
    """What is expected of the children: (steps, ways). Without cells, as the tree has it."""
    p = logits(model, cls, cells)
    np.exp(p, out=p)
    p /= (p @ ONES)[:, None]
    return p


def add_rows(table: np.ndarray, at: np.ndarray, order: np.ndarray | slice, values: np.ndarray, mark: np.ndarray | None = None) -> None:
    """Adds the rows ``values[order]`` to those at ``at``, in any order and repeated or not. Places met once, most of a
    block, are copied; the others' rows are summed in double precision first. ``mark`` is room for a number a place."""
    values, half = values[order], values.shape[1] // 2
    number = np.arange(len(at), dtype=np.int32)
    mark = np.empty(len(table), np.int32) if mark is None else mark
    mark[at] = number
    last = mark.take(at)
    early = np.flatnonzero(last != number)
    sums = rows_at(table, at)
    sums += values
    if len(early):
        last = last.take(early)
        slot = np.zeros(len(at), np.int64)
        slot[last] = 1
        many = np.flatnonzero(slot)
        slot[many] = np.arange(len(many))
        whole = rows_at(values, many).astype(np.float64)
        pairs = rows_at(values, early).astype(np.float64).view(np.complex128).ravel()
        np.add.at(whole.view(np.complex128).ravel(), ((slot.take(last) * half)[:, None] + np.arange(half)).ravel(), pairs)
        whole_row(sums)[many] = whole_row(whole.astype(table.dtype) + rows_at(table, at.take(many)))
    whole_row(table)[at] = whole_row(sums)  # of a place's rows the last stays


def whole_row(table: np.ndarray) -> np.ndarray:
    """The same memory, a row as one item."""
    return table.view(f"V{table.itemsize * table.shape[1]}").ravel()


def cell_sums(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """By ranges of cells, the children seen and those expected in all texts of a task. Before the first
    update what a class expects is the same in every context."""
    reader, cells_ = Reader(model), len(model.weights)
    flat = None if model.weights.any() else shares(model, np.arange(len(model.bias)))
    seen = np.zeros(cells_ * WAYS, np.int32)
    expected, mark = table_of(cells_), np.zeros(cells_, np.int32)
    any_ = False
    for batch in batches:
        for h, sizes in reader.read(text_of(batch.column("text"))):
            any_ = True
            for _, cls, digit, cells in reader.steps(h, model.at(h), sizes):
                p = shares(model, cls, cells) if flat is None else rows_at(flat, cls)
                for f in cells:
                    np.add.at(seen, f * WAYS + digit, np.int32(1))
                    add_rows(expected, f, slice(None), p, mark)
    if any_:
        for r in range(0, cells_, RANGE):
            sums = seen[r * WAYS : (r + RANGE) * WAYS].tobytes() + expected[r : r + RANGE].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sums], pa.binary())], ["cell", "sums"])


def step(docs: DataFrame, model: Model) -> np.ndarray:
    """The update of the weights from the training documents given."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cells_ = len(model.weights)

    def run(batches):
        yield from cell_sums(batches, shared.value)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column("cell").to_pylist(), batch.column("sums").to_pylist()):
                seen, expected = np.frombuffer(raw[: len(raw) // 2], np.int32), np.frombuffer(raw[len(raw) // 2 :], np.float32)
                sums[r] = sums.get(r, 0) + np.stack([seen.astype(np.float64), expected])
        for r, (seen, expected) in sums.items():
            delta = RATE * 2 * (seen - expected) / (seen + expected + SMOOTH)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([delta.astype(np.float32).tobytes()], pa.binary())], ["cell", "delta"])

    tasks = max(spark.sparkContext.defaultParallelism, model.total // TASK_TOKENS)
    sums = map_text(docs.select("text").coalesce(tasks), run, "cell int, sums binary").repartition(min(cells_ // RANGE, 2 * tasks), "cell")
    out = np.zeros_like(model.weights)
    for row in sums.mapInArrow(total, "cell int, delta binary").collect():  # 2^MOST_BITS cells at most
        out[row["cell"] : row["cell"] + RANGE] = np.frombuffer(row["delta"], np.float32).reshape(-1, WAYS)
    shared.destroy()
    return out


def model_of(counts: DataFrame) -> Model:
    """The untrained model: the most frequent words, ``HEAD`` at most, all with counts above those of the
    rest, and the buckets of the rest."""
    level = F.floor(F.log2("c") * STEPS_PER_DOUBLING).cast("int")
    sizes = sorted(((r["level"], r["m"], r["s"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("s")).collect()), reverse=True)
    total, distinct = sum(s for *_, s in sizes), sum(m for _, m, _ in sizes)
    kept, least = 0, None
    for lv, m, _ in sizes:
        if kept + m > HEAD:
            break
        kept, least = kept + m, lv
    head = counts.filter(level >= least if least is not None else F.lit(False)).toArrow()
    h, c = head.column("h").to_numpy().astype(np.uint64), head.column("c").to_numpy()
    bits = min(BUCKETS, max(1, distinct - kept)).bit_length() - 1
    buckets = np.full(1 << bits, 0.5)
    if kept < distinct:
        rest = counts.filter(level < least) if least is not None else counts
        which = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
        for r in rest.groupBy(which.cast("int").alias("b")).agg((F.sum("c") + F.lit(0.5) * F.count(F.lit(1))).alias("s")).collect():  # BUCKETS at most
            buckets[r["b"]] += r["s"]
    return Model(h, c, total, distinct, buckets)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (``doc_id, text``: training documents only) and their token counts."""
    counts = count_tokens(docs)
    model = model_of(counts)
    part = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds if model.total else 0):
        model.weights += step(docs.filter(part == k), model)
    return model, counts


def by_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of words by text, then hash: two sorts of whole numbers, which are quicker than one by two keys."""
    by = np.argsort(h)
    shift = len(h).bit_length()
    return by[np.sort((text[by] << shift) | np.arange(len(h))) & ((1 << shift) - 1)]


def scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_known, base_score, score`` (log10)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "counted", "fitted", "words", "times"]

    def run(batches):
        reader = Reader(shared.value)
        m = reader.model
        draw = np.random.default_rng()  # row numbers of this attempt; the written rows fix them
        counted, whole = np.append(np.log(m.c + 0.5), 0), np.log(m.buckets)
        for batch in batches:
            at, doc_ids = 0, batch.column("doc_id")
            for word, sizes in reader.read(text_of(batch.column("text"))):
                place, text = m.at(word), np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(text, counted[place], len(sizes))
                fitted, n_known = base * 0, np.bincount(text, place >= 0, len(sizes)).astype(np.int64)
                for token, cls, digit, cells in reader.steps(word, place, sizes):
                    x = logits(m, cls, cells)
                    logp = x.ravel().take(np.arange(0, x.size, WAYS) + digit) - np.log(np.exp(x, out=x) @ ONES)
                    fitted += np.bincount(text[token], logp, len(sizes))
                tail = np.flatnonzero(place < 0)
                h, text = word[tail], text[tail]
                fitted -= np.bincount(text, whole[m.bucket(h)], len(sizes))
                by = by_text(h, text)
                h, text = h[by], text[by]
                new = np.ones(len(by), bool)
                new[1:] = (np.diff(text) > 0) | (h[1:] != h[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(by)))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(sizes)))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(draw.integers(-(2**63), 2**63, len(sizes), dtype=np.int64)),
                        doc_ids.slice(at, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(n_known),
                        pa.array(base),
                        pa.array(fitted),
                        *(pa.ListArray.from_arrays(ends, x) for x in (pa.array(signed(h[new])), pa.array(times, pa.int32()))),
                    ],
                    names,
                )
                at += len(sizes)

    path = scratch_path(spark, "model-scores")
    schema = "row long, doc_id long, n_tokens long, n_known long, counted double, fitted double, words array<long>, times array<int>"
    map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema).write.parquet(path)
    rows = spark.read.parquet(path)
    tails = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("h"), F.col("x.times").cast("long").alias("k"))
    met = tails.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log(F.col("c") + F.lit(0.5))).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("k"))
    zero = F.lit(0.0)
    whole = math.log(model.total + 0.5 * (model.distinct + 1))
    log10 = lambda x: x / F.lit(math.log(10))
    return rows.select(names[:6]).join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        log10(F.col("counted") + F.coalesce("s", zero) - F.col("n_tokens") * whole).alias("base_score"),
        log10(F.col("fitted") + F.coalesce("s", zero)).alias("score"),
    )


def op9_language_model(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    model, counts = train(docs.filter(learns(F.col("doc_id"), HELD_OUT)))
    return scores(docs, model, counts).select(
        "doc_id",
        F.coalesce(~learns(F.col("doc_id"), HELD_OUT), F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op9_language_model": op9_language_model}
ORACLES = {}
