"""Toxicity of whole texts by a recurrent network over words and their characters.

Words end at the space and punctuation characters of Unicode, and in ASCII at all but letters and digits.
A run of more than ``LETTERS`` bytes, as in scripts without spaces, is cut into pieces of at most that
many bytes that overlap by half: each is a word in its place, so every byte is read.

A word's input is its own embedding (one of a vocabulary, zero for other words), the mean embedding of
its character trigrams, and how much more often the word, and its characters in fours and fives, stand
in toxic than in clean documents. Two
gated recurrent layers read a window forwards and backwards, attention pools their states, and one
output says how likely the window is toxic. A document is scored by all its overlapping windows; the
highest one is its score.

The network is trained in numpy on the driver, on a bounded sample of the labelled documents: at most
``DOCS`` of either label, the first by a hash of the id, and of each at most ``WINDOWS`` windows, by
hash from all over the text; of near copies (an equal minimum hash of word triples) one is taken. First every window has its document's label; then, in toxic documents,
only the windows that the network finds toxic, or the one it finds most so. Last, the score that
parts the sample's documents best, scored whole, is moved to one half.

Null and empty texts, and texts without words, are one empty window with the lowest score of all: 0.
Without labelled documents of both kinds every score is 0. A null id is scored as any other, is not
held out and is never learned from; repeated rows are scored each for itself; several labels of one
id count as toxic if one is. Texts of any length are scored whole, slice by slice. Other columns,
whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import documents, learns, map_text, slices, text_of

WIDTH, STRIDE = 32, 24
DOCS, WINDOWS = 1_200, 12
EMBED, HIDDEN, ATTEND = 16, 12, 12
GRAM_CELLS, LETTERS = 1 << 14, 24
SEEN, OFTEN, MINIMA = 4, 20, 3
CHANNELS = 3
FALSE_COST = 4
EPOCHS, SECOND, BATCH, RATE, SLOW = 3, 2, 256, 0.005, 0.1
KEPT = 150_000
BLANKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


BETWEEN = re.compile("[%s]+" % "".join(re.escape(c) for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c)[0] in "PZ"))


def words(text: str) -> list[bytes]:
    if not text.isascii():
        text = BETWEEN.sub(" ", text)
    parts = text.encode("utf-8").lower().translate(BLANKS).split()
    if max(map(len, parts), default=0) <= LETTERS:
        return parts
    return [x for w in parts for x in ((w,) if len(w) <= LETTERS else overlapping(w))]


def overlapping(word: bytes) -> Iterator[bytes]:
    """Pieces of at most ``LETTERS`` bytes, cut between characters; any ``LETTERS // 2`` bytes in a row
    are whole in one."""
    a = 0
    while len(word) - a > LETTERS:
        b = a + LETTERS
        while word[b] & 0xC0 == 0x80:
            b -= 1
        yield word[a:b]
        a = b - LETTERS // 2
        while word[a] & 0xC0 == 0x80:
            a -= 1
    yield word[a:]


def features(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word the cells of its character trigrams and the hashes of its runs of four and five
    bytes (with the word's edges) and its first four to ten bytes; -1 and 0 where there is none. Words have
    at most ``LETTERS`` bytes."""
    raw = np.array(distinct, dtype=f"S{LETTERS}").view(np.uint8).reshape(len(distinct), LETTERS).astype(np.uint64)
    edged = np.zeros((len(distinct), LETTERS + 2), np.uint64)
    edged[:, 1:-1] = raw
    mix = lambda *columns: sum(c * np.uint64(f) for c, f in zip(columns, FACTORS))
    three = (mix(edged[:, :-2], edged[:, 1:-1], edged[:, 2:]) >> np.uint64(50)).astype(np.int64)  # GRAM_CELLS
    four = np.where(edged[:, 2:-1] > 0, mix(*(edged[:, k : k - 3 or None] for k in range(4))), 0)
    five = np.where(edged[:, 3:-1] > 0, mix(*(edged[:, k : k - 4 or None] for k in range(5))), 0)
    heads, h = [], np.zeros(len(distinct), np.uint64)
    for k in range(10):
        h = (h + raw[:, k] + np.uint64(1)) * np.uint64(FACTORS[1])
        if k >= 3:
            heads.append(np.where(raw[:, k] > 0, h ^ (h >> np.uint64(29)), 0))
    return np.where(raw > 0, three, -1), np.concatenate([four, five, np.stack(heads, 1)], 1)


FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Network(dict):
    """Parameters by name, the vocabulary, and the fixed statistics of words and of runs of characters."""

    trained = ("word", "gram", "xf", "uf", "cf", "xb", "ub", "cb", "a", "v", "o", "b")

    def __init__(self, vocabulary: dict[bytes, int], learned: int, word_odds, run_keys, run_odds, seed: int = 11):
        draw = np.random.default_rng(seed)
        normal = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        size = EMBED + CHANNELS
        super().__init__({"word": normal(0.1, learned + 1, EMBED), "gram": normal(0.1, GRAM_CELLS, EMBED)})
        self["word"][0] = 0
        for way in "fb":
            self.update({f"x{way}": normal(0.3, size, 3 * HIDDEN), f"u{way}": normal(0.3, HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)})
        self.update({"a": normal(0.3, 2 * HIDDEN, ATTEND), "v": normal(0.3, ATTEND), "o": normal(0.3, 2 * HIDDEN), "b": np.zeros(1, np.float32)})
        self.vocabulary, self.word_odds, self.run_keys, self.run_odds = vocabulary, word_odds, run_keys, run_odds

    def inputs(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the vocabulary (0: none), trigram cells, and the fixed channels of each word."""
        seen = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int64, len(distinct))
        grams, runs = features(distinct)
        at = np.minimum(np.searchsorted(self.run_keys, runs), len(self.run_keys) - 1)
        odds = np.where(self.run_keys[at] == runs, self.run_odds[at], 0)
        return np.where(seen < len(self["word"]), seen, 0), grams, channels(self.word_odds[seen], odds)


def embed(p: dict, own: np.ndarray, grams: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    there = grams >= 0
    out = p["word"][own]
    count = np.maximum(there.sum(1), 1)[:, None].astype(np.float32)
    total = np.zeros_like(out)
    for k in range(grams.shape[1]):
        some = np.flatnonzero(there[:, k])
        if not len(some):
            break
        total[some] += p["gram"][grams[some, k]]
    return np.concatenate([out + total / count, fixed], 1)


def channels(word: np.ndarray, runs: np.ndarray) -> np.ndarray:
    top = np.sort(runs, 1)[:, -4:]
    return np.stack([word, top[:, -1], top.mean(1)], 1).astype(np.float32)


def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Shrunk log ratio of document frequencies; 0 where both are small."""
    n = min(n_toxic, n_clean)
    return (np.log((toxic / n_toxic * n + 1) / (clean / n_clean * n + 1)) / 2).astype(np.float32)


def _half(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(x: np.ndarray, there: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of one direction: ``x`` (steps, rows, 3 * HIDDEN), ``there`` (steps, rows, 1)."""
    steps, rows, _ = x.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    states, trace = np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        hu = h @ u
        gates = _half(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if keep:
            trace.append((h, r, z, c, hu[:, 2 * HIDDEN :]))
        h = h + there[t] * (new - h)
        states[t] = h
    return states, trace


def recur_back(grad: np.ndarray, there: np.ndarray, u: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``u`` from those of the states."""
    steps, rows, _ = grad.shape
    dx, du, dh = np.empty((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, c, hc = trace[t]
        dh = dh + grad[t]
        new = dh * there[t]
        dc = new * (1 - z) * (1 - c * c)
        dz = new * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, dc], 1)
        dhu = np.concatenate([dr, dz, dc * r], 1)
        du += h.T @ dhu
        dh = dh * (1 - there[t]) + new * z + dhu @ u.T
    return dx, du


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, there: np.ndarray, keep: bool = False):
    """Window logits from the projected inputs (steps, rows, 3 * HIDDEN) of both directions."""
    hf, tf = recur(xf, there, p["uf"], keep)
    hb, tb = recur(xb[::-1], there[::-1], p["ub"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    s = np.tanh(h @ p["a"])
    weight = np.where(there[:, :, 0] > 0, s @ p["v"], np.float32(-1e4))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * h).sum(0)
    return pooled @ p["o"] + p["b"], (h, s, weight, pooled, tf, tb)


def gradients(p: dict, own: np.ndarray, grams: np.ndarray, fixed: np.ndarray, ids: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss; ``ids`` (rows, WIDTH) index the words, -1 behind the last."""
    used, at = np.unique(np.maximum(ids, 0), return_inverse=True)
    at = at.reshape(ids.shape).T
    there = (ids.T >= 0)[:, :, None].astype(np.float32)
    e = embed(p, own[used], grams[used], fixed[used])
    xf, xb = (e @ p["xf"] + p["cf"])[at], (e @ p["xb"] + p["cb"])[at]
    logit, (h, s, weight, pooled, tf, tb) = forward(p, xf, xb, there, True)
    d = (_half(logit) - label).astype(np.float32) / len(label)
    g = {"o": pooled.T @ d, "b": d.sum(keepdims=True)}
    dpool = d[:, None] * p["o"]
    dweight = (h * dpool).sum(2)
    dscore = weight * (dweight - (weight * dweight).sum(0))
    ds = dscore[:, :, None] * p["v"] * (1 - s * s)
    g |= {"v": (dscore[:, :, None] * s).sum((0, 1)), "a": np.tensordot(h, ds, ([0, 1], [0, 1]))}
    dh = weight[:, :, None] * dpool + ds @ p["a"].T
    flat, de = at.ravel(), np.zeros_like(e)
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(len(used)))
    for way, states, trace in (("f", dh[:, :, :HIDDEN], tf), ("b", dh[::-1, :, HIDDEN:], tb)):
        mask = there if way == "f" else there[::-1]
        dx, g[f"u{way}"] = recur_back(states, mask, p[f"u{way}"], trace)
        dx = ((dx if way == "f" else dx[::-1]) * there).reshape(-1, 3 * HIDDEN)
        by_word = np.add.reduceat(dx[order], cuts, axis=0)
        g |= {f"c{way}": by_word.sum(0), f"x{way}": e.T @ by_word}
        de += by_word @ p[f"x{way}"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    de = de[:, :EMBED]
    np.add.at(g["word"], own[used], de)
    g["word"][0] = 0
    some = grams[used]
    share = de / np.maximum((some >= 0).sum(1), 1)[:, None]
    row, col = np.nonzero(some >= 0)
    np.add.at(g["gram"], some[row, col], share[row])
    return g


def fit(p: Network, own, grams, fixed, ids: np.ndarray, label: np.ndarray, epochs: int, seed: int) -> None:
    """Adam, with windows of both labels weighing alike by drawing them alike."""
    draw = np.random.default_rng(seed)
    one, two = {k: np.zeros_like(p[k]) for k in p.trained}, {k: np.zeros_like(p[k]) for k in p.trained}
    yes, no, step = np.flatnonzero(label > 0), np.flatnonzero(label == 0), 0
    for _ in range(epochs * max(1, -(-len(ids) // BATCH))):
        at = np.concatenate([draw.choice(yes, BATCH // 2), draw.choice(no, BATCH // 2)])
        step += 1
        for k, g in gradients(p, own, grams, fixed, ids[at], label[at]).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            rate = RATE * SLOW if k in ("word", "gram") else RATE
            p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)


def starts(count: int) -> range:
    """First words of the windows of a text; the last window reaches its end."""
    return range(0, max(1, count - (WIDTH - STRIDE)), STRIDE)


class Scorer(dict):
    """Word to the row of its projected inputs in a table, filled slice by slice; row 0 is no word."""

    def __init__(self, params: Network):
        super().__init__()
        self.params = params
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def fill(self, lists: list[list[bytes]]) -> None:
        if len(self) > KEPT:
            self.reset()
        new = list(set().union(*lists).difference(self))
        p, n = self.params, len(self) + 1
        if not new:
            return
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        e = embed(p, *p.inputs(new))
        self.table[n : n + len(new), : 3 * HIDDEN] = e @ p["xf"] + p["cf"]
        self.table[n : n + len(new), 3 * HIDDEN :] = e @ p["xb"] + p["cb"]
        self.update(zip(new, range(n, n + len(new))))

    def logits(self, texts: list[str]) -> Iterator[float]:
        """The highest window logit of each text, minus infinity for a text without words."""
        for a, b in slices(texts):
            lists = [words(t) for t in texts[a:b]]
            self.fill(lists)
            first, owner, flat, at = [], [], [], 0
            for i, w in enumerate(lists):
                if w:
                    s = np.fromiter(starts(len(w)), np.int64)
                    first.append(np.stack([s + at, np.full(len(s), at + len(w))], 1))
                    owner.append(np.full(len(s), i))
                    flat.append(np.fromiter(map(self.__getitem__, w), np.int32, len(w)))
                    at += len(w)
            best = np.full(len(lists), -np.inf)
            if first:
                first, owner, flat = np.concatenate(first), np.concatenate(owner), np.concatenate(flat)
                for k in range(0, len(first), 1024):
                    np.maximum.at(best, owner[k : k + 1024], self._windows(flat, first[k : k + 1024]))
            yield from best.tolist()

    def _windows(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        place = first[:, 0] + np.arange(WIDTH)[:, None]
        there = place < first[:, 1]
        rows = np.where(there, flat[np.minimum(place, len(flat) - 1)], 0)
        x = self.table[rows]
        return forward(self.params, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], there[:, :, None].astype(np.float32))[0]


def sample(docs: DataFrame, labels: DataFrame, per_label: int = DOCS) -> DataFrame:
    """``text, toxic`` of the documents to learn from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(learns(F.col("doc_id"), 0)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    some = [known.filter(c).orderBy(order, "doc_id").limit(per_label) for c in ("toxic > 0", "toxic = 0")]
    picked = some[0].unionByName(some[1])  # a bounded number of rows
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a repeated id counts once
    return found.select("text", F.col("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    """The network and the window logit at which a document is as likely toxic as not; None without
    labelled documents of both kinds."""
    chosen = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)

    def cut(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(text_of(batch.column("text")), batch.column("toxic").to_pylist()):
                w = words(text)
                if not w:
                    continue
                windows = [b" ".join(w[s : s + WIDTH]) for s in starts(len(w))]
                triples = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                least = [min(xxhash.xxh3_64_intdigest(x, seed) for x in triples) >> 1 for seed in range(MINIMA)]
                some = sorted((xxhash.xxh3_64_intdigest(x, i), x) for i, x in enumerate(windows))[:WINDOWS]
                out.append((int(toxic > 0), least, [x for _, x in some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary())))], ["toxic", "minima", "windows"])

    found = sorted((tuple(r["minima"]), r["toxic"], [bytes(x) for x in r["windows"]]) for r in map_text(chosen, cut, "toxic int, minima array<long>, windows array<binary>").collect())
    taken, seen = [], set()
    for minima, toxic, windows in found:
        if seen.isdisjoint(minima):
            taken.append((toxic, [w.split() for w in windows]))
        seen.update(minima)
    n_toxic, n_clean = sum(t for t, _ in taken), sum(1 - t for t, _ in taken)
    if not n_toxic or not n_clean:
        return None
    params, known, own, grams, fixed = statistics(taken, n_toxic, n_clean)
    rows = [(d, toxic, w) for d, (toxic, windows) in enumerate(taken) for w in windows]
    ids = np.full((len(rows), WIDTH), -1, np.int64)
    for i, (_, toxic, w) in enumerate(rows):
        ids[i, : len(w)] = [known[x] + toxic * len(known) for x in w]
    label, doc, split = np.array([r[1] for r in rows], np.float32), [r[0] for r in rows], [r[2] for r in rows]
    fit(params, own, grams, fixed, ids, label, EPOCHS, 1)
    scorer = Scorer(params)
    found = np.array(list(scorer.logits([b" ".join(w).decode("utf-8", "replace") for w in split])))
    top = {}
    for i in np.flatnonzero(label > 0):
        if doc[i] not in top or found[i] > found[top[doc[i]]]:
            top[doc[i]] = i
    kept = (label == 0) | (found > 0)
    kept[list(top.values())] = True
    fit(params, own, grams, fixed, ids[kept], label[kept], SECOND, 2)

    def whole(batches):
        scorer = Scorer(params)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(scorer.logits(text_of(batch.column("text")))), pa.float64()), batch.column("toxic")], ["logit", "toxic"])

    scored = [(r["logit"], r["toxic"] > 0) for r in map_text(chosen, whole, "logit double, toxic int").collect() if r["logit"] > -np.inf]
    return params, parting(scored)


def statistics(taken: list[tuple[int, list[list[bytes]]]], n_toxic: int, n_clean: int):
    """A network to train, with how often words and runs of characters stand in documents of either
    label; all words of the sample; and their inputs, first as they are in a clean document, then as
    in a toxic one: without the count of that document itself, as in a text not learned from."""
    known: dict[bytes, int] = {}
    sets = [sorted({known.setdefault(w, len(known)) for window in windows for w in window}) for _, windows in taken]
    grams, runs = features(list(known))
    keys, at = np.unique(runs, return_inverse=True)
    at = at.reshape(runs.shape)
    count, run_count = np.zeros((2, len(known))), np.zeros((2, len(keys)))
    for (toxic, _), some in zip(taken, sets):
        count[toxic, some] += 1
        run_count[toxic, np.unique(at[some])] += 1

    def odds_of(c: np.ndarray, without: int | None = None) -> np.ndarray:
        less = [c[k] - (k == without) for k in (0, 1)]
        value = odds(np.maximum(less[1], 0), np.maximum(less[0], 0), n_toxic, n_clean)
        return np.where(less[0] + less[1] >= SEEN, value, 0).astype(np.float32)

    order = np.argsort(-count.sum(0), kind="stable")
    order = order[count.sum(0)[order] >= SEEN]
    names, learned = list(known), int((count.sum(0) >= OFTEN).sum())
    vocabulary = {names[i]: k + 1 for k, i in enumerate(order)}
    run_odds = odds_of(run_count)
    some = np.flatnonzero((run_odds != 0) & (keys > 0))
    network = Network(vocabulary, learned, np.concatenate([[0], odds_of(count)[order]]).astype(np.float32), np.concatenate([keys[some], [np.uint64(2**64 - 1)]]), np.concatenate([run_odds[some], [0]]).astype(np.float32))
    own = np.zeros(len(known), np.int64)
    own[order[:learned]] = np.arange(1, learned + 1)
    fixed = []
    for label in (0, 1):
        of_runs = np.where(keys > 0, odds_of(run_count, label), 0)
        fixed.append(channels(odds_of(count, label), of_runs[at]))
    return network, known, np.tile(own, 2), np.tile(grams, (2, 1)), np.concatenate(fixed)


def parting(scored: list[tuple[float, bool]]) -> float:
    """The value between clean and toxic with the fewest errors; the share of clean documents taken
    for toxic weighs ``FALSE_COST`` times the share of toxic ones missed."""
    yes = np.sort([s for s, toxic in scored if toxic])
    no = np.sort([s for s, toxic in scored if not toxic])
    values = np.unique(np.concatenate([yes, no]))
    middle = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    errors = np.searchsorted(yes, middle) / max(len(yes), 1) + FALSE_COST * (1 - np.searchsorted(no, middle) / max(len(no), 1))
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(middle[best[len(best) // 2]])


def scores(docs: DataFrame, model: tuple[Network, float] | None, name: str = "toxicity") -> DataFrame:
    """``docs`` with a new column ``name``: the score of every whole text."""

    def run(batches):
        scorer = Scorer(model[0]) if model else None
        for batch in batches:
            texts = text_of(batch.column(text_at))
            found = np.array(list(scorer.logits(texts))) - model[1] if scorer is not None else np.full(len(texts), -np.inf)
            with np.errstate(over="ignore"):
                value = 1 / (1 + np.exp(-found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], [*batch.schema.names, name])

    text_at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_text(docs, run, f"{fields}, `{name}` double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    name = "_toxicity_score"
    return scores(docs, train(docs, labels), name).filter(F.col(name) < 0.5).select(docs.columns)


def op2_toxicity(spark, sf):
    docs = documents(spark, sf)
    model = train(docs, table(spark, sf, "labels"))
    found = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(~learns(F.col("doc_id"), 0), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES = {}
