"""Join of documents on the Jaccard similarity of their word shingles, by several token orders.

Two documents link when ``100 * intersection >= percent * union`` of their sets of shingles of ``words``
words: 85 and 4 in ``op5_jaccard_join``, whatever the caller asks for elsewhere. In any global order of
the shingles such a pair shares one among the first ``n - ceil(percent n / 100) + 1`` of either set, so a pair must share one under *every* order. The orders put frequent shingles last (by a count
sketch of all shingles of all documents) and break ties by different hashes.

1. Keys: one pass hashes every text to its set's size and key and counts shingles in the sketch, a
   table of ``SKETCH`` cells whatever the input. Documents with the same set become one class.
2. Groups: sets are cut into parts by ranges of their hashes, and the first parts under an order with rare
   shingles first are shuffled by their contents (``first_parts``); neighbours in each list, sorted
   by set size, are joined while their sizes allow a link. What hangs together is a candidate group:
   no link leaves it. Groups too large for a block are parted again by other parts.
3. Blocks: a group is cut into blocks by hash, bounded in rows and shingles. In a block the pairs
   that share first shingles under all orders and whose sizes fit are verified by their whole sets;
   the block gives a spanning tree of its links, never its pairs.
4. Groups of several blocks are cut anew in ``ROUNDS`` other ways. Then every class outside its
   group's largest component is held against all classes of the group, block against block, so no
   link is lost and a group of near copies costs about its size, not its square.

Sets are compared by 64-bit hashes of shingles and classes by 64-bit keys; for n of either the chance
of any clash is below n * n / 2^65.

Null, empty and blank texts have no shingles and link with nothing (their component is their own id);
texts of under ``words`` words are one shingle. A row without an id has its copies' component, null if none
of them has an id, and connects nobody. Repeated rows
are members of one class. Texts of any length are taken whole. Other columns, whatever their names,
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, shuffles_dropped
from .common import WORD, connected, delete, documents, each_text, map_text, text_of

WORDS, NUM, DEN = 4, 85, 100
SKETCH, CELLS = 1 << 24, 1 << 18
COUNTED = 1 << 18  # shingles that a task counts at a time
ORDERS = 3
MARKS = 1 << 26
ROUNDS = 2
BLOCK_ROWS, BLOCK_SHINGLES = 384, 2_000_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)  # one for each word of a shingle


def scrambled(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Mixes 64-bit values; a one-to-one map for each salt."""
    h = h + np.uint64(salt * int(FACTORS[0]) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), 1)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    if words > len(FACTORS):
        raise ValueError(f"a shingle has at most {len(FACTORS)} words")
    return np.unique(scrambled(sum(w[i : i + n] * FACTORS[i] for i in range(words))))


def set_key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64)  # SKETCH cells


def first_size(n: int, percent: int = NUM) -> int:
    """Number of first shingles of which a linked pair shares one."""
    return n - -(-percent * n // DEN) + 1


def first(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int = NUM) -> np.ndarray:
    """The first shingles under an order; more than needed where the last place is tied."""
    rank = (levels[cells(tokens)].astype(np.uint64) << np.uint64(56)) | (scrambled(tokens, order + 1) >> np.uint64(8))
    k = first_size(len(tokens), percent)
    return tokens[rank <= np.partition(rank, k - 1)[k - 1]] if k < len(tokens) else tokens


def most_apart(n: int, percent: int = NUM) -> tuple[int, int]:
    """The most shingles a set linked with one of ``n`` has, and the most that are in only one of the two."""
    union = DEN * n // percent  # at most n are shared
    return union, (DEN - percent) * union // DEN


def first_parts(tokens: np.ndarray, levels: np.ndarray, percent: int = NUM, salt: int = 0) -> np.ndarray:
    """Keys of a sorted set of which a linked pair shares one.

    Ranges of hashes cut a set into parts, as many for all sets that can be linked. A shingle that is in one set
    only spoils one part, so all but ``d`` parts are equal, and in any global order of parts one of the first
    ``d + 1`` is. Parts with a rare shingle come first, then those of many shingles, empty ones last: what
    sets share by chance are single shingles and common passages, hardly ever a whole part of several."""
    union, d = most_apart(len(tokens), percent)
    if not d:
        return np.zeros(0, np.uint64)  # linked with equal sets only
    values, rare, out = scrambled(tokens, 16 + salt), levels[cells(tokens)], []
    spots = (tokens if not salt else values) >> np.uint64(32)
    if salt:
        by = np.argsort(spots, kind="stable")
        spots, values, rare = spots[by], values[by], rare[by]
    for label in range(len(tokens).bit_length(), union.bit_length() + 1):  # of the larger set's size, in powers of two
        n = (5 * ((DEN - percent) << label)) // (4 * percent) + 3
        place = (spots * np.uint64(n)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        key = scrambled(np.add.reduceat(values, at) + place[at] * FACTORS[1] + FACTORS[2:3] * np.uint64(label))
        if d + 1 < len(at):
            size = np.minimum(np.diff(at, append=len(tokens)), 255).astype(np.uint64)
            rank = ((np.minimum.reduceat(rare, at) >> 2).astype(np.uint64) << np.uint64(56)) | ((np.uint64(255) - size) << np.uint64(48)) | (scrambled(key, 1) >> np.uint64(16))
            key = key[rank <= np.partition(rank, d)[d]]
        elif d + 1 > len(at):
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), place[at])[: d + 1 - len(at)]
            key = np.concatenate([key, scrambled(empty * FACTORS[1] + FACTORS[2:3] * np.uint64(label))])
        out.append(key)
    return np.concatenate(out)


def keyed(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, t, n, key)`` of every row (``t``: a hash of its text; key null without shingles), and the sketch's levels: eight
    times the logarithm of a cell's count. A task's cells are packed, so few shingles take little."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint8)  # of this task, 255 for more

        def count(held: list[np.ndarray]) -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 255)
            held.clear()

        for batch in batches:
            ids, ns, keys, held, size = batch.column("doc_id"), [], [], [], 0
            for text in each_text(batch.column("text")):
                tokens = shingles(text, words)
                held.append(cells(tokens))
                size += len(tokens)
                if size >= COUNTED:
                    count(held)
                    size = 0
                ns.append(len(tokens))
                keys.append(set_key(tokens) if len(tokens) else None)
            if held:
                count(held)
            none = pa.nulls(len(ns), pa.int32()), pa.nulls(len(ns), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, batch.column("t"), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), *none], names)
        for c in range(SKETCH // CELLS):
            part = counts[c * CELLS : (c + 1) * CELLS]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([c], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names
                )

    names = ["doc_id", "t", "n", "key", "cell", "counts"]
    path = scratch_path(docs.sparkSession, "shingle-keys")
    map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")), run, "doc_id long, t long, n long, key long, cell int, counts binary").write.parquet(path)
    stored = docs.sparkSession.read.parquet(path)

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist()):
                total[c] = total.get(c, 0) + np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.uint32)
        for c, t in total.items():
            level = np.minimum(np.round(8 * np.log2(1 + t.astype(np.float64))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["cell", "levels"])

    levels = np.zeros(SKETCH, np.uint8)  # a fixed number of cells, collected as bytes
    parts = stored.filter("cell is not null").select("cell", "counts").repartition(SKETCH // CELLS, "cell")
    for row in parts.mapInArrow(summed, "cell int, levels binary").collect():
        levels[row["cell"] * CELLS : (row["cell"] + 1) * CELLS] = np.frombuffer(row["levels"], np.uint8)
    return stored.filter("cell is null").select("doc_id", "t", "n", "key"), levels


def candidate_groups(docs: DataFrame, levels, words: int = WORDS, percent: int = NUM) -> DataFrame:
    """``(node, root)``: classes that hang together by shared first parts; the group's root itself is left out."""

    def run(batches):
        table, seen = levels.value, set()
        for batch in batches:
            hs, keys, ns = [], [], []
            for text in each_text(batch.column("text")):
                tokens = shingles(text, words)
                if not len(tokens) or (key := set_key(tokens)) in seen:
                    continue
                if len(seen) < 1_000_000:  # copies within a task are told apart later otherwise
                    seen.add(key)
                some = first_parts(tokens, table, percent)
                hs.append(some.astype(np.int64))
                keys += [key] * len(some)
                ns += [len(tokens)] * len(some)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(keys, pa.int64()), pa.array(ns, pa.int32())], ["h", "key", "n"])

    return _chained(map_text(docs.select("text"), run, "h long, key long, n int"), percent)


def _chained(lists: DataFrame, percent: int) -> DataFrame:
    """``(node, root)``: classes that hang together by lists ``(h, key, n)``."""
    rows = lists.repartition("h").sortWithinPartitions("h", "n", "key")

    def neighbours(batches):
        """Neighbours in a list whose sizes allow a link; a larger gap parts all smaller sets from all larger ones."""
        last = None
        for batch in batches:
            h, key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "key", "n"))
            if last is not None:
                h, key, n = (np.concatenate(([x], y)) for x, y in zip(last, (h, key, n)))
            near = (h[1:] == h[:-1]) & (key[1:] != key[:-1]) & (DEN * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            if near.any():
                pairs = np.unique(np.stack([np.minimum(key[:-1], key[1:])[near], np.maximum(key[:-1], key[1:])[near]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            if len(h):
                last = h[-1], key[-1], n[-1]

    return connected(rows.mapInArrow(neighbours, "a long, b long"), "a", "b")


def _blocks(m, s):
    return F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("long")


def _parted(large: DataFrame, levels, percent: int) -> DataFrame:
    """Groups of several blocks ``(key, root, blocks, tokens)`` once more by other parts, which meet by chance in
    other sets: what hangs together in both ways stays a group, single classes are left out."""

    def run(batches):
        for batch in batches:
            hs, keys, ns = [], [], []
            for key, root, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "root", "tokens"))):
                tokens = np.frombuffer(raw, np.uint64)
                some = first_parts(tokens, levels.value, percent, 1)
                hs.append(scrambled(some ^ np.array([root], np.int64).view(np.uint64)).view(np.int64))
                keys += [key] * len(some)
                ns += [len(tokens)] * len(some)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(keys, pa.int64()), pa.array(ns, pa.int32())], ["h", "key", "n"])

    near = _chained(large.select("key", "root", "tokens").mapInArrow(run, "h long, key long, n int"), percent)
    held = large.select("key", (F.octet_length("tokens") / 8).alias("n")).join(near.withColumnsRenamed({"node": "key", "root": "own"}), "key", "left")
    held = cut_lineage(held.withColumn("own", F.coalesce("own", "key")))
    sizes = held.groupBy("own").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter("m > 1")
    placed = held.join(sizes, "own").select("key", F.col("own").alias("root"), _blocks(F.col("m"), F.col("s")).alias("blocks"))
    return large.select("key", "tokens").join(placed, "key").select("key", "root", "blocks", "tokens")


def _shared(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared tokens of each row set with each column set, exact in float32 products over
    the tokens that occur on both sides."""
    m = len(rows)
    tokens = np.concatenate([*rows, *cols])
    owner = np.repeat(np.arange(m + len(cols)), [len(x) for x in (*rows, *cols)])
    both = np.intersect1d(np.unique(tokens[owner < m]), np.unique(tokens[owner >= m]), assume_unique=True)
    out = np.zeros((m, len(cols)), np.float32)
    at = np.searchsorted(both, tokens)
    kept = (at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == tokens) if len(both) else np.zeros(len(tokens), bool)
    at, owner = at[kept], owner[kept]
    by = np.argsort(at, kind="stable")
    at, owner = at[by], owner[by]
    width = 4096
    cuts = np.searchsorted(at, np.arange(0, len(both) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        dense = np.zeros((m + len(cols), width), np.float32)
        dense[owner[a:b], at[a:b] - k * width] = 1
        out += dense[:m] @ dense[m:].T
    return out


def links_between(rows: list[np.ndarray], cols: list[np.ndarray], levels: np.ndarray, percent: int = NUM) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked (row, column) pairs: sizes fit, first shingles are shared under every
    order, and then the whole sets decide."""
    nr, nc = np.array([len(x) for x in rows], np.int64), np.array([len(x) for x in cols], np.int64)
    maybe = (DEN * nr[:, None] >= percent * nc[None]) & (DEN * nc[None] >= percent * nr[:, None])
    for order in range(ORDERS):
        if not maybe.any():
            break
        maybe &= _shared([first(x, levels, order, percent) for x in rows], [first(x, levels, order, percent) for x in cols]) > 0
    i, j = np.nonzero(maybe)
    if not len(i):
        return i, j
    r, c = np.unique(i), np.unique(j)
    if len(i) * 20 < len(r) * len(c):  # few pairs: each by itself
        shared = np.array([len(np.intersect1d(rows[a], cols[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:
        whole = _shared([rows[a] for a in r], [cols[b] for b in c])
        shared = whole[np.searchsorted(r, i), np.searchsorted(c, j)].astype(np.int64)
    linked = DEN * shared >= percent * (nr[i] + nc[j] - shared)
    return i[linked], j[linked]


def tree(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's label after joining the links: the place of the smallest node of its component."""
    up = np.arange(len(nodes))
    while True:
        low = up.copy()
        np.minimum.at(low, i, up[j])
        np.minimum.at(low, j, up[i])
        low = low[low]
        if (low == up).all():
            return up
        up = low


def _block_links(levels, halves: bool, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = levels.value
        keys = pdf["key"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        if halves:  # a side of classes outside the largest component against a side of all
            left, right = np.flatnonzero(pdf["side"].to_numpy() == 0), np.flatnonzero(pdf["side"].to_numpy() == 1)
            if not len(left) or not len(right):
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            i, j = links_between([sets[x] for x in left], [sets[x] for x in right], table, percent)
            i, j = left[i], right[j]
        else:
            i, j = links_between(sets, sets, table, percent)
        up = tree(keys, i, j)
        return pd.DataFrame({"a": keys[up], "b": keys}).query("a != b")

    return run


def _blocked(members: DataFrame, salt: int) -> DataFrame:
    return members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(salt)), F.col("blocks")))


def _among(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is none of ``members``: told by a table of ``MARKS`` bits, whatever the
    number of members, before the texts are shuffled. What it lets through besides falls out of the join that follows."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    words = members.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word"))
    found = words.toArrow()
    table = np.zeros(MARKS // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    marks = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            bit = batch.column("bit").to_numpy().view(np.uint64)
            there = (marks.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(there.astype(bool)))

    return map_text(rows.select("doc_id", "text", bit.alias("bit")), run, "doc_id long, text string")


def link_classes(docs: DataFrame, keys: DataFrame, levels, words: int = WORDS, percent: int = NUM, nameless: bool = False) -> DataFrame:
    """``(node, root)`` of the classes that links connect; the smallest class of a component is left out.
    ``nameless``: rows without an id connect as others do, found by their text's hash."""
    least, own = F.min("doc_id"), F.col("doc_id").cast("long")
    if nameless:
        least, own = F.coalesce(least, F.min("t")), F.coalesce(own, F.xxhash64("text"))
    classes = keys.filter("key is not null").groupBy("key").agg(least.alias("doc_id"), F.first("n").alias("n"))
    near = cut_lineage(candidate_groups(docs, levels, words, percent))
    every = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("key"), "root")
    members = every.join(classes, "key")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    members = cut_lineage(members.join(sizes.select("root", _blocks(F.col("m"), F.col("s")).alias("blocks")), "root").select("doc_id", "key", "root", "blocks"))

    def run(batches):
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), text_of(batch.column("text"))
            found = [(i, t) for i, t in enumerate(shingles(t, words) for t in texts) if len(t) and set_key(t) == keys[i]]  # a repeated id may have another text
            at = pa.array([i for i, _ in found], pa.int64())
            rest = [batch.column(c).take(at) for c in ("key", "root", "blocks")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([t.tobytes() for _, t in found], pa.binary())], ["key", "root", "blocks", "tokens"])

    texts = _among(docs.select(own.alias("doc_id"), "text").filter("doc_id is not null"), members).join(members, "doc_id").select("key", "root", "blocks", "text")
    path = scratch_path(docs.sparkSession, "shingle-sets")
    map_text(texts, run, "key long, root long, blocks long, tokens binary").write.parquet(path)
    sets = docs.sparkSession.read.parquet(path).dropDuplicates(["key"]) if _repeats(docs) else docs.sparkSession.read.parquet(path)
    large = sets.filter("blocks > 1")
    paths = [path]
    if not large.isEmpty():
        paths.append(scratch_path(docs.sparkSession, "shingle-sets"))
        _parted(large, levels, percent).write.parquet(paths[1])
        parted = docs.sparkSession.read.parquet(paths[1])
        sets, large = sets.filter("blocks = 1").unionByName(parted), parted.filter("blocks > 1")

    inside = _blocked(sets, 0).groupBy("root", "block").applyInPandas(_block_links(levels, False, percent), "a long, b long")
    for salt in range(1, ROUNDS + 1):
        inside = inside.unionByName(_blocked(large, salt).groupBy("root", "block").applyInPandas(_block_links(levels, False, percent), "a long, b long"))
    links = cut_lineage(inside)
    sure = cut_lineage(connected(links, "a", "b"))

    # what is still outside its group's largest component meets the whole group
    heads = large.select("key", "root", "blocks").join(sure.select(F.col("node").alias("key"), F.col("root").alias("own")), "key", "left").withColumn("own", F.coalesce("own", "key"))
    counts = heads.groupBy("root", "own").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("root").agg(F.max_by("own", F.struct("m", "own")).alias("main"), (F.sum("m") - F.max("m")).alias("outside"))
    placed = heads.join(main.filter("outside > 0"), "root").select("key", "own", "main", F.greatest(F.ceil(F.col("outside") / BLOCK_ROWS), F.lit(1)).cast("long").alias("parts"))
    held = large.join(placed, "key")
    columns = ["root", "key", "tokens", "row", "col", "side"]
    row, col = F.pmod(F.xxhash64("key", F.lit(-1)), F.col("parts")), F.pmod(F.xxhash64("key", F.lit(-2)), F.col("blocks"))
    outside = held.filter("own <> main").withColumns({"row": row, "col": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "side": F.lit(0)}).select(columns)
    whole = held.withColumns({"col": col, "row": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "side": F.lit(1)}).select(columns)
    across = outside.unionByName(whole).groupBy("root", "row", "col").applyInPandas(_block_links(levels, True, percent), "a long, b long")
    more = cut_lineage(across)
    for done in paths:
        delete(docs.sparkSession, done)
    return connected(links.unionByName(more), "a", "b")


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").limit(1).count() > 0


def labels(docs: DataFrame, words: int, percent: int, nameless: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, t, n, label``, the label common to a component."""
    with shuffles_dropped(docs.sparkSession):
        return _labels(docs, words, percent, nameless)


def _labels(docs: DataFrame, words: int, percent: int, nameless: bool) -> DataFrame:
    keys, table = keyed(docs, words)
    levels = docs.sparkSession.sparkContext.broadcast(table)
    roots = link_classes(docs, keys, levels, words, percent, nameless)
    return cut_lineage(keys.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "t", "n", F.coalesce("root", "key").alias("label")))


def components(docs: DataFrame, words: int = WORDS, percent: int = NUM) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    labelled = labels(docs, words, percent)
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, words: int = WORDS, percent: int = NUM) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id, of several
    texts of that id the one with the smallest hash. Texts without shingles stay, equal ones of an id
    once. Rows without an id connect as others do; besides the named one, one of those in a component
    is kept, and all that have no shingles."""
    found = labels(docs, words, percent, True).withColumn("nameless", F.col("doc_id").isNull())
    linked = found.filter("label is not null").groupBy("label", "nameless").agg(F.min(F.struct("doc_id", "t")).alias("x")).select("x.doc_id", "x.t")
    blank = found.filter("label is null and not nameless").select("doc_id", "t").distinct()
    kept = linked.unionByName(blank).toDF("_kept_id", "_kept_t")
    held = docs.withColumn("_t", F.xxhash64("text"))
    single = held.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_t") == F.col("_kept_t")), "left_semi")
    if _repeats(docs):
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        single = single.groupBy("doc_id", "_t").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return single.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))


def op5_jaccard_join(spark, sf):
    return components(documents(spark, sf))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {}
