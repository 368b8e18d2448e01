"""Removal of long byte strings that occur more than once, by external induced sorting of suffixes.

A byte goes where a string of ``length`` bytes that covers it also starts anywhere else, in the same
text or another; strings never cross texts. A suffix array of everything would sort every position
of every text. Only suffixes that can have a common prefix of ``length`` bytes are sorted here:

1. Seeds: in each string the run of ``gram`` bytes with the smallest hash is its seed (the first, of equal
   ones), chosen by content alone, so equal strings have equal seeds at equal places. Consecutive
   strings with one seed are a window, about one per hundred bytes.
2. Equal windows (content and place of the seed) are one class; strings of a class with two members
   are repeated. A task passes on two members of a class at most to the shuffle.
3. Classes of one seed are a group, aligned by it, and their suffixes are sorted by induction, from the
   last column to the first: the order of the suffixes that start in a column, with the prefix
   lengths common to neighbours, induces that of the column before. A queue takes one tuple per suffix
   (group, byte, order so far) with its common prefix and gives them back in order. The
   queue's sorted runs and the columns' bytes go to files in the shared folder once a task holds more
   than ``HELD`` tuples or bytes of them; runs are merged in blocks, so a shard may be
   far larger than memory. Neighbours with ``length`` bytes in common are repeated strings.
4. A group of more than ``LIMIT`` classes is not left to one task: its strings are parted by the place of
   their seed into two halves, the halves keyed anew by the bytes common to all their strings, and
   classes found again, recursively. At one place the key is the whole string.

So the suffix array comes in aligned pieces, without the types and reduced strings of a sort of all
suffixes. Seeds and classes are told apart by 64-bit hashes (equal seed hashes of different bytes are
harmless; a class needs a clash of both).

Null and empty texts have no bytes. Texts are known by id and a hash of the text; repeated rows count as
texts of their own that repeat each other, rows without an id likewise. Texts of any length are read a
slice at a time. Other columns, whatever their names, are left out. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import scratch_path
from .common import documents, map_text

LENGTH = 200
SLICE, PLACE_BITS = 1 << 20, 21
SEEN = 1 << 20  # classes a task remembers before it starts anew
LIMIT, SHARD = 16_384, 65_536
HELD = 1 << 27  # bytes of a task's queue and columns kept in memory
BLOCK = 1 << 17  # tuples induced at a time
SEED = 0x9E3779B97F4A7C15

WINDOWS = "h long, c long, row long, t int, start long, strings int, at int, known boolean"


def gram_size(length: int) -> int:
    return max(1, length * 4 // 25)


# ---- seeds and windows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Seeds:
    """Hashes of all runs of bytes of a slice, and the seed of every string."""

    def __init__(self, length: int):
        self.length, self.gram = length, gram_size(length)
        self.width = length - self.gram + 1  # runs in a string
        size = 1 << PLACE_BITS
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
        self.powers, self.inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (SEED, pow(SEED, -1, 1 << 64)))

    def hashes(self, b: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.bytes[b] * self.powers[: len(b)], out=sums[1:])
        n = len(b) - self.gram + 1
        return _mix((sums[self.gram :] - sums[:n]) * self.inverse[:n])

    def places(self, h: np.ndarray) -> np.ndarray:
        """Of every string's first byte: where its seed starts."""
        bits, w, n = np.uint64(PLACE_BITS), self.width, len(h)
        key = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
        whole = np.concatenate([key, np.full(-n % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
        left = np.minimum.accumulate(whole, axis=1).ravel()
        right = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)

    def windows(self, pieces: list[tuple[int, int, bytes]]):
        """``(h, piece, start, strings, at, content)`` of pieces of texts laid side by side."""
        raw = b"".join(p for _, _, p in pieces)
        b = np.frombuffer(raw, np.uint8)
        if len(b) < self.length:
            return
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        h = self.hashes(b)
        place = self.places(h)
        inside = np.arange(len(place)) + self.length <= np.repeat(ends, sizes)[: len(place)]
        change = place[1:] != place[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= change | ~inside[:-1]
        last[:-1] &= change | ~inside[1:]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        owner = np.searchsorted(ends, first, side="right")
        start = first - (ends - sizes)[owner]
        groups = h[place[first]].astype(np.int64).tolist()
        for g, o, s, a, z, p in zip(groups, owner.tolist(), start.tolist(), first.tolist(), last.tolist(), place[first].tolist()):
            yield g, o, s, z - a + 1, p - a, raw[a : z + self.length]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def content_hash(content: bytes, at: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(content, at))


class Sightings:
    """Passes on two windows of a class; later ones are known to be repeated."""

    def __init__(self):
        self.seen: dict[int, int] = {}

    def known(self, c: int) -> bool:
        n = self.seen.get(c, 0)
        if n == 2:
            return True
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen[c] = n + 1
        return False


def texts(docs: DataFrame) -> DataFrame:
    """``row, t, named, text`` (bytes): what a text is known by, and whether ``row`` is its id."""
    plain, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    known = F.coalesce(doc_id, F.xxhash64(plain)).alias("row"), F.hash(plain).alias("t"), doc_id.isNotNull().alias("named")
    return docs.select(*known, F.encode(plain, "UTF-8").alias("text"))


def _batch(rows: list[tuple], schema: str, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split(" ")[0] for c in schema.split(", ")])


WINDOW_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``WINDOWS`` of all texts. Known windows next to each other in a text are one."""

    def run(batches):
        seeds, sightings = Seeds(length), Sightings()

        def flush(pieces):
            out, held = [], None
            for h, o, s, strings, at, content in seeds.windows(pieces):
                (row, t), start = pieces[o][0], pieces[o][1] + s
                c = content_hash(content, at)
                if not sightings.known(c):
                    out.append((h, c, row, t, start, strings, at, False))
                elif held is not None and held[2:4] == (row, t) and held[4] + held[5] == start:
                    held = (*held[:5], held[5] + strings, *held[6:])
                else:
                    if held is not None:
                        out.append(held)
                    held = (h, c, row, t, start, strings, at, True)
            return out + [held] * (held is not None)

        pieces, size = [], 0
        for batch in batches:
            for row, t, text in zip(batch.column("row").to_pylist(), batch.column("t").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                if raw.size < length:
                    continue
                for a in range(0, raw.size - length + 1, SLICE):
                    piece = raw.slice(a, min(SLICE + length - 1, raw.size - a)).to_pybytes()
                    if pieces and size + len(piece) >= SLICE:
                        if out := flush(pieces):
                            yield _batch(out, WINDOWS, WINDOW_TYPES)
                        pieces, size = [], 0
                    pieces.append(((row, t), a, piece))
                    size += len(piece)
        if pieces and (out := flush(pieces)):
            yield _batch(out, WINDOWS, WINDOW_TYPES)

    return map_text(texts(docs), run, WINDOWS)


def classes(rows: DataFrame) -> DataFrame:
    """Rows with ``h, c, known`` to the same with ``twin`` (some other row has the same class) and
    ``lead`` (one row of each class): neighbours in a shuffle by class; known rows are spread."""
    keys = ["h", "c", "known"]
    salt = F.when(F.col("known"), F.xxhash64("row", "start")).otherwise(F.lit(0).cast("long"))
    dealt = rows.withColumn("salt", salt).repartition("h", "c", "salt").sortWithinPartitions(*keys).drop("salt")

    def run(batches):
        held, before = None, None  # the last row waits for the next; the class before it

        def marked(table, after):
            nonlocal before
            h, c, known = (table.column(x).to_numpy(zero_copy_only=False) for x in keys)
            nxt = np.append((h[1:] == h[:-1]) & (c[1:] == c[:-1]), after is not None and (h[-1], c[-1]) == after)
            prev = np.insert(nxt[:-1], 0, before is not None and (h[0], c[0]) == before)
            before = h[-1], c[-1]
            twin, lead = prev | nxt | known, ~prev & ~known
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(twin), pa.array(lead)], [*table.schema.names, "twin", "lead"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield marked(held, (batch.column("h")[0].as_py(), batch.column("c")[0].as_py()))
            if batch.num_rows > 1:
                body, last = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
                yield marked(body, (last.column("h")[0].as_py(), last.column("c")[0].as_py()))
                held = last
            else:
                held = batch
        if held is not None:
            yield marked(held, None)

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField("twin", BooleanType()), StructField("lead", BooleanType())]))


# ---- induced sorting


class Spool:
    """Arrays kept in memory up to ``held`` bytes in all, further ones in files below ``folder``."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held, self.size, self.store, self.stored = folder, held, 0, None, 0

    def add(self, array: np.ndarray):
        if self.size + array.nbytes <= self.held:
            self.size += array.nbytes
            return array
        if self.store is None:
            address = self.folder if "://" in self.folder or self.folder.startswith("file:") else None
            self.store, root = fs.FileSystem.from_uri(address) if address else (fs.LocalFileSystem(), self.folder)
            self.root = f"{root}/{uuid.uuid4().hex}"
            self.store.create_dir(self.root, recursive=True)
        self.stored += 1
        path = f"{self.root}/{self.stored}"
        with self.store.open_output_stream(path, compression=None) as out:
            out.write(array.tobytes())
        return path, array.dtype, len(array)

    def part(self, kept, a: int, b: int) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            return kept[a:b]
        path, dtype, n = kept
        b = min(b, n)
        with self.store.open_input_file(path) as source:
            return np.frombuffer(source.read_at(max(0, b - a) * dtype.itemsize, a * dtype.itemsize), dtype)

    def drop(self, kept) -> None:
        if isinstance(kept, np.ndarray):
            self.size -= kept.nbytes
        else:
            self.store.delete_file(kept[0])

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.root)


TUPLE = np.dtype([("key", np.int64), ("suffix", np.int32), ("common", np.uint16)])


class Queue:
    """Suffix tuples in order of their keys; equal keys in the order in which they came."""

    def __init__(self, spool: Spool):
        self.spool, self.runs = spool, []

    def push(self, run: np.ndarray) -> None:
        """A run of tuples, sorted."""
        self.runs.append((self.spool.add(run), len(run)))

    def pop(self, size: int) -> Iterator[np.ndarray]:
        """All tuples in order, in blocks; runs are read a share at a time and dropped at the end."""
        at = [0] * len(self.runs)
        share = max(1, size // max(1, len(self.runs)))
        while live := [r for r, (_, n) in enumerate(self.runs) if at[r] < n]:
            heads = {r: self.spool.part(self.runs[r][0], at[r], at[r] + share) for r in live}
            unread = [heads[r]["key"][-1] for r in live if at[r] + len(heads[r]) < self.runs[r][1]]
            if len(live) == 1 or not unread:
                cuts = {r: len(heads[r]) for r in live}
            else:  # what is below every run's unread rows
                cuts = {r: int(np.searchsorted(heads[r]["key"], min(unread))) for r in live}
                if not any(cuts.values()):  # rows of one key, the earliest run's first
                    r = next(r for r in live if heads[r]["key"][0] == min(unread))
                    cuts = {r: int(np.searchsorted(heads[r]["key"], min(unread), side="right"))}
            parts = []
            for r, n in cuts.items():
                parts.append(heads[r][:n])
                at[r] += n
            block = np.concatenate(parts)
            yield block[np.argsort(block["key"], kind="stable")] if len(parts) > 1 else block
        for kept, _ in self.runs:
            self.spool.drop(kept)


class Lowest:
    """Smallest of a range of an array, for many ranges."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over ``first .. last``, both included."""
        step = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        while len(self.levels) <= step.max(initial=0):
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-half], x[half:]))
        out = np.empty(len(first), self.levels[0].dtype)
        for s in np.unique(step):
            i = np.flatnonzero(step == s)
            out[i] = np.minimum(self.levels[s][first[i]], self.levels[s][last[i] - (1 << int(s)) + 1])
        return out


class Shard:
    """Windows of whole groups, in order of their groups; ``repeated`` sorts their suffixes."""

    def __init__(self, length: int, spool: Spool):
        self.length, self.spool = length, spool
        self.reach = length - gram_size(length)  # columns before the seed
        self.columns, self.strips = self.reach + length, []
        self.group, self.low, self.high = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32))

    def add(self, group: np.ndarray, low: np.ndarray, strings: np.ndarray, contents: list[bytes]) -> None:
        """``low``: where, from the seed, the first string starts (not after it)."""
        n, size = len(contents), np.array([len(c) for c in contents], np.int64)
        where = np.arange(n) * self.columns + self.reach + low
        flat = np.zeros(n * self.columns, np.uint8)
        before = np.cumsum(size) - size
        flat[np.repeat(where - before, size) + np.arange(size.sum())] = np.frombuffer(b"".join(contents), np.uint8)
        self.strips.append((self.spool.add(np.ascontiguousarray(flat.reshape(n, self.columns).T).ravel()), n))
        self.group = np.concatenate([self.group, group.astype(np.int32)])
        self.low = np.concatenate([self.low, low.astype(np.int32)])
        self.high = np.concatenate([self.high, (low + strings - 1).astype(np.int32)])

    def column(self, x: int) -> np.ndarray:
        """One more than each window's byte in a column, 0 where it has none."""
        i = x + self.reach
        code = np.concatenate([self.spool.part(s, i * n, (i + 1) * n) for s, n in self.strips]).astype(np.uint16) + 1
        code[(x < self.low) | (x >= self.high + self.length)] = 0
        return code

    def induced(self, after: Iterator[np.ndarray], x: int) -> Queue:
        """The queue of a column from the sorted suffixes of the next one."""
        queue, code = Queue(self.spool), self.column(x)
        group_now, since = -1, np.full(257, -1, np.int64)  # common since a byte's last tuple; -1: none
        for block in after:
            suffix, common = block["suffix"], block["common"]
            group = self.group[suffix].astype(np.int64)
            key = (group << 9) | code[suffix]
            by = np.argsort(key, kind="stable")
            sorted_key = key[by]
            lowest, same = Lowest(common), np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
            out = np.zeros(len(block), TUPLE)
            out["key"], out["suffix"] = sorted_key, suffix[by]
            found = np.zeros(len(block), np.int64)
            found[same] = lowest.of(by[same - 1] + 1, by[same]).astype(np.int64) + 1
            # tuples that follow one of an earlier block of their group
            firsts = np.flatnonzero(np.insert(sorted_key[1:] != sorted_key[:-1], 0, True))
            if group[0] == group_now:
                mine = firsts[(sorted_key[firsts] >> 9) == group_now]
                held, here = since[sorted_key[mine] & 511], np.minimum.accumulate(common)[by[mine]]
                found[mine] = np.where(held >= 0, np.minimum(held, here) + 1, 0)
            found[(sorted_key & 511) == 0] = 0
            out["common"] = np.minimum(found, self.length)
            queue.push(out)
            if group[-1] != group_now:
                group_now, since = int(group[-1]), np.full(257, -1, np.int64)
            since[since >= 0] = np.minimum(since[since >= 0], int(common.min()))
            lasts = np.append(firsts[1:] - 1, len(by) - 1)
            lasts = lasts[(sorted_key[lasts] >> 9) == group_now]
            onwards = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint16(self.length))
            since[sorted_key[lasts] & 511] = onwards[by[lasts] + 1]
        return queue

    def watched(self, blocks: Iterator[np.ndarray], found: np.ndarray) -> Iterator[np.ndarray]:
        """Marks the suffixes with a neighbour that has a whole string in common."""
        before = None
        for block in blocks:
            long = np.flatnonzero(block["common"] >= self.length)
            found[block["suffix"][long]] = True
            found[block["suffix"][long[long > 0] - 1]] = True
            if len(long) and long[0] == 0:
                found[before] = True
            before = block["suffix"][-1]
            yield block

    def repeated(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(window, first, last)``: runs of strings, by their place from the seed, that another
        window of the group has too."""
        n = len(self.group)
        opened, was = np.zeros(n, np.int32), np.zeros(n, bool)
        start = np.zeros(n, TUPLE)
        start["suffix"] = np.arange(n)  # behind all bytes nothing is common, and windows stand by group
        start["key"] = self.group.astype(np.int64) << 9
        queue = Queue(self.spool)
        for a in range(0, n, BLOCK):
            queue.push(start[a : a + BLOCK])
        for x in range(self.length - 1, -self.reach - 2, -1):
            found = np.zeros(n, bool)  # strings that start in the column just sorted, x + 1
            blocks = self.watched(queue.pop(BLOCK), found)
            if x >= -self.reach:
                queue = self.induced(blocks, x)
            else:
                for _ in blocks:
                    pass
            if (done := np.flatnonzero(was & ~found)).size:
                yield done, np.full(len(done), x + 2, np.int32), opened[done]
            opened[found & ~was] = x + 1
            was = found
        if (done := np.flatnonzero(was)).size:
            yield done, np.full(len(done), -self.reach, np.int32), opened[done]
        for strip, _ in self.strips:
            self.spool.drop(strip)


# ---- jobs

CONTENTS = "h long, row long, t int, start long, strings int, at int, content binary"
SPANS = "row long, t int, first long, last long"


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``CONTENTS`` of windows, cut out of their texts; one row per text meets it."""
    lists = wanted.groupBy("row", "t").agg(F.collect_list(F.struct("h", "start", "strings", "at", "size")).alias("windows"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        seen: set = set()  # repeated rows give their windows once
        for batch in batches:
            out, held = [], 0
            for row, t, text, asked in zip(batch.column("row").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("windows").to_pylist()):
                if (row, t) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add((row, t))
                raw = text.as_buffer()
                for w in asked:
                    out.append((w["h"], row, t, w["start"], w["strings"], w["at"], raw.slice(w["start"], w["size"]).to_pybytes()))
                    held += w["size"]
                    if held > SLICE:
                        yield _batch(out, CONTENTS, types)
                        out, held = [], 0
            if out:
                yield _batch(out, CONTENTS, types)

    return map_text(texts(docs).join(lists, ["row", "t"]), run, CONTENTS)


def sorted_spans(windows: DataFrame, length: int, shards: int, folder: str) -> DataFrame:
    """``SPANS`` of the repeated strings among ``CONTENTS``, group by group."""
    dealt = windows.repartition(max(1, shards), "h").sortWithinPartitions("h", "row", "t", "start")

    def run(batches):
        spool = Spool(folder, HELD)
        shard, names, last, count = Shard(length, spool), [], None, -1
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "row", "t", "start", "strings", "at")]
            if not batch.num_rows:
                continue
            h = columns[0]
            copy = np.zeros(len(h), bool)  # a row twice is no repeat
            same = np.insert(h[1:] != h[:-1], 0, h[0] != last)
            group = count + np.cumsum(same)
            identity = np.stack(columns[:4], 1)
            copy[1:] = (identity[1:] == identity[:-1]).all(1)
            if names:
                copy[0] = tuple(identity[0]) == tuple([last, *(c[-1] for c in names[-1][:3])])
            last, count = h[-1], int(group[-1])
            some = np.flatnonzero(~copy)
            texts_here = batch.column("content").take(pa.array(some)).to_pylist()
            if not len(some):
                continue
            shard.add(group[some], -columns[5][some].astype(np.int64), columns[4][some].astype(np.int64), texts_here)
            names.append([c[some] for c in columns[1:4]])
        try:
            if names:
                row, t, start = (np.concatenate([n[i] for n in names]) for i in range(3))
                for window, first, final in shard.repeated():
                    base = start[window] - shard.low[window]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[window]), pa.array(t[window], pa.int32()), pa.array(base + first), pa.array(base + final + length)], ["row", "t", "first", "last"]
                    )
        finally:
            spool.close()

    return dealt.mapInArrow(run, SPANS)


def halves(rows: DataFrame, length: int) -> DataFrame:
    """Windows (``CONTENTS`` with ``least, most``, the places of their groups' strings) as windows of
    either half of those places, keyed by the bytes common to a half's strings."""

    def run(batches):
        sightings = Sightings()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle = (r["least"] + r["most"]) // 2
                for least, most in ((r["least"], middle), (middle + 1, r["most"])):
                    low, high = max(-r["at"], least), min(r["strings"] - 1 - r["at"], most)
                    if low > high:
                        continue
                    content = r["content"][low + r["at"] : high + r["at"] + length]
                    common = content[most - low : least + length - low]
                    h = _signed(xxhash.xxh3_64_intdigest(common, xxhash.xxh3_64_intdigest(f"{r['h']}:{least}:{most}".encode())))
                    c = content_hash(content, -low)
                    out.append((h, c, r["row"], r["t"], r["start"] + low + r["at"], high - low + 1, -low, sightings.known(c), content, least, most))
            if out:
                yield _batch(out, HALVES, [*WINDOW_TYPES, pa.binary(), pa.int32(), pa.int32()])

    return rows.select(*(c.split(" ")[0] for c in CONTENTS.split(", ")), "least", "most").mapInArrow(run, HALVES)


HALVES = WINDOWS + ", content binary, least int, most int"


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``SPANS``: ranges of bytes covered by repeated strings, of all texts; ranges may overlap."""
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"suffix-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def covered(df: DataFrame) -> DataFrame:
        return df.filter("twin").select("row", "t", F.col("start").alias("first"), (F.col("start") + F.col("strings") - 1 + length).alias("last"))

    def crowded(leads: DataFrame, name: str) -> DataFrame:
        return kept(leads.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name)

    folder = scratch_path(spark, "suffix-queues")
    marked = kept(classes(windows(docs, length)), "windows")
    leads = marked.filter("lead")
    groups = crowded(leads, "groups")
    wanted = leads.join(groups, "h").withColumn("size", F.col("strings") - 1 + length)
    held = kept(contents(docs, wanted), "contents")
    out, level = covered(marked), 0
    most = groups.agg(F.max("n"), F.sum("n")).first()
    gram = gram_size(length)
    held = held.withColumns({"least": F.lit(gram - length), "most": F.lit(0)})
    while most[0] is not None:
        if most[0] <= LIMIT:
            return out.unionByName(sorted_spans(held, length, math.ceil(most[1] / SHARD), folder))
        sized = held.join(groups, "h")
        small, large = sized.filter(F.col("n") <= LIMIT).drop("n"), sized.filter(F.col("n") > LIMIT).drop("n")
        out = out.unionByName(sorted_spans(small, length, math.ceil(most[1] / SHARD), folder))
        level += 1
        marked = kept(classes(halves(large, length)), f"windows-{level}")
        out = out.unionByName(covered(marked))
        groups = crowded(marked.filter("lead"), f"groups-{level}")
        held = marked.filter("lead").join(groups.select("h"), "h", "left_semi").drop("c", "known", "twin", "lead")
        most = groups.agg(F.max("n"), F.sum("n")).first()
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, the removed ranges (``spans``: disjoint, in order) and
    the ``kept`` bytes, which may start or end inside a character."""
    lists = spans(docs, length).groupBy("row", "t").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    path = scratch_path(docs.sparkSession, "suffix-spans")
    lists.write.parquet(path)
    lists = docs.sparkSession.read.parquet(path)
    schema = "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary"
    pair = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for name, doc_id, text, found in zip(batch.column("named").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), batch.column("found").to_pylist()):
                raw = text.as_buffer()
                joined: list[list[int]] = []
                for x in sorted((f["first"], f["last"]) for f in found or ()):
                    if joined and x[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], x[1])
                    else:
                        joined.append(list(x))
                rest, at = [], 0
                for first, last in [*joined, [raw.size, raw.size]]:
                    rest.append(raw.slice(at, first - at).to_pybytes())
                    at = last
                out.append((doc_id if name else None, raw.size, [{"first": a, "last": b} for a, b in joined], b"".join(rest)))
                size += raw.size
                if size > 8 * SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pair, pa.binary()))], ["doc_id", "n_bytes", "spans", "kept"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pair, pa.binary()))], ["doc_id", "n_bytes", "spans", "kept"])

    rows = texts(docs).join(lists, ["row", "t"], "left")
    return rows.select("row", "named", "text", "found").mapInArrow(run, schema)


def op12_suffix_dedup(spark, sf):
    found = without_repeats(documents(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
ORACLES = {}
