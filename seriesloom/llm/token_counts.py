"""Exact token counts at every prefix of a text, for a byte-level merge vocabulary.

A text falls into pieces by the vocabulary's splitting pattern; a piece's tokens don't depend on its
neighbours. Within a piece the count of every prefix follows from shorter ones: of all tokens that
end a prefix exactly one fits behind the last token of the rest, so ``count[i] = count[i - len] + 1``.
A token fits if no merge across the seam would have come first. The prefixes of a distinct piece are
counted once per task; a text's counts are theirs, shifted by the tokens before.

What a prefix of the text adds: it may end inside a piece, where the pattern splits what is left of
it in another way. That concerns white space (a run at the end stays whole) and cut contractions;
both are looked up as pieces of their own, so every count is that of the prefix encoded alone.

Null and empty texts have no tokens. The memory of a task is one batch and a table of at most
``KEPT`` pieces, which starts anew when full. Null ids, repeated rows and other columns (whatever
their names) don't matter: each row is counted for itself. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text, slices, text_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
KEPT = 400_000
PART = 65_536
WHITE = regex.compile(r"\s+")


def byte_letters() -> dict[str, int]:
    """Letter to byte, as byte-level vocabularies write them: printable Latin-1 stands for itself,
    the others for the code points from 256 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def in_ascii(pattern: str) -> str:
    """The splitting pattern for texts of ASCII characters only, where the standard module's faster
    matcher can take it."""
    space, letter, digit = r" \t\n\x0b\f\r", "A-Za-z", "0-9"
    whole = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
    return whole.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class PrefixCounter(dict):
    """Piece to the token counts of all its prefixes, by code point: a table filled on demand."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, kept: int = KEPT):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t) and t not in self.special}
        self.fits: dict[int, bool] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            self.rank[a, b] = k
            self.parts.setdefault(self.ids[raw(left) + raw(right)], (a, b, k))
        self.longest = max(map(len, self.ids))
        self.any_split = regex.compile(pattern).findall
        self.ascii_split = re.compile(in_ascii(pattern)).findall
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept = kept

    def joins(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives the two again. Merges are
        undone from the seam outwards, the latest first; a merge over the seam that would have come
        before the one undone last means another result."""
        never = len(self.rank)
        until_a = until_b = never  # the merges that took the present edges away
        while True:
            over = self.rank.get((a, b), never)
            if over < until_a and (over < until_b or over == until_b < never):
                return False
            left, pb = self.parts.get(a), self.parts.get(b)
            if left is None and pb is None:
                return True
            if pb is None or (left is not None and left[2] > pb[2]):
                until_a, a = left[2], left[1]
            else:
                until_b, b = pb[2], pb[0]

    def split(self, text: str) -> list[str]:
        return self.ascii_split(text) if text.isascii() else self.any_split(text)

    def fill(self, pieces: set[str]) -> None:
        """Counts the prefixes of the pieces that the table lacks. In sorted order a piece goes on
        where it parts from the one before: the counts of their common prefix are there already."""
        if len(self) >= self.kept:
            self.clear()
        if len(self.fits) > 2 * self.kept:
            self.fits.clear()
        ids, fits, longest = self.ids.get, self.fits, self.longest
        count, last, before = [0], [0], b""
        for raw, piece in sorted((p.encode("utf-8"), p) for p in pieces.difference(self)):
            same = min(len(raw), len(before))
            while raw[:same] != before[:same]:
                same -= 1
            del count[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):  # the longest token first; only one fits
                    token = ids(raw[start:end])
                    if token is None:
                        continue
                    if start:
                        seam = last[start] << 20 | token
                        fit = fits.get(seam)
                        if fit is None:
                            fit = fits[seam] = self.joins(last[start], token)
                        if not fit:
                            continue
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            before = raw
            # at the ends of code points only
            ends = count[1:] if len(raw) == len(piece) else [c for c, b in zip(count[1:], [*raw[1:], 0]) if b & 0xC0 != 0x80]
            self[piece] = bytes(ends) if max(ends) < 256 else tuple(ends)

    def __missing__(self, piece: str) -> Sequence[int]:
        self.fill({piece})
        return self[piece]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and whether a stretch is a special string (one token)."""
        if self.mark is None or not any(s in text for s in self.special):
            yield text, False
            return
        for i, part in enumerate(self.mark.split(text)):
            if part:
                yield part, bool(i % 2)

    def totals(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each whole text: the count at its last prefix."""
        get = self.__getitem__
        for a, b in slices(texts):
            parts = [[(1 if special else self.split(part)) for part, special in self.segments(t)] for t in texts[a:b]]
            self.fill(set().union(*[p for x in parts for p in x if p != 1]))
            for x in parts:
                yield sum(1 if p == 1 else sum([get(i)[-1] for i in p]) for p in x)

    def prefixes(self, text: str) -> list[int]:
        """Token count of every prefix of 1, 2, ... code points, each as if encoded alone."""
        out: list[int] = []
        white = WHITE.fullmatch
        base, tail = 0, ""
        for part, special in self.segments(text):
            if special:  # until it is complete a special string is plain text behind the last pieces
                rest = base - sum(self[p][-1] for p in self.split(tail))
                out += [rest + sum(self[p][-1] for p in self.split(tail + part[:k])) for k in range(1, len(part))] + [base + 1]
                base, tail = base + 1, ""
                continue
            run, run_base = "", base  # the white space that ends the text so far, and the tokens before it
            pieces = self.split(part)
            tail = "".join(pieces[-3:])
            for piece in pieces:
                counts = self[piece]
                if white(piece[0]):
                    if run:  # the run goes on: as a prefix ends here, it is one piece
                        head = len(WHITE.match(piece)[0])
                        for k in range(1, head + 1):
                            out.append(run_base + self[run + piece[:k]][-1])
                        out += [base + c for c in counts[head:]]
                    else:
                        run_base = base
                        out += [base + c for c in counts]
                    run = run + piece if white(piece) else ""
                else:
                    run = ""
                    if piece[0] == "'" and len(piece) == 3 and piece[1:].isalpha():  # a cut contraction is a mark and a letter
                        out += [base + counts[0], base + counts[0] + self[piece[1]][-1], base + counts[2]]
                    else:
                        out += [base + c for c in counts]
                base += counts[-1]
        return out


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""

    def run(batches):
        counter = PrefixCounter(path)
        for batch in batches:
            texts = text_of(batch.column("text"))
            size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            tokens = pa.array(list(counter.totals(texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long")


def prefix_table(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """``doc_id, first, counts``: the token count of the prefixes of ``first``, ``first + 1``, ...
    code points. A long text has several rows, each with ``part`` counts at most."""

    def run(batches):
        counter = PrefixCounter(path)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_of(batch.column("text"))):
                counts = counter.prefixes(text)
                starts = range(0, len(counts), part)
                if starts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(starts), pa.int64()), pa.array([s + 1 for s in starts], pa.int64()), pa.array([counts[s : s + part] for s in starts], pa.list_(pa.int32()))],
                        ["doc_id", "first", "counts"],
                    )

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, first long, counts array<int>")


def longest_within(prefixes: DataFrame, budget: int) -> DataFrame:
    """From a prefix table: the longest prefix of each document that has ``budget`` tokens at most,
    as ``doc_id, n_chars`` (0: none). Counts may fall as a text grows, so the last one is taken."""
    hit = F.expr(f"aggregate(counts, named_struct('i', 0, 'at', 0), (s, c) -> named_struct('i', s.i + 1, 'at', IF(c <= {int(budget)}, s.i + 1, s.at)), s -> s.at)")
    return prefixes.select("doc_id", F.when(hit > 0, F.col("first") + hit - 1).otherwise(F.lit(0)).alias("_n")).groupBy("doc_id").agg(F.max("_n").alias("n_chars"))


def op4_token_counts(spark, sf):
    counts = count_tokens(documents(spark, sf), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES = {}
