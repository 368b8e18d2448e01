"""Encoding and decoding with a piece model, one distinct chunk at a time.

The model writes a marker for every space and one before the text. Where no piece goes on behind a
marker (checked when the model is loaded), no piece crosses from a letter to a marker, so a text may
be cut before each run of markers. Each distinct chunk, a run of markers with what follows, is
segmented once per task; a text's ids are the chunks' ids joined by position, and an end id. Its
decoded text is joined from the chunks in the same way.

Null and empty texts have the end id only and decode to the empty text. A text without spaces is one
chunk, whatever its length. The memory of a task is one batch and a table of at most ``KEPT`` chunks,
which starts anew when full; longer chunks than ``LONG`` are not kept. Rows are encoded each for
itself, so null ids, repeated rows and other columns (whatever their names) don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text, slices, text_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEPT = 400_000
LONG = 1_000


class Chunks(dict):
    """Chunk to ``(number of ids, ids as decimal text, decoded text)``, filled range by range."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("pieces of this model cross markers")
        self.kept = kept
        self.end = str(self.model.eos_id())
        self.cut = re.compile(f"{MARK}+[^{MARK}]*").findall

    def fill(self, lists: list[list[str]]) -> None:
        """Segments the chunks of these lists that the table lacks, each once. The library puts a
        marker before a text and drops one when it decodes, so a chunk goes in without its first
        marker and comes out behind an extra one."""
        if len(self) >= self.kept:
            self.clear()
        new = list(set().union(*lists).difference(self))
        mark = self.model.piece_to_id(MARK)
        ids = [x or [mark] for x in self.model.encode([c[1:] for c in new], num_threads=1)]
        texts = self.model.decode([[mark, *x] for x in ids], num_threads=1)
        self.update(zip(new, zip(map(len, ids), [" ".join(map(str, x)) for x in ids], texts)))

    def chunks(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def found(self, texts: list[str]) -> Iterator[tuple[tuple[int, ...], tuple[str, ...], tuple[str, ...]]]:
        """Per text, chunk by chunk: numbers of ids, ids as text, decoded texts."""
        for a, b in slices(texts):
            lists = [self.chunks(t) for t in texts[a:b]]
            self.fill(lists)
            for chunks in lists:
                yield tuple(zip(*map(self.__getitem__, chunks))) or ((), (), ())
            if any(len(t) > LONG for t in texts[a:b]):
                for chunk in [c for c in self if len(c) > LONG]:
                    del self[chunk]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """All ids of each text, the end id last, and the decoded text."""
        for _, ids, back in self.found(texts):
            yield [int(i) for x in ids for i in x.split(" ")] + [self.model.eos_id()], "".join(back)[1:]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, hash of the ids, hash of the decoded text, of each text."""
        for sizes, ids, back in self.found(texts):
            yield (
                1 + sum(sizes),
                hashlib.sha256(" ".join((*ids, self.end)).encode("ascii")).hexdigest(),
                hashlib.sha256("".join(back)[1:].encode("utf-8")).hexdigest(),
            )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: all ids of every whole text and the text they give back."""

    def run(batches):
        table = Chunks(path)
        for batch in batches:
            for doc_id, (ids, back) in zip(batch.column("doc_id").to_pylist(), table.encode(text_of(batch.column("text")))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([back], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, kept: int = KEPT) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, without keeping the ids.
    ``kept``: chunks in a task's table."""

    def run(batches):
        table = Chunks(path, kept)
        for batch in batches:
            columns = list(zip(*table.digests(text_of(batch.column("text"))))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_pieces(spark, sf):
    return encode_digests(documents(spark, sf), public_tokenizers.path(MODEL))


QUERIES = {"op6_pieces": op6_pieces}
ORACLES = {}
