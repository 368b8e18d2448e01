"""Shared pieces of the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table

SPACE = r"\x20\x09-\x0D"
#: a word is a run of characters other than the space and the control characters 9 to 13
WORD = f"[^{SPACE}]+"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def word_count(text: Column) -> Column:
    """Number of words, without building a list of them; null counts 0."""
    marks = F.regexp_replace(text, f"[{SPACE}]*{WORD}", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\f\r"))), F.lit(0)).cast("long")


def map_text(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through ``fn``; the partitions stay as they are."""
    return df.mapInArrow(fn, schema)


def text_of(column: pa.Array) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def each_text(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The same texts one by one; only so many rows are strings at a time."""
    for at in range(0, len(column), rows):
        yield from text_of(column.slice(at, rows))


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a batch, closed once their texts reach ``chars``: what is built from
    one range stays small whatever the batch holds (one long text is a range of its own)."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learns(doc_id: Column, held_out: int) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 5, is not
    ``held_out``. A document without an id is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != held_out, F.lit(True))


LINKS = 1 << 21  # links that a task contracts at a time


def smallest(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links contracted to stars: every node that is not the smallest of what it hangs together with, and
    that smallest node."""
    nodes, place = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    i, j = place[: len(lo)], place[len(lo) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[i], up[j])
        new = up.copy()
        for end in (i, j, up[i], up[j]):
            np.minimum.at(new, end, low)
        while ((jump := new[new]) != new).any():
            new = jump
        if (new == up).all():
            break
        up = new
    some = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[some]], nodes[some]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of a task's links, of so many at a time; what is left of one block meets the next."""
    lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stars():
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])

    for batch in batches:
        lo, hi = (np.concatenate([held, batch.column(c).to_numpy()]) for held, c in ((lo, "lo"), (hi, "hi")))
        if len(lo) >= LINKS:
            lo, hi = smallest(lo, hi)
            if 2 * len(lo) >= LINKS:  # hardly anything hangs together
                yield stars()
                lo, hi = lo[:0], hi[:0]
    if len(lo):
        lo, hi = smallest(lo, hi)
        yield stars()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest id reachable from every node of ``edges`` that is not itself the smallest: ``(node, root)``.

    Every task first contracts the links it holds to stars. They are written, packed into as many
    partitions as their number asks for, and contracted again. Where one partition holds what is left, that
    is the result. Else two joins follow (large star, small star: every node hands its smallest neighbour to
    the others; rows per node stay bounded by its own links), and so on until nothing changes. Every round is
    a written table, so lost executors cost one round; the one before it is deleted. No links: no rows."""
    spark, old = edges.sparkSession, []

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        path = scratch_path(spark, "links")
        df.mapInArrow(_contracted, "lo long, hi long").write.parquet(path)
        old.append(path)
        for gone in old[:-2]:
            delete(spark, gone)
        del old[:-2]
        stored = spark.read.schema("lo long, hi long").parquet(path)
        return stored, stored.count()

    links, n = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo <> hi"))
    while True:
        parts = max(1, -(-n // LINKS))
        if parts == 1:
            links, n = written(links.coalesce(1))
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        links, n = written(links.coalesce(parts))
        both = links.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(links.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        large = both.filter("m > n").join(low, "n").select(F.col("low").alias("lo"), F.col("m").alias("hi"))
        large = large.filter("lo <> hi").distinct()
        # small star: neighbours below a node, and the node, move to the smallest of them
        down = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(down, "hi")
        moved = small.select(F.col("low").alias("lo"), F.col("hi")).unionByName(small.filter("lo <> low").select(F.col("low").alias("lo"), F.col("lo").alias("hi"))).distinct()
        if _stars(links):
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        links, n = written(moved)


def _stars(links: DataFrame) -> bool:
    """Whether every link leads from a node to the smallest one: no node twice above, none above and below."""
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("above")).unionByName(links.select(F.col("lo").alias("n"), F.lit(0).alias("above")))
    odd = ends.groupBy("n").agg(F.sum("above").alias("above"), F.count(F.lit(1)).alias("all")).filter("above > 1 or (above = 1 and all > 1)")
    return odd.limit(1).count() == 0


def delete(spark: SparkSession, path: str) -> None:
    """A written table of this library that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def once(fn):
    """One call per argument tuple within a task's process."""
    return functools.lru_cache(maxsize=4)(fn)
