"""Near-duplicate vectors by Euclidean hashing with an exact cosine check.

Vectors are brought to length one, projected on random directions, shifted and cut into steps: the
numbers of ``KEYS`` projections are a bucket in one of ``TABLES`` tables. At a cosine of 0.98 two
vectors are 0.2 apart, a fifth of a step, and meet in some table with a probability of 0.99; the
tests measure the recall. Pairs of a bucket are checked by their cosine in double precision.

Equal vectors of a label are one class, with its number of rows, before anything is paired. A bucket
is cut into blocks of about ``BLOCK`` classes and its pairs are checked block against block, so no
task holds a whole bucket. A pair counts in the first table where it meets, so links are counted
without being listed: a block gives each class a number of links, and a spanning tree.

Vectors that are null, of length zero, or with null or non-finite components link with nothing, nor do
rows without a label. Repeated rows are rows of one class. A row without an id takes part and has its
component's smallest id; it is not kept. Vectors of different lengths are never linked. Classes are
told apart by 64-bit hashes. Other columns, whatever their names, are left out. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .common import connected
from .vectors import usable

LEAST = 0.98
TABLES, KEYS, STEP, SEED = 24, 10, 1.0, 7
BLOCK = 1_024


def directions(size: int, tables: int = TABLES, keys: int = KEYS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([seed, size])
    return draw.standard_normal((size, tables * keys)), draw.uniform(0, STEP, tables * keys)


def units(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors]) if not isinstance(vectors, np.ndarray) or vectors.dtype == object else vectors
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def buckets(v: np.ndarray, labels) -> np.ndarray:
    """Bucket of every vector (of one length, length one) in every table, as a 64-bit hash with the label."""
    way, shift = directions(v.shape[1])
    cells = np.floor((v @ way + shift) / STEP).astype(np.int32).reshape(len(v), TABLES, KEYS)
    out = np.zeros((len(v), TABLES), np.uint64)
    for i, label in enumerate(labels):
        mark = f"{label}:{v.shape[1]}:".encode()
        for t in range(TABLES):
            out[i, t] = xxhash.xxh3_64_intdigest(mark + bytes([t]) + cells[i, t].tobytes())
    return out.astype(np.int64)


def classes(df: DataFrame) -> DataFrame:
    """``node, vector, label, m, least, keys``: distinct vectors per label, with their buckets."""
    rows = df.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.first("label").alias("label"), F.count(F.lit(1)).alias("m"))

    def run(frames):
        for pdf in frames:
            pdf = pdf.reset_index(drop=True)
            keys = pd.Series([None] * len(pdf), dtype=object)
            for _, part in pdf.groupby(pdf["vector"].map(len)):
                for at, k in zip(part.index, buckets(units(part["vector"]), part["label"])):
                    keys[at] = k.tolist()
            yield pdf.assign(keys=keys)

    return rows.mapInPandas(run, "node long, vector array<double>, label string, m long, keys array<long>")


def _segment(v: np.ndarray, keys: np.ndarray, m: np.ndarray, node: np.ndarray, own: np.ndarray, t: int, one: int, two: int, least: float):
    """Of one pair of blocks of a bucket: how many rows each class links with by pairs that first
    meet here, and a class of its tree."""
    v = units(v)
    a, b = np.flatnonzero(own == one), np.flatnonzero(own == two)
    i, j = np.nonzero(v[a] @ v[b].T >= least)
    i, j = a[i], b[j]
    fresh = (node[i] != node[j]) & ((keys[i, :t] == keys[j, :t]).sum(1) == 0)
    if one == two:
        fresh &= i < j
    i, j = i[fresh], j[fresh]
    if not len(i):
        return None
    count, up = np.zeros(len(v), np.int64), np.arange(len(v))
    np.add.at(count, i, m[j])
    np.add.at(count, j, m[i])
    while True:
        new = up.copy()
        np.minimum.at(new, i, up[j])
        np.minimum.at(new, j, up[i])
        new = new[new]
        if (new == up).all():
            break
        up = new
    some = np.flatnonzero(count)
    return node[some], count[some], node[up[some]]


def _links(least: float):
    """Over rows sorted by bucket and block pair; one such segment is held at a time."""

    def run(batches):
        def found(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
            node, own, m, t, one, two = (table.column(c).to_numpy() for c in ("node", "own", "m", "t", "one", "two"))
            lists = table.column("vector").combine_chunks()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy()
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    v = flat[at[a] : at[b]].reshape(b - a, -1)
                    out.append(_segment(v, keys[a:b], m[a:b], node[a:b], own[a:b], int(t[a]), one[a], two[a], least))
            out = [x for x in out if x is not None]
            if out:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "links", "other"])
            return None

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            by = [table.column(c).to_numpy() for c in ("t", "bucket", "one", "two")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in by], axis=0)) + 1
            cuts = np.concatenate([[0], change])
            if len(cuts) > 1 and (rows := found(table, cuts)) is not None:
                yield rows
            held = table.slice(int(cuts[-1]))
        if held is not None and held.num_rows and (rows := found(held, np.array([0, held.num_rows]))) is not None:
            yield rows

    return run


def near_duplicates(df: DataFrame, vec_id: str, vector: str, label: str, least: float = LEAST) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    ready = usable(F.col(vector)) & F.col(label).isNotNull() & F.exists(F.col(vector), lambda x: x != 0)
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(ready, v).alias("vector"),
        F.col(label).cast("string").alias("label"),
    ).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    known = cut_lineage(classes(rows))
    placed = known.select("node", F.posexplode("keys").alias("t", "bucket"))
    full = placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("t", "bucket", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    met = placed.join(full, ["t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("t", "bucket", "own", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "node").join(known.select("node", "vector", "keys", "m"), "node")
    segment = ["t", "bucket", "one", "two"]
    links = cut_lineage(met.repartition(*segment).sortWithinPartitions(*segment).mapInArrow(_links(least), "node long, links long, other long"))
    roots = connected(links, "node", "other")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = known.select("node", "m").join(counts, "node", "left").join(roots, "node", "left")
    found = found.select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    labelled = cut_lineage(rows.select("vec_id", "node").join(found, "node", "left"))
    smallest = labelled.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = labelled.join(smallest, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_near_vectors(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


QUERIES = {"op10_near_vectors": op10_near_vectors}
ORACLES = {}
