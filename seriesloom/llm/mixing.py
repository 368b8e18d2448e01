"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words. A document's expected number of copies is its source's
target over its source's size; the copies are prefix-summed within the source, one random offset is
added, and a document is taken once per integer that its interval crosses. Documents stand in order
of length, so short and long ones are taken evenly and the words taken come near the target.

The sums run in two levels: a source is cut into blocks by length class and id, one row of counts
per block carries the rest. A source that holds a third of all rows is spread over as many tasks as
it has blocks. All sums are whole numbers, so reruns agree.

Null or empty texts have size 0 and share in copies without words; a null source is a source of its
own and the last; repeated rows are documents of their own; an empty table gives no rows. Other
columns are carried by ``mix`` whatever their names and left out by ``taken``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, documents, word_count

UNIT_BITS = 28
SPREAD = 64
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _placed(docs: DataFrame) -> DataFrame:
    """``_mix_size``, ``_mix_text`` (a hash), ``_mix_key`` (the source, never null) and ``_mix_block``
    (length class and id)."""
    size = word_count(F.col("text"))
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SPREAD)), F.lit(0))
    return (
        docs.withColumn("_mix_size", size)
        .withColumn("_mix_text", F.xxhash64("text"))
        .withColumn("_mix_key", _key())
        .withColumn("_mix_block", F.length(F.bin("_mix_size")).cast("long") * SPREAD + salt)
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``. Sources in order of their code
    points, null last, take the weights in turn and share ``share`` times all words; a target stops
    at ``most`` times its source's size and the rest goes to the others by weight.

    In order of size over weight the full sources come first, so the level that the others reach
    is found by one running sum over one row per source."""
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights)) + 1)
    by_fill = Window.partitionBy().orderBy((F.col("_limit") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before, onwards = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(onwards)
    full = F.col("_level") * F.col("_weight") >= F.col("_limit")
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_level", level)
        .withColumn("_reached", F.max(F.when(~full, F.col("_level"))).over(everything))
        .withColumn("target", F.when(full, F.col("_limit")).otherwise(F.col("_reached") * F.col("_weight")).cast("double"))
        .select("source", "source_size", "target")
    )


def _copies(docs: DataFrame, seed: str, drop: Sequence[str] = ()) -> DataFrame:
    """All columns with ``_mix_size``, ``source_size`` and ``target`` (prefixed) and ``_mix_copies``.
    Columns to drop don't travel once the sizes are known."""
    placed = _placed(docs).drop(*drop)
    blocks = placed.groupBy("_mix_key", "_mix_block").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("_n"), F.sum("_mix_size").alias("_words"))
    blocks = cut_lineage(blocks)
    sums = blocks.groupBy("_mix_key").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    goals = targets(sums.select("source", "source_size")).select(
        _key().alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    units = F.coalesce(F.floor(F.try_divide("_mix_target", "_mix_source_size") * F.lit(1 << UNIT_BITS)), F.lit(0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_mix_key")), 1, UNIT_BITS // 4), 16, 10).cast("long")
    earlier = Window.partitionBy("_mix_key").orderBy("_mix_block").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        blocks.join(goals, "_mix_key")
        .withColumn("_mix_units", units)
        .withColumn("_mix_from", start + F.coalesce(F.sum(F.col("_n") * F.col("_mix_units")).over(earlier), F.lit(0)))
        .drop("source", "_n", "_words")
    )
    inside = Window.partitionBy("_mix_key", "_mix_block").orderBy("_mix_size", "doc_id", "_mix_text").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_mix_from") + F.sum("_mix_units").over(inside)
    return placed.join(steps, ["_mix_key", "_mix_block"]).withColumn("_mix_upto", upto).withColumn(
        "_mix_copies", F.shiftright("_mix_upto", UNIT_BITS) - F.shiftright(F.col("_mix_upto") - F.col("_mix_units"), UNIT_BITS)
    )


def taken(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` (words the mix takes of it, repeats counted)."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return _copies(small, seed, ["text"]).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture: every document as often as it is taken, with its own columns."""
    return _copies(docs, seed).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int"))).alias("_mix_copy")).drop("_mix_copy")


def op7_source_mixing(spark, sf):
    return taken(documents(spark, sf))


def taken_sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL, with the columns of ``docs`` and ``copies`` besides."""
    return f"""sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce('s' || source, 'n') AS k FROM {docs}),
placed AS (SELECT *, length(bin(size)) * {SPREAD} + coalesce(((doc_id % {SPREAD}) + {SPREAD}) % {SPREAD}, 0) AS blk FROM sized),
sums AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM placed GROUP BY k),
turns AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % {len(WEIGHTS)})::INT + 1] AS w FROM sums),
levels AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM turns WINDOW o AS (ORDER BY {MOST} * source_size::DOUBLE / w, source NULLS LAST)),
goals AS (SELECT k, source_size, CASE WHEN lvl * w >= {MOST} * source_size THEN ({MOST} * source_size)::DOUBLE
    ELSE w * max(CASE WHEN lvl * w < {MOST} * source_size THEN lvl END) OVER () END AS target FROM levels),
units AS (SELECT *, coalesce(floor(target / nullif(source_size, 0) * {1 << UNIT_BITS}), 0)::BIGINT AS u, ('0x' || substr(md5('mix:' || k), 1, {UNIT_BITS // 4}))::BIGINT AS s FROM goals),
summed AS (SELECT p.*, source_size, target, u, s + (sum(u) OVER (PARTITION BY p.k ORDER BY blk, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
    FROM placed p JOIN units USING (k)),
copied AS (SELECT *, (upto >> {UNIT_BITS}) - ((upto - u) >> {UNIT_BITS}) AS copies FROM summed)"""


QUERIES = {"op7_source_mixing": op7_source_mixing}
ORACLES = {
    "op7_source_mixing": f"WITH {taken_sql()} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM copied"
}
