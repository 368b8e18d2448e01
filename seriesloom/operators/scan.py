"""Two-level scans for groups of any size.

A plain window sorts a whole group in one task. Where a group is not bounded (a conversation, a
thread, a corpus) the rows are cut into blocks by their integer position instead: windows run inside
a block, one aggregate row per block carries the rest. A group that holds a third of all rows is
then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 100_000


def _blocked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], width: int = BLOCK) -> DataFrame:
    """Inclusive running sums per group. ``order`` is an integer, unique within the group."""
    blocked = _blocked(df, order, width).withColumns({f"_v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = blocked.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(offsets, [*keys, "_b"])
    drop = ["_b", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums]]
    return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(*drop)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Largest value of its group up to each row."""
    blocked = _blocked(df, order, width).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocked.groupBy(*keys, "_b").agg(F.max("_v").alias("_t")).select(*keys, "_b", F.max("_t").over(earlier).alias("_o"))
    local = blocked.withColumn("_m", F.max("_v").over(inside))
    return local.join(tops, [*keys, "_b"]).withColumn(out, F.greatest("_m", "_o")).drop("_b", "_v", "_m", "_o")


def last_before(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """The last non-null ``value`` strictly before each row of its group."""
    blocked = _blocked(df, order, width).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_e"))
    carried = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(earlier).alias("_c"))
    local = blocked.withColumn("_l", F.last("_v", ignorenulls=True).over(inside))
    return local.join(carried, [*keys, "_b"]).withColumn(out, F.coalesce("_l", "_c")).drop("_b", "_v", "_l", "_c")


def joined_text(df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = "", width: int = BLOCK) -> DataFrame:
    """Texts of a group in order, glued to ``(keys, text)``: one row per group, whatever its length.
    Blocks of a group are glued where they are and meet as one piece each, so a task's rows are a
    block's texts or one group's pieces. Null texts are left out."""

    def glue(place: str, piece: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(piece).isNotNull(), F.struct(F.col(place).alias("o"), F.col(piece).alias("t")))))
        return F.array_join(F.transform(rows, lambda x: x["t"]), separator)

    blocks = _blocked(df, order, width).groupBy(*keys, "_b").agg(glue(order, text).alias("_t"), F.count(text).alias("_c"))
    pieces = blocks.withColumn("_t", F.when(F.col("_c") > 0, F.col("_t")))
    return pieces.groupBy(*keys).agg(glue("_b", "_t").alias("text"))


def global_rank(df: DataFrame, order: str, out: str) -> DataFrame:
    """Dense positions 0, 1, 2, ... over the whole table in the order of a unique column: range
    partitions, positions inside each, offsets from one row per partition. The partition number
    is checkpointed before it is used twice, so both uses see the same ranges."""
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_b", F.spark_partition_id()))
    counts = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1)
    return local.join(F.broadcast(offsets), "_b").withColumn(out, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark's group limit cuts every task to k rows of a group before
    the shuffle, so a group of any size reaches the final sort as k rows per task; for a k
    beyond that optimisation's threshold a salted first round does the same."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salted = df.withColumn("_s", F.spark_partition_id())
        first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order)))
        df = first.filter(F.col("_r") <= k).drop("_s", "_r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
