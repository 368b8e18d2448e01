"""Dual-header panel CSV: ids in the first line, display names in the second, then one row per date.

The working form of a panel is long Parquet; the wide file is for export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guarded import clean_number, fixed, tolerant_date
from ..operators.align import first_source_wins


def read_panel_csv(spark: SparkSession, path: str, source: str = "file") -> tuple[DataFrame, DataFrame]:
    """(catalog, panel). The name line is the first one below the header, or one whose first cell
    repeats the header's (a folder of part files has it anywhere); other lines without a date are
    skipped, bad cells become null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    first, *ids = raw.columns
    raw = raw.withColumn("_line", F.monotonically_increasing_id())
    quoted = [f"`{c}`" for c in ids]
    dated = raw.withColumn("_d", tolerant_date(F.col(f"`{first}`")))
    names = (
        dated.filter(F.col("_d").isNull() & ((F.col("_line") == 0) | F.coalesce(F.col(f"`{first}`") == first, F.lit(False))))
        .select(F.posexplode(F.array(*[F.struct(F.lit(i).alias("series_id"), F.col(q).alias("series_name")) for i, q in zip(ids, quoted)])).alias("pos", "c"))
        .select("c.series_id", F.coalesce("c.series_name", "c.series_id").alias("series_name"), F.lit(source).alias("source"), (F.col("pos") + 1).alias("ordinal"))
    )
    cells = F.array(*[F.struct(F.lit(i).alias("series_id"), clean_number(F.col(q)).alias("value")) for i, q in zip(ids, quoted)])
    panel = (
        dated.filter(F.col("_d").isNotNull())
        .select(F.col("_d").alias("d"), F.explode(cells).alias("c"))
        .select("c.series_id", "d", "c.value")
    )
    return names, panel


def read_panel_files(spark: SparkSession, files: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(source, path) pairs in order of precedence; missing files are skipped, and a series comes
    whole from the first file that lists it."""
    found = []
    for source, path in files:
        try:
            found.append(read_panel_csv(spark, path, source))
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return first_source_wins(found)


def to_wide(panel: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long to wide, one row per day, for a stated list of series."""
    return panel.groupBy("d").pivot("series_id", list(ids)).agg(F.first("value"))


def write_panel_csv(panel: DataFrame, names: dict[str, str], path: str, decimals: int = 6) -> None:
    """Dual-header export. Days are range-partitioned, so each task writes its stretch of the
    calendar; every part file repeats the id header, and the name line is a row of its own."""
    wide = to_wide(panel, list(names))
    cells = [F.coalesce(fixed(F.col(f"`{i}`"), decimals), F.lit("")).alias(i) for i in names]
    body = wide.select(F.col("d").cast("string").alias("data_date"), *cells)
    head = panel.sparkSession.createDataFrame([("data_date", *names.values())], body.schema)
    head.unionByName(body).repartitionByRange("data_date").sortWithinPartitions("data_date").write.mode("overwrite").csv(
        path, header=True, emptyValue=""
    )


def write_panel(panel: DataFrame, path: str) -> None:
    """Primary sink: long Parquet, rows of a series near each other so readers can skip files."""
    panel.repartition("series_id").sortWithinPartitions("series_id", "d").write.mode("overwrite").parquet(path)
