"""Profiles of series, sources and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_profile(panel: DataFrame) -> DataFrame:
    """Counts, moments, range and missing rate per series: one map-side combined aggregate."""
    v = F.col("value")
    return panel.groupBy("series_id").agg(
        F.count(v).alias("valid_count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v.isNull().cast("double")).alias("missing_rate"),
    )


def enough_observations(panel: DataFrame, minimum: int, strict: bool = True) -> DataFrame:
    """Series with more than (or at least, ``strict=False``) ``minimum`` values. The counts are
    aggregated and semi-joined back, so no window carries the rows through a sort."""
    n = F.count("value")
    keep = panel.groupBy("series_id").agg(n.alias("n")).filter(F.col("n") > minimum if strict else F.col("n") >= minimum)
    return panel.join(keep.select("series_id"), "series_id", "left_semi")


def quantile_table(panel: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per series (bounded by the days of the calendar)."""
    return panel.groupBy("series_id").agg(
        F.percentile("value", F.array(*[F.lit(p) for p in probabilities])).alias("q")
    ).select("series_id", *[F.get("q", i).alias(f"q{round(p * 100)}") for i, p in enumerate(probabilities)])


def period_completeness(panel: DataFrame, periods: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Cells, filled cells and fill rate per (possibly overlapping) period. Days are summed up
    first, so the period table meets at most one row per calendar day."""
    if series is not None:
        panel = panel.join(series.select("series_id"), "series_id", "left_semi")
    daily = panel.groupBy("d").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"))
    from .align import days_in_intervals

    return (
        days_in_intervals(daily, periods, "period")
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.sum("cells").alias("total_cells"),
            F.sum("filled").alias("valid_cells"),
            (F.sum("filled") / F.sum("cells")).alias("completeness"),
        )
    )


def first_valid_dates(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("value").isNotNull()).groupBy("series_id").agg(F.min("d").alias("first_valid"))


def start_years(panel: DataFrame, live_at: str) -> DataFrame:
    """Series by the year of their first value, and how many of those were live at a day."""
    return first_valid_dates(panel).groupBy(F.year("first_valid").alias("start_year")).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("first_valid") <= F.lit(live_at).cast("date")).alias("live_at_reference"),
    )


def source_range(rows: DataFrame, source: str = "source", position: str = "pos", edge: int = 3) -> DataFrame:
    """Rows, date range, whether the file runs newest first, and its first and last dates by
    position. The edges come from ranked rows, which Spark cuts to ``edge`` per task before the
    shuffle; nothing is collected per source."""
    base = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("d").alias("min_date"),
        F.max("d").alias("max_date"),
        (F.min_by("d", position) > F.max_by("d", position)).alias("descending"),
    )

    def edge_dates(order, name):
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order)))
        return (
            ranked.filter(F.col("_r") <= edge)
            .groupBy(source)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(position), F.col("d")))).alias("_l"))
            .select(source, F.array_join(F.transform("_l", lambda x: x["d"].cast("string")), ",").alias(name))
        )

    return base.join(edge_dates(F.col(position).asc(), "first_dates"), source).join(
        edge_dates(F.col(position).desc(), "last_dates"), source
    )


def group_summary(mapping: DataFrame) -> DataFrame:
    """Series per group, split by the core flag."""
    return mapping.groupBy("grp").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_core")).alias("core"),
        F.count_if(~F.col("is_core")).alias("non_core"),
    )


def value_ranges(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def compression(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Rows and date range before and after weekly sampling, and their ratio. Both sides are
    single-row aggregates over one tagged union."""
    both = daily.select("d", F.lit(1).alias("is_daily")).unionByName(weekly.select("d", F.lit(0).alias("is_daily")))
    is_daily, is_weekly = F.col("is_daily") == 1, F.col("is_daily") == 0
    return both.agg(
        F.count_if(is_daily).alias("daily_rows"),
        F.count_if(is_weekly).alias("weekly_rows"),
        F.min(F.when(is_weekly, F.col("d"))).alias("weekly_start"),
        F.max(F.when(is_weekly, F.col("d"))).alias("weekly_end"),
    ).withColumn("ratio", F.when(F.col("weekly_rows") > 0, F.col("daily_rows") / F.col("weekly_rows")))
