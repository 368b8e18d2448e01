"""Panels, daily spines and as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_day(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("d")


def to_panel(rows: DataFrame, series: Column, day: Column, value: Column) -> DataFrame:
    """Raw rows to one value per series and day. ``value`` is an aggregate, so a series that
    holds most of the rows is reduced to its days before the shuffle."""
    return rows.groupBy(series.alias("series_id"), day.alias("d")).agg(value.cast("double").alias("value"))


def last_per_day(observations: DataFrame, order: str) -> DataFrame:
    """Several observations of a series on one day: the one with the largest ``order`` stays."""
    return observations.groupBy("series_id", "d").agg(F.max_by("value", order).alias("value"))


def spine(catalog: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every series on every day: generated per catalog row, so no join is needed. The catalog is dealt
    over a stated number of partitions before it grows to rows per day: its few bytes would else be
    packed into one task. Work per series that follows finds the rows dealt by series. (One partition
    more than the session's number, or the planner folds this into an earlier shuffle by series, whose
    partitions it may pack.)"""
    days = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("interval 1 day"))
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return catalog.select("series_id").repartition(parts, "series_id").select("series_id", F.explode(days).alias("d"))


def forward_fill(panel: DataFrame, value: str = "value", out: str = "value", keys=("series_id",)) -> DataFrame:
    w = by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, F.last(value, ignorenulls=True).over(w))


def backward_fill(panel: DataFrame, value: str = "value", out: str = "value", keys=("series_id",)) -> DataFrame:
    """Fills from the future: leaks, so nothing here calls it unless asked to. Ordered backwards:
    a frame that grows is updated per row, one that shrinks would be recomputed per row."""
    w = Window.partitionBy(*keys).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, F.last(value, ignorenulls=True).over(w))


def by_series(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a series together, over a stated number of partitions (several per core, which the planner does
    not pack): they grow to a row per day in the task that holds them."""
    spark = rows.sparkSession
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism) + 1
    return rows.repartition(parts, *(keys or ("series_id",)))


def align_asof(panel: DataFrame, lo: str, hi: str, catalog: DataFrame | None = None) -> DataFrame:
    """Latest non-null value at or before each spine day, however old; values from before
    ``lo`` carry in. Each observation grows to the days up to the next one, in the task that holds its
    series: only observations are shuffled, no spine and no range join. A day listed twice in the catalog stays so."""
    first, last = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    # rows without a day in reach only say that their series is there: they stand behind the last day
    near = F.col("d") <= last
    after = F.date_add(last, 1)
    seen = panel.select("series_id", F.when(near, F.col("d")).otherwise(after).alias("d"), F.when(near, F.col("value")).alias("value"), F.lit(1).cast("long").alias("_n"))
    if catalog is not None:
        listed = catalog.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).select("series_id", after.alias("d"), F.lit(None).cast("double").alias("value"), "_n")
        seen = seen.withColumn("_n", F.lit(None).cast("long")).unionByName(listed)
    w = by_day()
    seen = by_series(seen).withColumns({
        "_v": F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"),
        "_from": F.when(F.row_number().over(w) == 1, first).otherwise(F.greatest(F.col("d"), first)),
        "_to": F.least(F.coalesce(F.date_sub(F.lead("d").over(w), 1), last), last),
    })
    if catalog is not None:
        seen = seen.withColumn("_n", F.max("_n").over(Window.partitionBy("series_id")))
    places = F.sequence(F.lit(0), F.datediff("_to", "_from"))
    if catalog is not None:
        places = F.when(F.col("_n") > 1, F.flatten(F.array_repeat(places, F.col("_n").cast("int")))).otherwise(places)
    days = seen.filter((F.col("_to") >= F.col("_from")) & F.col("_n").isNotNull()).select("series_id", F.col("d").alias("_d"), "_v", "_from", F.explode(places).alias("_i"))
    day = F.date_add("_from", F.col("_i"))
    # before a series' first observation there is none
    return days.select("series_id", day.alias("d"), F.when(day >= F.col("_d"), F.col("_v")).alias("value"))


def align_exact(panel: DataFrame, lo: str, hi: str, catalog: DataFrame | None = None) -> DataFrame:
    """Only observations on spine days count; then forward fill. History before ``lo`` is lost."""
    catalog = panel.select("series_id").distinct() if catalog is None else catalog
    return align_asof(panel.filter(F.col("d") >= F.lit(lo).cast("date")), lo, hi, catalog)


def expand_intervals(intervals: DataFrame, label: str) -> DataFrame:
    """(label, lo, hi) to one row per label and day. Joining on the day is then an equi-join,
    and overlapping intervals simply give several rows."""
    return intervals.select(label, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("d"))


def days_in_intervals(days: DataFrame, intervals: DataFrame, label: str) -> DataFrame:
    return days.join(expand_intervals(intervals, label).distinct(), "d")


def holiday_flags(days: DataFrame, holidays: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """0/1 column per window; a window is (first, last) day offset around a holiday, inclusive."""
    hits = None
    for name, (first, last) in windows.items():
        part = holidays.select(
            F.lit(name).alias("flag"), F.date_add("holiday", first).alias("lo"), F.date_add("holiday", last).alias("hi")
        )
        hits = part if hits is None else hits.unionByName(part)
    per_day = expand_intervals(hits, "flag").groupBy("d").agg(
        *[F.max((F.col("flag") == name).cast("int")).alias(name) for name in windows]
    )
    return days.join(per_day, "d", "left").na.fill(0, list(windows))


# Days before, during and after a holiday, inclusive offsets.
HOLIDAY_WINDOWS = {"before_15d": (-15, -1), "during": (0, 6), "after_15d": (7, 22)}


def first_source_wins(tables: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(catalog, panel) pairs in order of precedence; a series is taken whole from the first
    table that lists it."""
    catalogs = [c.withColumn("source_rank", F.lit(i)) for i, (c, _) in enumerate(tables)]
    panels = [p.withColumn("source_rank", F.lit(i)) for i, (_, p) in enumerate(tables)]
    all_catalogs, all_panels = catalogs[0], panels[0]
    for c, p in zip(catalogs[1:], panels[1:]):
        all_catalogs = all_catalogs.unionByName(c)
        all_panels = all_panels.unionByName(p)
    rest = [c for c in all_catalogs.columns if c not in ("series_id", "source_rank")]
    winner = (
        all_catalogs.groupBy("series_id")
        .agg(F.min_by(F.struct("source_rank", *rest), "source_rank").alias("first"))
        .select("series_id", "first.*")
    )
    panel = all_panels.join(winner.select("series_id", "source_rank"), ["series_id", "source_rank"], "left_semi")
    return winner, panel.drop("source_rank")


def enrich(panel: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Catalog columns onto a panel. No hint: the catalog grows with the number of series, so
    Spark's size threshold (and AQE at run time) decides whether to broadcast it."""
    return panel.join(catalog, "series_id", how)
