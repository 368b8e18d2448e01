"""Weekly sampling, frequency resampling and gap interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..functions.guarded import safe_ratio
from .align import by_day, by_series


def iso_week_keys(d: Column) -> dict[str, Column]:
    return {"iso_year": F.extract(F.lit("YEAROFWEEK"), d), "iso_week": F.weekofyear(d)}


def weekly_days(days: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per ISO week the last Friday, or the last day of a week without one. A maximum over a
    struct: an aggregate with map-side combine, no window and no sort."""
    pick = F.max(F.struct((F.weekday("d") == 4).alias("friday"), F.col("d").alias("day")))
    grouped = days.withColumns(iso_week_keys(F.col("d"))).groupBy(*keys, "iso_year", "iso_week")
    return grouped.agg(pick.alias("p")).select(*keys, "iso_year", "iso_week", F.col("p.day").alias("d"))


def weekly_sample(panel: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows of the weekly days, whole. A Friday is in; another last day of its week is in unless
    the Friday, at most two rows back, is there. Only neighbours in the day order are looked at,
    so after other per-series windows this needs neither a shuffle nor a sort of its own."""
    w, d = by_day(*keys), F.col("d")
    friday = F.date_add(d, 4 - F.weekday(d))
    last_of_week = F.coalesce(F.lead("d").over(w) > F.date_add(d, 6 - F.weekday(d)), F.lit(True))
    friday_before = F.coalesce(F.lag("d", 1).over(w) == friday, F.lit(False)) | F.coalesce(F.lag("d", 2).over(w) == friday, F.lit(False))
    return panel.withColumn("_in", (d == friday) | (last_of_week & ~friday_before)).filter("_in").drop("_in")


def rebuild_calendar(weekly: DataFrame, names: Sequence[str]) -> DataFrame:
    """Calendar columns recomputed for the day that was picked; all others stay as copied."""
    calendar = calendar_columns(F.col("d"))
    return weekly.withColumns({n: calendar[n] for n in names})


def bucket_day(d: Column, frequency: str) -> Column:
    """End of the bucket: the Sunday of the week, the month end, or the day."""
    return {"week": F.date_add(d, 6 - F.weekday(d)), "month": F.last_day(d), "day": d}[frequency]


def resample_mean(panel: DataFrame, frequency: str) -> DataFrame:
    """Mean per bucket on a gap-free axis from the first to the last bucket of the whole input.
    Each bucket with rows grows to the buckets up to the next one, in the task that holds its series, so
    cells without a value are never shuffled; the ends of the axis are scalar subqueries. Rows without a
    day stay a bucket of their own."""
    sunday, epoch = F.lit("1970-01-04").cast("date"), F.lit("1970-01-01").cast("date")

    def number(d: Column) -> Column:
        return {"week": F.floor(F.datediff(d, sunday) / 7).cast("int"), "month": (F.year(d) - 1970) * 12 + F.month(d) - 1, "day": F.unix_date(d)}[frequency]

    def end(k: Column) -> Column:
        return {"week": F.date_add(sunday, k * 7), "month": F.last_day(F.add_months(epoch, k)), "day": F.date_from_unix_date(k)}[frequency]

    bucket = bucket_day(F.col("d"), frequency)
    lo, hi = panel.agg(F.min(bucket)).scalar(), panel.agg(F.max(bucket)).scalar()
    means = by_series(panel.select("series_id", "value", number(bucket).alias("_k"))).groupBy("series_id", "_k").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("series_id").orderBy("_k")
    means = means.withColumns({"_from": F.when(F.row_number().over(w) == 1, number(lo)).otherwise(F.col("_k")), "_to": F.coalesce(F.lead("_k").over(w) - 1, number(hi))})
    none = F.array().cast("array<int>")
    run = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to")).otherwise(none)
    run = F.when(F.col("_k").isNull(), F.array_append(run, F.lit(None).cast("int"))).otherwise(run)
    cells = means.select("series_id", "_k", "value", F.explode(run).alias("_i"))
    return cells.select("series_id", end(F.col("_i")).alias("d"), F.when(F.col("_i").eqNullSafe(F.col("_k")), F.col("value")).alias("value"))


def interpolate(panel: DataFrame, fill_zero: bool = True) -> DataFrame:
    """Linear by row position between known values; a trailing gap keeps the last value and a
    leading gap becomes zero."""
    w = by_day()
    # both frames grow with the row (backwards in time for the next value), so both are linear
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series_id").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("value").isNotNull(), F.col("_i"))
    out = (
        panel.withColumn("_i", F.row_number().over(w))
        .withColumns({"_pi": F.last(at, True).over(back), "_pv": F.last("value", True).over(back)})
        .withColumns({"_ni": F.last(at, True).over(ahead), "_nv": F.last("value", True).over(ahead)})
    )
    slope = safe_ratio(F.col("_nv") - F.col("_pv"), (F.col("_ni") - F.col("_pi")).cast("double"))
    filled = F.coalesce(F.col("value"), F.col("_pv") + slope * (F.col("_i") - F.col("_pi")), F.col("_pv"))
    if fill_zero:
        filled = F.coalesce(filled, F.lit(0.0))
    return out.withColumn("value", filled).drop("_i", "_pi", "_pv", "_ni", "_nv")


def point_budget(panel: DataFrame, budget: int = 1000) -> DataFrame:
    """The latest ``budget // number of series`` dates of a scenario set, whole dates only.

    Ranks are taken over the distinct dates (one row per calendar day), never over the rows."""
    n_dates = panel.agg(F.floor(F.lit(budget) / F.count_distinct("series_id"))).scalar()
    dates = panel.select("d").distinct()
    ranked = dates.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("d").desc())))
    keep = ranked.withColumn("_n", n_dates).filter((F.col("_n") == 0) | (F.col("_r") <= F.col("_n")))
    return panel.join(keep.select("d"), "d", "left_semi")
