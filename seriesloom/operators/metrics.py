"""Forecast metrics over prediction tables ``(target_id, d, y_true, y_pred)``.

One row per target and day, so a target is bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import safe_ratio
from .align import by_day
from .scan import running_max


def _steps(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = by_day(*keys)
    return predictions.withColumns(
        {"_dt": F.col("y_true") - F.lag("y_true").over(w), "_dp": F.col("y_pred") - F.lag("y_pred").over(w)}
    )


def forecast_metrics(predictions: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """MDA leaves out flat actual steps and is 0.5 when no others remain; MAPE leaves out zero
    actuals and says how many."""
    err = F.col("y_true") - F.col("y_pred")
    moved = F.col("_dt") != 0
    return _steps(predictions, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.when(moved, (F.signum("_dt") == F.signum("_dp")).cast("double"))), F.lit(0.5)).alias("mda"),
        F.avg(safe_ratio(F.abs(err), F.abs("y_true"), 0.0)).alias("mape"),
        F.count_if(F.col("y_true") == 0).alias("zero_actuals"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )


def direction_hits(predictions: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Per step: both up, or both not up. Equal counts as down on either side."""
    steps = _steps(predictions, keys).filter(F.col("_dt").isNotNull())
    return steps.withColumn("hit", ((F.col("_dt") > 0) == (F.col("_dp") > 0)).cast("int")).drop("_dt", "_dp")


def overfit_gap(metrics: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Train and test metric side by side, and how far they drift apart."""

    def of(split: str, name: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(name)))

    return metrics.groupBy(*keys).agg(
        of("train", "mda").alias("train_mda"),
        of("test", "mda").alias("test_mda"),
        (of("train", "mda") - of("test", "mda")).alias("mda_drop"),
        (of("test", "mape") - of("train", "mape")).alias("mape_rise"),
    )


def run_comparison(runs: DataFrame, good: float = 0.70) -> DataFrame:
    """Per target, per group and overall in one rollup: means of both runs, the mean change, and
    how many targets improved or reached ``good``."""
    change = F.col("new_mda") - F.col("old_mda")
    level = F.grouping_id()
    return (
        runs.rollup("grp", "target_id")
        .agg(
            level.alias("level"),
            F.count(F.lit(1)).alias("n_targets"),
            F.avg("old_mda").alias("avg_old"),
            F.avg("new_mda").alias("avg_new"),
            F.avg(change).alias("avg_change"),
            F.count_if(change > 0).alias("improved"),
            F.count_if(F.col("new_mda") >= good).alias("above_good"),
        )
    )


def error_percentiles(predictions: DataFrame, shares: Sequence[float] = (0.5, 0.75, 0.95), keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Index percentiles: the value at floor(n * share) of the sorted errors, from 0."""
    ranked = predictions.withColumn("e", F.abs(F.col("y_true") - F.col("y_pred"))).withColumns(
        {
            "_i": F.row_number().over(Window.partitionBy(*keys).orderBy("e", "d")) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == F.floor(F.col("_n") * s), F.col("e"))).alias(f"p{round(s * 100)}") for s in shares]
    )


def error_histogram(predictions: DataFrame, width: float, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return predictions.groupBy(*keys, F.floor(e / F.lit(width)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def best_so_far(trials: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Best score up to each trial. A study may have any number of trials, so the running maximum
    is taken in blocks."""
    return running_max(trials, keys, "number", F.col("mda"), "best_so_far")


def latest_rows(predictions: DataFrame, n: int = 10, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("d").desc())
    return predictions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def order_by_change(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("change").desc_nulls_last(), "target_id")


def order_by_date_text(rows: DataFrame, text: str) -> DataFrame:
    """Newest first; texts that are no dates come last."""
    return rows.orderBy(F.try_to_date(F.col(text), "yyyy-MM-dd").desc_nulls_last(), F.col(text))
