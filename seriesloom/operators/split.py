"""Time-ordered splits with an embargo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import lead_label


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def train_val_test(samples: DataFrame, cutoff: str, gap_days: int = 98, ratio: float = 0.8, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows up to the cutoff: the first int(ratio * n) in time train, the rest validate. Rows
    from ``gap_days`` after the cutoff test; rows in the gap are dropped."""
    kept = samples.filter((F.col("d") <= _day(cutoff)) | (F.col("d") >= F.date_add(_day(cutoff), gap_days)))
    early = F.col("d") <= _day(cutoff)
    w = Window.partitionBy(*keys, early)
    rank, n = F.row_number().over(w.orderBy("d")), F.count(F.lit(1)).over(w)
    split = F.when(~early, "test").when(rank <= F.floor(F.lit(ratio) * n), "train").otherwise("val")
    return kept.withColumn("split", split)


def train_test(samples: DataFrame, cutoff: str, gap_days: int = 98) -> DataFrame:
    """Weekly variant without validation: a row-wise rule, no shuffle."""
    split = F.when(F.col("d") <= _day(cutoff), "train").when(F.col("d") >= F.date_add(_day(cutoff), gap_days), "test")
    return samples.withColumn("split", split).filter(F.col("split").isNotNull())


def split_report(split: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and range per split, and the gap in days that really lies between them."""
    is_train, is_test = F.col("split") == "train", F.col("split") == "test"
    return split.groupBy(*keys).agg(
        F.count_if(is_train).alias("train_rows"),
        F.count_if(is_test).alias("test_rows"),
        F.min(F.when(is_train, F.col("d"))).alias("train_start"),
        F.max(F.when(is_train, F.col("d"))).alias("train_end"),
        F.min(F.when(is_test, F.col("d"))).alias("test_start"),
        F.max(F.when(is_test, F.col("d"))).alias("test_end"),
    ).withColumn("gap_days", F.datediff("test_start", "train_end"))


def labelled_split(samples: DataFrame, column: str, cutoff: str, gap_days: int = 98, keys: Sequence[str] = ("series_id",), strict: bool = True) -> DataFrame:
    """Label first, then split, per target. ``strict`` also drops training rows whose label day
    lies after the cutoff, so nothing from the gap reaches the training labels."""
    out = train_test(lead_label(samples, column, 1, keys), cutoff, gap_days)
    if strict:
        out = out.filter((F.col("split") != "train") | (F.col("label_d") <= _day(cutoff)))
    return out


def time_holdout(train: DataFrame, share: float = 0.9, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Marks the last 10 % of the training rows in time as the tuning holdout."""
    w = Window.partitionBy(*keys)
    rank, n = F.row_number().over(w.orderBy("d")), F.count(F.lit(1)).over(w)
    return train.withColumn("is_holdout", rank > F.floor(F.lit(share) * n))
