"""Run records, per-target outputs, and the joins that decide what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "target_id string, target_name string, grp string, trained_at timestamp, trials int, seconds double, "
    "train_rows long, n_features int, val_mda double, test_mda double, test_mape double, test_rmse double, "
    "params map<string,double>"
)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All record files below a folder or matching a glob, with a fixed schema (no inference pass)."""
    return spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", "true").json(path)


def write_by_target(rows: DataFrame, path: str, columns: Sequence[str] = ("target_id", "split")) -> None:
    """One folder per target (and split). Tasks write what they hold: a large target becomes
    several files rather than one overloaded task."""
    rows.write.mode("overwrite").partitionBy(*columns).parquet(path)


def not_done(targets: DataFrame, done: DataFrame, on: Sequence[str] = ("target_id",)) -> DataFrame:
    return targets.join(done.select(*on), list(on), "left_anti")


def append_missing(existing: DataFrame, fresh: DataFrame, on: Sequence[str]) -> DataFrame:
    """Existing rows, plus the fresh ones whose key is not there yet."""
    return existing.unionByName(not_done(fresh, existing, on))


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, ts: str) -> DataFrame:
    """Union where the newest row of a key wins: an aggregate, combined before the shuffle, so
    many versions of one key never meet in one task. On equal times the incoming row wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c != key]
    newest: Column = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col("_new")))
    return both.groupBy(key).agg(newest.alias("r")).select(key, "r.*").select(*existing.columns)
