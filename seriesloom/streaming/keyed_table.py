"""A table of the newest row per key that streams can write to.

Rows lie in hash buckets, a folder per bucket and version. A merge reads and rewrites only the buckets that
its batch touches; the manifest says which version of each bucket counts. A version exists once its number is
in ``committed``, so readers never see half of one, and a batch that runs again writes its own version anew.
Files that none of the last versions names are deleted.

The number of buckets is fixed by the first merge; it bounds what passes through the driver (a row per
bucket). Rows without a key are left out. On equal times the incoming row wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import upsert_latest

BUCKETS, KEPT_VERSIONS = 64, 2


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, folder: str) -> bool:
    path, system = _files(spark, folder)
    return bool(system.exists(path))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions, in order."""
    if not _there(spark, f"{folder}/committed"):
        return []
    return sorted(r[0] for r in spark.read.schema("version long").parquet(f"{folder}/committed").distinct().collect())


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """Version of every bucket that has rows."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/v{version}").collect()}


def _rows(spark: SparkSession, folder: str, schema, held: dict[int, int]) -> DataFrame:
    """The rows of some buckets; their paths are named, nothing else is listed."""
    paths = [f"{folder}/rows/v{v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, folder: str):
    return spark.read.parquet(f"{folder}/schema").schema


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the newest)."""
    found = versions(spark, folder)
    if not found:
        raise ValueError(f"no committed version in {folder}")
    return _rows(spark, folder, _schema(spark, folder), _manifest(spark, folder, found[-1] if version is None else version))


def merge(batch: DataFrame, folder: str, version: int, key: str, ts: str, buckets: int = BUCKETS, kept_versions: int = KEPT_VERSIONS) -> None:
    """Newest row per key of the last version before ``version`` and ``batch``, committed as ``version``."""
    spark = batch.sparkSession
    earlier = [v for v in versions(spark, folder) if v < version]
    if not _there(spark, f"{folder}/schema/_SUCCESS"):
        batch.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/schema")
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")
    buckets = spark.read.schema("buckets int").parquet(f"{folder}/buckets").first()[0]
    schema = _schema(spark, folder)
    manifest = _manifest(spark, folder, earlier[-1]) if earlier else {}
    spot = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = batch.select(*schema.names).filter(F.col(key).isNotNull())
    rest = [c for c in schema.names if c != key]
    fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(key, "r.*").select(*schema.names)
    fresh = fresh.withColumn("bucket", spot).persist()
    try:
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most one row per bucket
        old = _rows(spark, folder, schema, {b: v for b, v in manifest.items() if b in set(touched)})
        if touched:
            rows = upsert_latest(old, fresh.drop("bucket"), key, ts).withColumn("bucket", spot)
            rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/v{version}")
    finally:
        fresh.unpersist()
    manifest |= {b: version for b in touched}
    spark.createDataFrame(sorted(manifest.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v{version}")
    if version not in versions(spark, folder):
        spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/committed")
    _clean(spark, folder, kept_versions)


def _clean(spark: SparkSession, folder: str, kept_versions: int) -> None:
    """Deletes the buckets and manifests that only older versions name."""
    every = versions(spark, folder)
    kept = every[-kept_versions:]
    named = {(b, v) for m in kept for b, v in _manifest(spark, folder, m).items()}
    path, system = _files(spark, f"{folder}/rows")
    if not system.exists(path):
        return
    for of_version in system.listStatus(path):
        number = int(of_version.getPath().getName()[1:])
        if number > every[-1]:
            continue  # a merge that has not committed yet
        left = 0
        for of_bucket in system.listStatus(of_version.getPath()):
            name = of_bucket.getPath().getName()
            if name.startswith("bucket="):
                if (int(name[len("bucket=") :]), number) in named:
                    left += 1
                else:
                    system.delete(of_bucket.getPath(), True)
        if not left:
            system.delete(of_version.getPath(), True)
    for version in every[:-kept_versions]:
        place, _ = _files(spark, f"{folder}/manifest/v{version}")
        if system.exists(place):
            system.delete(place, True)


def upsert_stream(rows: DataFrame, folder: str, checkpoint: str, key: str, ts: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Every micro-batch of a stream merged into the table, until the source is drained."""

    def into(batch: DataFrame, batch_id: int) -> None:
        merge(batch, folder, batch_id, key, ts, buckets)

    return rows.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
