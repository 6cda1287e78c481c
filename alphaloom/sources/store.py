"""An incremental store: rows in buckets of their key, of which a batch rewrites only those that it touches, and a manifest of batches.

``ingest`` replaces rows by key (the greatest version wins, the newcomer at equal versions) and notes the batch. A batch that is in the
manifest is not taken again, and one that was interrupted gives the same table when it runs once more, because replacing by key does.
Buckets are written through a table staged beside the store, so a failed write never reads what it overwrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import staged
from alphaloom.sources.files import upsert

MANIFEST = "batch string, rows long, buckets array<int>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key: whole numbers by their remainder, anything else by its hash."""
    c = F.col(key)
    return F.coalesce(F.when(c.cast("string").rlike(r"^-?\d{1,18}$"), F.pmod(c.cast("string").try_cast("long"), F.lit(buckets))), F.pmod(F.xxhash64(c), F.lit(buckets))).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, buckets) of every batch that was taken."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if _exists(spark, f"{path}/manifest") else spark.createDataFrame([], MANIFEST)


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store's rows; ``schema`` of the ingested rows."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _bucket int").parquet(f"{path}/rows").drop("_bucket")


def ingest(new: DataFrame, path: str, batch: str, key: str, version: str, buckets: int = 64) -> list[int]:
    """Take ``new`` as ``batch``; returns the buckets that were rewritten, none if the batch is known."""
    spark = new.sparkSession
    if manifest(spark, path).filter(F.col("batch") == batch).limit(1).count():
        return []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    new = staged(new.withColumn("_bucket", bucket_of(key, buckets)), "store-new")
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # bounded by ``buckets``
    if touched:
        old = spark.read.schema(f"{schema}, _bucket int").parquet(f"{path}/rows").filter(F.col("_bucket").isin(touched)) if _exists(spark, f"{path}/rows") else new.limit(0)
        rows = staged(upsert(old, new, key, version), "store-rows")
        # a bucket of any size: adaptive execution splits it over tasks
        rows.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")
    note = spark.createDataFrame([(batch, new.count(), touched)], MANIFEST)
    note.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return touched
