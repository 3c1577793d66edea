"""A table with one row per key that micro-batches upsert into.

Rows lie in folders by a hash of their key. A micro-batch rewrites only the folders it touches, each
as one file, by dynamic partition overwrite, so the table stays as large as its keys and is read as it
is. The newest row of a key wins by the order columns, wherever it arrives, so a micro-batch
that runs again after a failure leaves the same table. One query writes a table at a time. Rows are
moved into place folder by folder: readers that must see all folders change at once need a table format with transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.session import stage

BUCKET, BUCKETS = "key_bucket", 16


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest order columns, then the greatest rest."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    row = F.max(F.struct(*order, *rest)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in df.columns if c not in keys])


def read_upserts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _stored(spark, path, schema).drop(BUCKET)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table; a bucket of one file each, or no file yet."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def create_upserts(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table, unless it is there."""
    if BUCKET in schema.fieldNames():
        raise ValueError(f"column {BUCKET} names the folders of the table")
    spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).write.mode("ignore").partitionBy(BUCKET).parquet(path)


def upsert_batch(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> int:
    """Merge a micro-batch into the table; gives back the number of folders written.

    The batch is reduced to one row per key before its shuffle, so a key with many rows costs one row here.
    Order columns hold values that can be compared.
    """
    spark = batch.sparkSession
    schema = batch.schema
    reduced = newest_rows(batch, keys, order).select(batch.columns)
    incoming = stage(reduced.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert")
    touched = sorted(r[0] for r in incoming.select(BUCKET).distinct().collect())
    if not touched:
        return 0
    before = _stored(spark, path, schema).filter(F.col(BUCKET).isin(touched))
    # Dealt by folder once; rows of a key meet there without another shuffle.
    merged = newest_rows(before.unionByName(incoming).repartition(len(touched), BUCKET), [BUCKET, *keys], order)
    (
        merged.select(*batch.columns, BUCKET).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )
    return len(touched)
