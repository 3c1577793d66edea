"""Findings sink: a run-stamped history and a "latest" copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(df: DataFrame, base: str, run_ts: str, enabled: bool = True) -> str | None:
    """Write one run. Returns the path of the latest copy, or None when switched off.

    The history partition of a run is replaced as a whole, so a repeated run does
    not double its rows; "latest" is rewritten from the stored history, which
    computes the findings once.
    """
    if not enabled:
        return None
    spark = df.sparkSession
    history, latest = f"{base}/history", f"{base}/latest"
    (
        df.withColumn("run_ts", F.lit(run_ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_ts")
        .parquet(history)
    )
    stored = spark.read.schema(df.schema).parquet(f"{history}/run_ts={_path_value(run_ts)}")
    stored.write.mode("overwrite").parquet(latest)
    return latest


def _path_value(value: str) -> str:
    """Partition values are escaped in folder names; stamps use `yyyy-MM-dd_HH-mm-ss`."""
    if any(c in value for c in ' :/\\%"\'*?{}[]^=#'):
        raise ValueError("run_ts must be of the form yyyy-MM-dd_HH-mm-ss")
    return value


def read_latest(spark, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/latest")
