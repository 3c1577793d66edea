"""Gate counts per window, notifications and latest reports over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.schema import ERROR, INFO, WARNING
from gatewright.session import fresh_dir
from gatewright.streaming.feeds import all_progress, past_watermark, run_available
from gatewright.streaming.upsert import BUCKETS, create_upserts, read_upserts, upsert_batch

SEEN = "seen"


def stream_gate(stream: DataFrame, window: str = "1 day", delay: str = "1 day", severity: str = "severity",
                ts: str = "ts") -> DataFrame:
    """Errors, warnings, infos and all rows per tumbling window; rows later than `delay` are dropped.

    What comes in is counted before (`SEEN` in the progress of the query), so that dropped rows
    can be told: rows without a time, or whose window had ended by the watermark of the micro-batch before.
    """
    level = F.col(severity)
    return (
        stream.observe(SEEN, F.count(F.lit(1)).alias("rows")).withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("window"))
        .agg(
            F.count_if(level == ERROR).alias("errors"),
            F.count_if(level == WARNING).alias("warnings"),
            F.count_if(level == INFO).alias("infos"),
            F.count("*").alias("total"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "errors", "warnings", "infos", "total")
    )


class GateTable:
    """The newest counts of each window, and how many rows came too late for theirs.

    Runs go on from each other: `run` may be called whenever more rows have arrived.
    """

    KEYS = ["window_start", "window_end"]

    def __init__(self, gate_stream: DataFrame, folder: str | None = None, buckets: int = BUCKETS):
        self.stream, self.buckets, spark = gate_stream, buckets, gate_stream.sparkSession
        self.base = folder or fresh_dir(spark, "gate")
        # A schema of its own: `add` changes the one that the stream keeps, so a second table would have the column twice.
        self.schema = T.StructType([*gate_stream.schema.fields, T.StructField("batch", T.LongType())])
        self.seen = 0
        create_upserts(spark, f"{self.base}/table", self.schema)

    def run(self) -> GateTable:
        def each(batch: DataFrame, batch_id: int) -> None:
            upsert_batch(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), f"{self.base}/table", self.KEYS, ["batch"], self.buckets)

        query = run_available(self.stream.writeStream.outputMode("update"), f"{self.base}/log", each)
        self.seen += sum(m.rows for m in (p.observedMetrics.get(SEEN) for p in all_progress(query)) if m)
        return self

    def windows(self) -> DataFrame:
        """(window_start, window_end, errors, warnings, infos)"""
        return read_upserts(self.stream.sparkSession, f"{self.base}/table", self.schema).drop("batch", "total")

    def late_rows(self) -> int:
        """Rows seen by the runs of this object that are in no window."""
        counted = read_upserts(self.stream.sparkSession, f"{self.base}/table", self.schema).agg(F.sum("total")).first()[0]
        return self.seen - (counted or 0)


def drain_gate(gate_stream: DataFrame) -> DataFrame:
    """Run `stream_gate` over the data present: the newest counts of each window."""
    return GateTable(gate_stream).run().windows()


def notify_once(stream: DataFrame, keys: Sequence[str], delay: str = "1 day", ts: str = "ts", salts: int = 16,
                slot: str = "1 hour") -> DataFrame:
    """The first row of each key within the time bound; repeats inside it are dropped.

    Two stateful steps: one row per key, time slot and salt, where a key with a third of all rows is
    dealt to `salts` tasks, then one per key. A row that the first step drops has another of its key in the
    same slot, so the second step sees each key in each slot, and notifies as it would without the first.
    Rows whose keys are all null are no notifications; they only move the watermark.
    """
    own = list(stream.columns)
    named = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        named = named | F.col(k).isNotNull()
    salted = stream.withColumns({
        "__salt": F.pmod(F.xxhash64(*own), F.lit(salts)), "__slot": F.window(ts, slot).start,
    }).withWatermark(ts, delay)
    first = past_watermark(salted, ts, named).dropDuplicatesWithinWatermark([*keys, "__slot", "__salt"])
    return first.dropDuplicatesWithinWatermark(list(keys)).select(*own)


def append_rows(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append-mode stream over the data present into Spark's file sink: all rows it has given so far."""
    run_available(stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows"), f"{folder}/log")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_append(stream: DataFrame, label: str = "append") -> DataFrame:
    """`append_rows` into a folder of its own."""
    return append_rows(stream, fresh_dir(stream.sparkSession, label))


def sink_latest_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str | None = None,
                       buckets: int = BUCKETS) -> DataFrame:
    """Keep the latest report per key: each micro-batch is reduced to one row per key, then upserted.

    The order columns decide across micro-batches too, so a late row does not replace a newer one.
    With a `folder` later calls go on from it. Gives back the table.
    """
    spark = stream.sparkSession
    base = folder or fresh_dir(spark, "latest")
    create_upserts(spark, f"{base}/table", stream.schema)
    run_available(stream.writeStream.outputMode("append"), f"{base}/log",
                  lambda batch, _: upsert_batch(batch, f"{base}/table", keys, order, buckets))
    return read_upserts(spark, f"{base}/table", stream.schema)
