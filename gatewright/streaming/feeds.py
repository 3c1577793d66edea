"""Event streams from files, heartbeats, and runs over the data present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Later than any event: a heartbeat of this time settles all rows before it.
SEAL = "9999-01-01 00:00:00"
_BEFORE_ALL = "0001-01-01 00:00:00"


def read_events(spark: SparkSession, root: str, glob: str = "*.parquet", files_per_batch: int | None = None, schema=None) -> DataFrame:
    """Parquet events as a stream; `ts` gets a zone, which watermarks ask for."""
    schema = schema or spark.read.option("pathGlobFilter", glob).parquet(root).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root).withColumn("ts", F.col("ts").cast("timestamp"))


def arrive(rows: DataFrame, root: str) -> None:
    """Add rows to the folder that a stream reads."""
    rows.write.mode("append").parquet(root)


def heartbeat(rows: DataFrame, at: str, ts: str = "ts") -> DataFrame:
    """One row of the shape of `rows` that has a time and nothing else: it moves the watermark when no event does."""
    values = [(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.sparkSession.range(1).select(*values)


def past_watermark(stream: DataFrame, ts: str, keep: Column) -> DataFrame:
    """Rows that satisfy `keep`, after all have moved the watermark.

    Spark pushes a filter below a watermark unless it looks at the event time, and what is
    filtered there does not move it; so the condition names a time that no row has.
    """
    return stream.filter(keep | (F.col(ts) < F.lit(_BEFORE_ALL).cast("timestamp")))


def run_available(writer, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Work on what is there, as micro-batches that go on from the checkpoint, and stop."""
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer).start()
    query.awaitTermination()
    return query


def all_progress(query: StreamingQuery) -> list:
    """The progress of each micro-batch of a run; refuses if Spark kept fewer than there were."""
    progress = query.recentProgress
    ids = [p.batchId for p in progress]
    if ids and len(set(ids)) <= ids[-1] - ids[0]:
        raise RuntimeError("micro-batches are missing from the progress; raise spark.sql.streaming.numRecentProgressUpdates")
    return progress
