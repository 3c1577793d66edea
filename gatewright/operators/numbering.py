"""Row numbers per run without one window per run.

Rows are dealt to tasks by ranges of (run, order) that Spark samples, sorted inside the task and
written once. One small row per run and task then says where that task's share of the run begins,
so a run with very many rows is numbered by all tasks, and only the small rows meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.session import stage


def numbered(df: DataFrame, run: Sequence[str], order: Sequence[str | Column], out: str = "row_no",
             partitions: int | None = None) -> DataFrame:
    """`df` with `out`: the place of a row in its run by `order`, from 1; nulls sort first.

    Rows that tie in `order` are told apart by a hash of the whole row, so a bulk of ties is cut
    like any other rows. `partitions` is the number of ranges, by default that of shuffles.
    """
    # Maps have no hash; rows that differ in nothing else tie.
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    by = [*run, *order, F.xxhash64(*hashed)]
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions(*by)
    # The id grows by one from row to row inside a task, and is fixed once written.
    placed = stage(
        dealt.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "numbered"
    )
    shares = placed.groupBy(*run, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy(*run).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = shares.select(
        *[F.col(c).alias(f"__r_{c}") for c in run], F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
    )
    same = F.col("__part") == F.col("__p")
    for c in run:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return placed.join(starts, same).select(*df.columns, (F.col("__id") + F.col("__shift")).cast("bigint").alias(out))


def chunk_of(row_no: Column, rows: int) -> Column:
    """The chunk of `rows` rows that a row number falls in, from 1."""
    return (F.floor((row_no - 1) / F.lit(rows)) + 1).cast("bigint")
