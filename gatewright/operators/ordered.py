"""Ordered per-key operators that stay balanced when one key is hot.

A plain window sends all rows of a key to one task. Here the rows of a hot key are
cut into blocks of the order column. Each block is reduced to one small row with
map-side combine, and a window over those small rows gives the state entering each
block. That state joins its block as one more row, in front of the others, so the
fine window inside (key, block) needs one shuffle and one sort of the data and no
join. `RowBlocks` sizes the blocks by row counts and leaves all other keys whole. It
counts the rows of keys first; without a hot key the plain window is the plan, which
gives the same rows. Large tables are then dealt to more tasks, so what a task sorts does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.operators.numbering import chunk_of, numbered

_BLOCK, _SEED = "__block", "__seed"


def seq_block(seq: Column | str, width: int = 100_000) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(width)).cast("bigint")


@dataclass(frozen=True)
class RowBlocks:
    """Blocks of `target_rows` rows for keys with more rows than that; other keys stay whole.

    The rows of hot keys are numbered in order over ranges that Spark samples and cut by their numbers, so
    a burst is cut as finely as it is dense, and rows of one position are cut like any others. The hot
    keys number at most rows / target_rows, and Spark broadcasts them only when their size allows.
    """

    target_rows: int = 1_000_000
    task_rows: int = 500_000

    def most(self, df: DataFrame, keys: Sequence[str]) -> int:
        """Rows of the largest key, from one count over the key columns."""
        return self.sizes(df, keys)[0]

    def sizes(self, df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
        """Rows of the largest key and of all keys, from one count over the key columns."""
        most, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
        return most or 0, rows or 0

    def deal(self, df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
        """`df` dealt by its keys to tasks of about `task_rows` rows, where Spark's own number of tasks would leave more in each."""
        n = -(-rows // self.task_rows)
        return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df

    def assign(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        """`df` with its block along `order`, null for the rows of keys that stay whole."""
        hot = df.groupBy(*keys).count().filter(F.col("count") > self.target_rows)
        hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        marked = df.join(hot, same, "left").select(*df.columns, "__hot")
        cut = numbered(marked.filter("__hot").drop("__hot"), keys, order, "__no")
        cut = cut.withColumn(_BLOCK, chunk_of(F.col("__no"), self.target_rows)).drop("__no")
        whole = marked.filter("__hot IS NULL").drop("__hot").withColumn(_BLOCK, F.lit(None).cast("bigint"))
        return whole.unionByName(cut)


def _seeded(df: DataFrame, keys: Sequence[str], block: Column | DataFrame, state_agg: Column,
            entering: Column) -> DataFrame:
    """`df` with its block, plus one seed row per (keys, block) whose `__v` is the entering state.

    `block` is the block column, or `df` with its blocks already.
    """
    cut = df.withColumn(_BLOCK, block) if isinstance(block, Column) else block
    cut = cut.withColumn(_SEED, F.lit(False))
    small = (
        cut.filter(F.col(_BLOCK).isNotNull()).groupBy(*keys, _BLOCK).agg(state_agg.alias("__state"))
        .withColumn("__v", entering)
    )
    seeds = small.filter(F.col("__v").isNotNull()).select(
        *[
            F.col(f.name) if f.name in (*keys, _BLOCK) else
            F.col("__v").cast(f.dataType).alias("__v") if f.name == "__v" else
            F.lit(True).alias(_SEED) if f.name == _SEED else
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in cut.schema.fields
        ]
    )
    return cut.union(seeds)


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | RowBlocks | None) -> tuple[DataFrame, Column | DataFrame | None]:
    """`df`, and what `_seeded` takes as its blocks, or None where one plain window over `df` does."""
    if not isinstance(block, RowBlocks):
        return df, block
    most, rows = block.sizes(df, keys)
    return (block.deal(df, keys, rows), None) if most <= block.target_rows else (df, block.assign(df, keys, order))


def _data(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(_SEED)).drop("__v", _SEED, _BLOCK)


def _grouped(keys: Sequence[str], value: Column) -> Column:
    """A row with a null key belongs to no group and gets null."""
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    return F.when(has_key, value)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | RowBlocks | None,
                value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """Add the latest non-null `value` of an earlier row of the same key.

    Without `block` one plain window does the work: for keys that cannot grow, such
    as a part of one text.
    """
    df = df.withColumn("__v", value)
    df, block = _blocks(df, keys, order, block)
    if block is None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumn(out, _grouped(keys, F.last("__v", ignorenulls=True).over(whole))).drop("__v")
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__v").alias("v"))
    earlier = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    seeded = _seeded(
        df, keys, block,
        F.max(F.when(F.col("__v").isNotNull(), at)), F.last("__state", ignorenulls=True).over(earlier)["v"],
    )
    upto = 0 if inclusive else -1
    inside = W.partitionBy(*keys, _BLOCK).orderBy(F.desc(_SEED), *order).rowsBetween(W.unboundedPreceding, upto)
    return _data(seeded.withColumn(out, _grouped(keys, F.last("__v", ignorenulls=True).over(inside))))


def next_after(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | RowBlocks,
               value: Column, out: str) -> DataFrame:
    """Add the first non-null `value` of a later row of the same key."""
    df = df.withColumn("__v", value)
    df, block = _blocks(df, keys, order, block)
    if block is None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
        return df.withColumn(out, _grouped(keys, F.first("__v", ignorenulls=True).over(whole))).drop("__v")
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__v").alias("v"))
    later = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(1, W.unboundedFollowing)
    seeded = _seeded(
        df, keys, block,
        F.min(F.when(F.col("__v").isNotNull(), at)), F.first("__state", ignorenulls=True).over(later)["v"],
    )
    # The state that follows a block stands behind its rows; read backwards it comes first.
    backwards = [F.desc(c) for c in order]
    inside = W.partitionBy(*keys, _BLOCK).orderBy(F.desc(_SEED), *backwards).rowsBetween(W.unboundedPreceding, -1)
    return _data(seeded.withColumn(out, _grouped(keys, F.last("__v", ignorenulls=True).over(inside))))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | RowBlocks,
                  amount: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Add the running sum of `amount` over the rows of the same key."""
    df = df.withColumn("__v", amount.cast("bigint"))
    upto = 0 if inclusive else -1
    df, block = _blocks(df, keys, order, block)
    if block is None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
        return df.withColumn(out, _grouped(keys, F.coalesce(F.sum("__v").over(whole), F.lit(0)).cast("bigint"))).drop("__v")
    earlier = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    seeded = _seeded(df, keys, block, F.sum("__v"), F.sum("__state").over(earlier))
    inside = W.partitionBy(*keys, _BLOCK).orderBy(F.desc(_SEED), *order).rowsBetween(W.unboundedPreceding, upto)
    total = F.coalesce(F.sum("__v").over(inside), F.lit(0)).cast("bigint")
    return _data(seeded.withColumn(out, _grouped(keys, total)))
