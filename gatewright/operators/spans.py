"""Tokens of a text and the spans they open and close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.operators.ordered import RowBlocks, next_after, running_total


def tokens(df: DataFrame, id_cols: Sequence[str], text: str, pattern: str) -> DataFrame:
    """(ids, tok_no, token): matches of a pattern in order, numbered from 1."""
    return df.select(
        *id_cols, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    ).select(*id_cols, (F.col("pos") + 1).alias("tok_no"), F.col("col").alias("token"))


def positioned_tokens(df: DataFrame, id_cols: Sequence[str], text: str, pattern: str) -> DataFrame:
    """`tokens` plus `pos`, the 1-based character position of each match.

    The text is cut at every match; a running length inside the row gives the
    positions, so the text is read once and never shuffled.
    """
    matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    sizes = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches,
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("token")),
    )
    listed = df.filter(F.col(text).rlike(pattern)).select(*id_cols, F.posexplode(sizes))
    w = W.partitionBy(*id_cols).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum(F.col("col.gap") + F.col("col.len")).over(w)
    return listed.select(
        *id_cols,
        (F.col("pos") + 1).alias("tok_no"),
        F.col("col.token").alias("token"),
        (upto - F.col("col.len") + 1).cast("bigint").alias("pos"),
    )


def pair_spans(toks: DataFrame, keys: Sequence[str], delta: Column, order: str = "tok_no",
               keep: Sequence[str] = (), block: Column | RowBlocks | None = None) -> DataFrame:
    """Pair each opener (`delta` = 1) with the closer (-1) that ends it.

    An opener's level is the running sum after it, a closer's is the sum before it,
    so the partner is the next token of the same level. An opener whose next
    same-level token is no closer stays unpaired. With `block` (see `ordered`) the
    work of one key is spread; without it a key must be one text, as in `tokens`.
    Gives keys, `span_no`, open/close of `order`, `depth` and for every column of
    `keep` its value at both ends.
    """
    marked = toks.withColumn("__d", delta).filter(F.col("__d").isin(1, -1))
    if block is None:
        upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        marked = marked.withColumn("__sum", F.sum("__d").over(upto))
    else:
        marked = running_total(marked, keys, [order], block, F.col("__d"), "__sum")
    level = F.when(F.col("__d") == 1, F.col("__sum")).otherwise(F.col("__sum") + 1)
    levelled = marked.withColumn("__level", level.cast("int"))
    end = F.struct(F.col("__d").alias("d"), F.col(order).alias("at"), *[F.col(c) for c in keep])
    if block is None:
        nxt = W.partitionBy(*keys, "__level").orderBy(order)
        paired = levelled.withColumn("__end", F.lead(end).over(nxt))
    else:
        paired = next_after(levelled, [*keys, "__level"], [order], block, end, "__end")
    return paired.filter((F.col("__d") == 1) & (F.col("__end.d") == -1)).select(
        *keys,
        F.col(order).alias("open_no"),
        F.col("__end.at").alias("close_no"),
        F.col("__level").alias("depth"),
        *[F.col(c).alias(f"open_{c}") for c in keep],
        *[F.col(f"__end.{c}").alias(f"close_{c}") for c in keep],
    )
