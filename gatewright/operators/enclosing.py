"""Items inside enclosing spans, by range joins over dyadic blocks of position buckets.

A span is listed once per dyadic block of the buckets it covers, so a span over any number of
buckets is a few rows; an item is listed once per level that occurs among spans, which is one where all spans are
short. The join has the equi key (document, level, block), every pair is met once, and a long document is
spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.intervals import block_at, cover


def point_bucket(pos: Column | str, width: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("bigint")


def lay_spans(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """`spans` once per dyadic block (`__b`: level and block) of the buckets of start..end; none for a reversed span."""
    return spans.withColumn("__b", F.explode(cover(point_bucket(start, width), point_bucket(end, width))))


def in_scope(items: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str = "pos",
             start: str = "start_pos", end: str = "end_pos", width: int = 2048,
             same: tuple[str, str] | None = None) -> DataFrame:
    """(item, span) for every span with start < pos < end: once per enclosing span.

    `same` = (item column, span column) also asks for equal values there. Span
    columns other than the keys must not clash with item columns.
    """
    laid = lay_spans(spans, start, end, width)
    levels = laid.agg(F.sort_array(F.collect_set("__b.level"))).scalar()
    placed = items.withColumn("__l", F.explode(levels)).withColumn("__b", block_at(point_bucket(pos, width), F.col("__l")))
    renamed = laid.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        F.col("__b.level").alias("__sl"), F.col("__b.block").alias("__sb"),
        *[c for c in spans.columns if c not in keys],
    )
    on = (F.col("__l") == F.col("__sl")) & (F.col("__b") == F.col("__sb")) & (F.col(start) < F.col(pos)) & (F.col(pos) < F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__s_{k}"))
    if same:
        on = on & (F.col(same[0]) == F.col(same[1]))
    return placed.join(renamed, on).drop("__l", "__b", "__sl", "__sb", *[f"__s_{k}" for k in keys])


def enclosing_chains(items: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str = "pos",
                     start: str = "start_pos", end: str = "end_pos", width: int = 256, out: str = "chain") -> DataFrame:
    """Each item with the spans around it (start < pos < end) as an array of structs, outermost first; null without any.

    The spans over a bucket are put into one row, `width` and the depth of nesting at most if spans do not cross, so an
    item meets one row and is not shuffled again to gather its spans. A span over n positions is n / width + 2 rows.
    """
    fields = [start, *[c for c in spans.columns if c not in (*keys, start)]]
    buckets = F.explode(F.sequence(point_bucket(start, width), point_bucket(end, width))).alias("__b")
    held = (
        spans.select(*keys, F.struct(*fields).alias("__s"), buckets)
        .groupBy(*keys, "__b").agg(F.sort_array(F.collect_list("__s")).alias("__spans"))
    )
    around = F.filter("__spans", lambda s: (s[start] < F.col(pos)) & (F.col(pos) < s[end]))
    return (
        items.withColumn("__b", point_bucket(pos, width)).join(held, [*keys, "__b"], "left")
        .withColumn(out, around).withColumn(out, F.when(F.size(out) > 0, F.col(out))).drop("__b", "__spans")
    )


def in_scope_same_key(items: DataFrame, spans: DataFrame, keys: Sequence[str],
                      same: tuple[str, str], exempt: DataFrame | None = None,
                      item_id: Sequence[str] = ("pos",), **kw) -> DataFrame:
    """`in_scope` for items naming the scope's own key.

    `exempt` holds spans (same keys and bound names) whose items are let off.
    """
    hits = in_scope(items, spans, keys, same=same, **kw)
    if exempt is None:
        return hits
    freed = in_scope(
        items.select(*dict.fromkeys([*keys, *item_id, kw.get("pos", "pos")])), exempt, keys, **kw
    ).select(*keys, *item_id).distinct()
    return hits.join(freed, [*keys, *item_id], "left_anti")
