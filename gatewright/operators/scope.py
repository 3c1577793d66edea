"""Limiting rules to what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.intervals import block_at, cover
from gatewright.session import stage

WORD = 64  # lines per bit mask, the bits of a bigint
REACH = 64  # masks per row that spans meet


def _bits(first: Column, last: Column) -> Column:
    """A mask with the bits first..last of a word."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(WORD - 1) - (last - first)).cast("int"))
    return F.call_function("shiftleft", ones, first.cast("int"))


def _word_bits(word: Column, first: Column, last: Column) -> Column:
    """The bits of a word that stand for lines first..last."""
    return _bits(F.greatest(first - word * WORD, F.lit(0)), F.least(last - word * WORD, F.lit(WORD - 1)))


def _word(line: Column) -> Column:
    return F.floor(line / WORD).cast("bigint")


def lay_line_spans(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """`bounds` once per place to look for a changed line: (level, block, wanted).

    The first and the last word of a span are looked up with the bits wanted there (level -1),
    the words between as dyadic blocks, any bit of which counts.
    """
    first, last = _word(F.col(start)), _word(F.col(end))
    entry = lambda level, block, wanted: F.struct(
        level.cast("int").alias("level"), block.cast("bigint").alias("block"), wanted.cast("bigint").alias("wanted"))
    edges = F.array_distinct(F.transform(F.array(first, last), lambda w: entry(F.lit(-1), w, _word_bits(w, F.col(start), F.col(end)))))
    inner = F.transform(cover(first + 1, last - 1), lambda b: entry(b.level, b.block, F.lit(-1)))
    return bounds.withColumn("__at", F.explode(F.concat(edges, inner))).select("*", "__at.*").drop("__at")


def _pack(masks: DataFrame, key: str) -> DataFrame:
    """The masks of a key in one row per REACH words: (key, __near, __masks)."""
    return masks.groupBy(key, _near(F.col("__w")).alias("__near")).agg(F.collect_list(F.struct("__w", "__mask")).alias("__masks"))


def _near(word: Column) -> Column:
    return F.floor(word / REACH).cast("bigint")


def _scope_far(spans: DataFrame, masks: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans over more than one row of masks that hold a changed line.

    A span looks at the masks of its two ends and at dyadic blocks of the
    words between, so a span of any length is a few rows and the join an equi join on (key, level, block).
    """
    # Verdicts are worked out once per distinct bounds.
    reach = lay_line_spans(spans.select(key, start, end).distinct(), start, end)
    levels = reach.filter("level >= 0").agg(F.collect_set("level")).scalar()
    coarse = masks.select(key, "__w", F.explode(levels).alias("level")).select(
        key, "level", block_at(F.col("__w"), F.col("level")).alias("block"), F.lit(-1).cast("bigint").alias("__mask"))
    marks = masks.select(key, F.lit(-1).alias("level"), F.col("__w").alias("block"), "__mask").unionByName(coarse.distinct())
    touched = (
        reach.join(marks, [key, "level", "block"]).filter(F.col("__mask").bitwiseAND(F.col("wanted")) != 0)
        .select(key, start, end).distinct()
    )
    return spans.join(touched, [key, start, end], "left_semi").select(spans.columns)


def scope_spans(spans: DataFrame, changed: DataFrame | None, key: str = "path_key", start: str = "start_line",
                end: str = "end_line", line: str = "line_no", last_line: str | None = None) -> DataFrame:
    """Spans holding at least one changed line.

    `changed` has a row per line, or per run of lines if `last_line` names its end.
    No change table at all, or no changed line for a span's key, keeps the span.
    Bounds are inclusive, lines count from 0 or 1. Duplicates of a span are kept or
    dropped together.

    The changed lines of a key are packed into one bit mask per 64 lines, an
    aggregate with map-side combine, and the masks of REACH words into one row, both written once. A span inside
    one such row, nearly every one, meets it and the changed keys by two equi joins in one reading of the spans;
    others are met over dyadic blocks.
    """
    if changed is None:
        return spans
    runs = changed.select(F.col(key), F.col(line).cast("bigint").alias("__f"), F.col(last_line or line).cast("bigint").alias("__l")).filter("__l >= __f")
    words = runs.withColumn("__w", F.explode(F.sequence(_word(F.col("__f")), _word(F.col("__l")))))
    masks = words.groupBy(key, "__w").agg(F.bit_or(_word_bits(F.col("__w"), F.col("__f"), F.col("__l"))).alias("__mask"))
    packed = stage(_pack(masks, key), "masks")
    known = packed.select(F.col(key).alias("__key")).distinct().withColumn("__known", F.lit(True))

    first, last = _word(F.col(start)), _word(F.col(end))
    far = (F.col(end) >= F.col(start)) & (_near(first) != _near(last))
    is_far = F.coalesce(far, F.lit(False))
    near_row = packed.select(F.col(key).alias("__k"), F.col("__near").alias("__n"), "__masks")
    holds = F.exists("__masks", lambda m: (m["__w"] >= first) & (m["__w"] <= last) & (
        m["__mask"].bitwiseAND(_word_bits(m["__w"], F.col(start), F.col(end))) != 0))
    hit = ~is_far & (F.col(end) >= F.col(start)) & holds
    near = (
        spans.join(near_row, (F.col(key) == F.col("__k")) & (_near(first) == F.col("__n")), "left")
        .withColumn("__hit", F.coalesce(hit, F.lit(False))).select(*spans.columns, "__hit")
        .join(known, F.col(key) == F.col("__key"), "left")
        .filter(F.col("__hit") | F.col("__known").isNull()).select(spans.columns)
    )
    loose = packed.select(key, F.inline("__masks"))
    return near.unionByName(_scope_far(spans.filter(is_far), loose, key, start, end))


def scope_lines(findings: DataFrame, changed: DataFrame | None = None, path: str = "target",
                line: str = "line_no") -> DataFrame:
    """Line findings on a changed line; paths are compared without case.

    `None` keeps everything. An empty change table keeps nothing.
    """
    if changed is None:
        return findings
    lines = changed.select(
        F.lower("path").alias("__path"), F.col("line_no").alias("__line")
    ).distinct()
    return findings.join(
        lines, (F.lower(path) == F.col("__path")) & (F.col(line) == F.col("__line")), "left_semi"
    )


def changed_counts(files: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Number of changed lines of each file, 0 when it has none."""
    counts = (
        changed.select(F.lower("path").alias("__path"), "line_no").distinct()
        .groupBy("__path").agg(F.count("*").alias("__n"))
    )
    return (
        files.join(counts, F.lower(F.col(path)) == F.col("__path"), "left")
        .withColumn("changed_lines", F.coalesce("__n", F.lit(0)))
        .drop("__path", "__n")
    )
