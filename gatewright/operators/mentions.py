"""Which texts mention which needles, by the rarest run of each needle instead of a pairwise test.

A needle can only stand in a text that holds all its runs of words, so one run, the one that
fewest texts hold, is enough to look for it (prefix filtering with prefixes of one, ordered by frequency). Texts list
their runs once and meet those of needles as keys alone; the frequencies are counted from what was met, and a needle with a run that no text
holds is given up. Only texts that hold a rarest run are fetched, once for each bounded set of needles, and tested for the whole strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import stage

GRAM_WORDS = 3
ANCHOR_CHARS = 16
#: Needles that are tested together against one copy of a text, on average.
TOGETHER = 4096


def _gram(words: str, at: str) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{at} + {k}]" for k in range(GRAM_WORDS)) + ")"


def _rarest(met: DataFrame, listed: DataFrame, id_col: str) -> DataFrame:
    """(id, needle) by the rarest anchor of each needle: `met` is (id, anchor), `listed` (needle, at, anchor).

    A needle of which an anchor is in no text is in no text itself.
    """
    counts = met.groupBy("anchor").agg(F.count("*").alias("texts"))
    chosen = (
        listed.join(counts, "anchor", "left").groupBy("needle")
        .agg(F.min_by("anchor", F.struct(F.coalesce("texts", F.lit(0)), "at")).alias("anchor"), F.min(F.coalesce("texts", F.lit(0))).alias("texts"))
        .filter("texts > 0").select("needle", "anchor")
    )
    return met.join(chosen, "anchor").select(id_col, "needle")


def candidates(texts: DataFrame, id_col: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (id, needle) of texts that hold the rarest run of a needle.

    Runs of needles with at least five words are three inner words, as outer words may be cut off in
    a longer word of the text. Shorter needles have one run, their first 16 characters.
    """
    wanted = needles.select(F.col(needle).alias("needle")).filter(F.col("needle") != "").distinct()
    worded = wanted.withColumn("__w", F.split("needle", r"\s+"))
    long_needle = F.size("__w") >= GRAM_WORDS + 2

    # Inner runs only: they start at the second word and end before the last.
    inner = F.expr(f"transform(sequence(1, size(__w) - {GRAM_WORDS + 1}), i -> {_gram('__w', 'i')})")
    short = worded.filter(~long_needle).select(
        "needle", F.lit(0).alias("at"), F.xxhash64(F.substring("needle", 1, ANCHOR_CHARS), F.lit("chars")).alias("anchor"),
        F.least(F.length("needle"), F.lit(ANCHOR_CHARS)).alias("size"))
    listed = stage(
        worded.filter(long_needle).select("needle", F.posexplode(inner).alias("at", "anchor"), F.lit(0).alias("size")).unionByName(short), "needle-runs")

    # Only the lengths that occur are cut out of the texts: at most 16 of them.
    sizes = listed.filter("size > 0").agg(F.collect_set("size").alias("sizes")).scalar()
    any_long = listed.agg(F.coalesce(F.bool_or(F.col("size") == 0), F.lit(False))).scalar()
    runs = F.expr(f"transform(sequence(0, size(__w) - {GRAM_WORDS}), i -> {_gram('__w', 'i')})")
    cut = F.flatten(F.transform("__sizes", lambda size: F.when(F.length(text) >= size, F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.xxhash64(F.substr(F.col(text), i, size), F.lit("chars")))
    ).otherwise(F.array().cast("array<bigint>"))))
    none = F.array().cast("array<bigint>")
    held = (
        texts.select(id_col, text).withColumns({"__w": F.split(F.col(text), r"\s+"), "__sizes": sizes, "__long": any_long})
        .select(id_col, F.explode(F.array_distinct(F.concat(
            F.when(F.col("__long") & (F.size("__w") >= GRAM_WORDS), runs).otherwise(none), F.coalesce(cut, none)))).alias("anchor"))
    )
    met = stage(held.join(listed.select("anchor").distinct(), "anchor", "left_semi"), "runs-met")
    return _rarest(met, listed, id_col).distinct()


def _tested(texts: DataFrame, id_col: str, text: str, found: DataFrame) -> DataFrame:
    """`texts` (id, text) once per set of needles (`needles`, an array) to test."""
    parts = found.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("needle") / TOGETHER))).scalar()
    sets = found.groupBy(id_col, F.pmod(F.xxhash64("needle"), parts).alias("__part")).agg(F.collect_set("needle").alias("needles"))
    return texts.select(id_col, text).join(sets.drop("__part"), id_col)


def mention_pairs(texts: DataFrame, id_col: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (id, needle) where the text contains the needle, as exact substrings."""
    tested = _tested(texts, id_col, text, candidates(texts, id_col, text, needles, needle))
    return tested.select(id_col, F.explode(F.filter("needles", lambda n: F.contains(F.col(text), n))).alias("needle")).distinct()


def holds_any(text: Column, needles: Column) -> Column:
    """Whether a text contains one of an array of needles; stops at the first."""
    return F.exists(needles, lambda n: F.contains(text, n))


def mentions(texts: DataFrame, id_col: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Texts mentioning at least one needle."""
    tested = _tested(texts, id_col, text, candidates(texts, id_col, text, needles, needle))
    return texts.join(tested.filter(holds_any(F.col(text), F.col("needles"))).select(id_col).distinct(), id_col, "left_semi")
