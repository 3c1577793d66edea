"""Measures of texts, spans and owners, and how they are graded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.schema import ERROR, WARNING
from gatewright.session import inline_table

# Limits and grading policy of the measured rules.
#   ratio:  Error when the measure exceeds factor x limit
#   offset: Error when the measure exceeds limit + step
#   second: Error when the measure exceeds a second, fixed limit
#   constant: never an Error
POLICY_ROWS = [
    ("CQ001", 50, "ratio", 1.5),
    ("CQ002", 10, "ratio", 1.5),
    ("CQ003", 4, "offset", 2.0),
    ("CQ004", 3, "offset", 1.0),
    ("CQ005", 300, "constant", 0.0),
    ("CQ006", 5, "constant", 0.0),
    ("CQ007", 15, "second", 25.0),
    ("CQ008", 3, "constant", 0.0),
    ("CQ009", 20, "constant", 0.0),
]


def policy(spark, rows=None) -> DataFrame:
    return inline_table(
        spark, POLICY_ROWS if rows is None else rows,
        "rule_id string, threshold int, policy string, policy_value double",
    )


def grade(df: DataFrame, policy_df: DataFrame, otherwise: Column | None = None) -> DataFrame:
    """Keep measures above their rule's limit and give each its severity.

    `df` has (rule_id, actual). The policy holds one row per rule, so it is as
    small as the rule catalogue; Spark broadcasts it when its size allows. With
    `otherwise`, rows of rules without a policy are kept and get that severity.
    """
    worse = (
        F.when(F.col("policy") == "ratio", F.col("threshold") * F.col("policy_value"))
        .when(F.col("policy") == "offset", F.col("threshold") + F.col("policy_value"))
        .when(F.col("policy") == "second", F.col("policy_value"))
    )
    graded = F.when(F.col("actual") > worse, ERROR).otherwise(WARNING)
    if otherwise is None:
        kept = df.join(policy_df, "rule_id").filter(F.col("actual") > F.col("threshold"))
    else:
        kept = df.join(policy_df, "rule_id", "left").filter(
            F.col("policy").isNull() | (F.col("actual") > F.col("threshold"))
        )
        graded = F.when(F.col("policy").isNull(), otherwise).otherwise(graded)
    return kept.withColumn("severity", graded).drop("policy", "policy_value")


def span_length(spans: DataFrame, limit: int = 50, start: str = "start_line", end: str = "end_line",
                error_factor: float = 1.5) -> DataFrame:
    """Spans longer than `limit` lines, both ends counted."""
    length = F.col(end) - F.col(start) + 1
    return (
        spans.withColumn("actual", length.cast("int"))
        .filter(F.col("actual") > limit)
        .withColumn("threshold", F.lit(limit))
        .withColumn("severity", F.when(F.col("actual") > limit * error_factor, ERROR).otherwise(WARNING))
    )


def branch_score(df: DataFrame, text: str, token_regex: str, limit: int = 10,
                 error_factor: float = 1.5) -> DataFrame:
    """Texts whose score, 1 plus the number of branch tokens, exceeds `limit`."""
    score = F.regexp_count(F.col(text), F.lit(token_regex)) + 1
    return (
        df.withColumn("actual", score.cast("int"))
        .filter(F.col("actual") > limit)
        .withColumn("threshold", F.lit(limit))
        .withColumn("severity", F.when(F.col("actual") > limit * error_factor, ERROR).otherwise(WARNING))
    )


def child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                limit: int = 4, error_step: int | None = 2) -> DataFrame:
    """Owners with more than `limit` children.

    Children are counted before the join, so the join meets one row per owner
    however many children a hot owner has.
    """
    counts = (
        child.groupBy(F.col(child_key).alias("__owner")).agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > limit)
    )
    graded = F.lit(WARNING)
    if error_step is not None:
        graded = F.when(F.col("__n") > limit + error_step, ERROR).otherwise(WARNING)
    return (
        parent.join(counts, F.col(parent_key) == F.col("__owner"))
        .withColumn("actual", F.col("__n").cast("int"))
        .withColumn("threshold", F.lit(limit))
        .withColumn("severity", graded)
        .drop("__owner", "__n")
    )


def _found(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def nesting_depth(df: DataFrame, text: str, token_regex: str, close_regex: str,
                  out: str = "depth") -> DataFrame:
    """Deepest open nesting of a text: openers count +1, closers -1, in order.

    One fold over the tokens of the row; nothing is exploded or shuffled.
    """
    step = F.aggregate(
        _found(text, token_regex),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, tok: F.transform(
            F.array(acc["now"] + F.when(tok.rlike(close_regex), -1).otherwise(1)),
            lambda n: F.struct(n.alias("now"), F.greatest(acc["top"], n).alias("top")),
        )[0],
        lambda acc: acc["top"],
    )
    return df.withColumn(out, F.coalesce(step, F.lit(0)))


def deep_nesting(df: DataFrame, text: str, token_regex: str, close_regex: str, limit: int = 3,
                 body_levels: int = 1) -> DataFrame:
    """Texts nested deeper than `limit`; the outermost `body_levels` do not count."""
    measured = nesting_depth(df, text, token_regex, close_regex, "__depth")
    actual = F.greatest(F.col("__depth") - body_levels, F.lit(0))
    return (
        measured.withColumn("actual", actual.cast("int"))
        .drop("__depth")
        .filter(F.col("actual") > limit)
        .withColumn("threshold", F.lit(limit))
        .withColumn("severity", F.when(F.col("actual") > limit + 1, ERROR).otherwise(WARNING))
    )


def weighted_depth(df: DataFrame, text: str, open_regex: str, close_regex: str,
                   flat_regex: str | None = None, out: str = "score") -> DataFrame:
    """Each branch token adds 1 + the number of branches open around it, each flat token 1."""
    parts = [p for p in (open_regex, close_regex, flat_regex) if p]
    pattern = "|".join(f"(?:{p})" for p in parts)

    def step(acc: Column, tok: Column) -> Column:
        closes = tok.rlike(f"^(?:{close_regex})$")
        opens = tok.rlike(f"^(?:{open_regex})$")
        now = F.when(closes, acc["now"] - 1).when(opens, acc["now"] + 1).otherwise(acc["now"])
        add = F.when(closes, 0).when(opens, acc["now"] + 1).otherwise(1)
        return F.struct(now.alias("now"), (acc["score"] + add).alias("score"))

    score = F.aggregate(
        _found(text, pattern),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("score")),
        step,
        lambda acc: acc["score"],
    )
    return df.withColumn(out, F.coalesce(score, F.lit(0)))


def measures(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of (rule_id, target, actual) measures, ready for `grade`."""
    out = frames[0].select("rule_id", "target", "actual")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("rule_id", "target", "actual"))
    return out
