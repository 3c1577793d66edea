"""One findings table: union, advice, category, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import fill
from gatewright.schema import ERROR, INFO, WARNING, as_findings

# Category by rule-id prefix and the gate's three states.
CATEGORIES = [
    ("CQ", "Code Quality"),
    ("SAF", "Runtime Safety"),
    ("CON", "Concurrency"),
    ("SEC", "Security"),
    ("PERF", "Performance"),
    ("ARCH", "Architecture"),
]
PASSED, ADVISORIES, ACTION = "PASSED", "PASSED WITH ADVISORIES", "ACTION REQUIRED"


def union_findings(frames: Sequence[DataFrame]) -> DataFrame:
    """All rule outputs as one findings table; duplicates are kept."""
    out = as_findings(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(as_findings(frame))
    return out


def category_of(rule_id: Column) -> Column:
    out: Column = F.lit("General")
    for prefix, name in reversed(CATEGORIES):
        out = F.when(rule_id.startswith(prefix), name).otherwise(out)
    return out


def categorise(findings: DataFrame) -> DataFrame:
    """A set category wins, else the rule-id prefix decides."""
    given = F.when(F.trim("category") != "", F.col("category"))
    return findings.withColumn("category", F.coalesce(given, category_of(F.col("rule_id"))))


def enrich(findings: DataFrame, advice: DataFrame) -> DataFrame:
    """Fill rationale, fix, steps and example from the advice of each rule.

    Advice has one row per rule, a table of catalogue size. A finding whose rule
    has no advice keeps what it has.
    """
    dim = advice.select(
        "rule_id",
        F.col("rationale").alias("__rationale"), F.col("fix").alias("__fix"),
        F.col("steps").alias("__steps"), F.col("example").alias("__example"),
    )
    v = F.map_concat(
        F.create_map(
            F.lit("member"), F.col("member"), F.lit("target"), F.col("target"),
            F.lit("actual"), F.col("actual").cast("string"), F.lit("limit"), F.col("threshold").cast("string"),
        ),
        F.map_filter(F.col("vars"), lambda k, _: ~k.isin("member", "target", "actual", "limit")),
    )
    return (
        findings.join(dim, "rule_id", "left")
        .withColumn("__v", v)
        .withColumn("rationale", F.coalesce(fill(F.col("__rationale"), F.col("__v")), "rationale"))
        .withColumn("fix", F.coalesce(fill(F.col("__fix"), F.col("__v")), "fix"))
        .withColumn(
            "steps", F.coalesce(F.transform("__steps", lambda s: fill(s, F.col("__v"))), F.col("steps"))
        )
        .withColumn("example", F.coalesce("__example", "example"))
        .select(findings.columns)
    )


def gate_counts(runs: DataFrame, findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Errors, warnings and infos of every run, 0 when it has none."""
    counts = findings.groupBy(key).agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
        F.count_if(F.col("severity") == INFO).alias("infos"),
    )
    zero = F.lit(0).cast("bigint")
    return runs.join(counts, key, "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("errors", "warnings", "infos")}
    )


def gate(counts: DataFrame, fail_on_errors: Column | bool = True) -> DataFrame:
    """Status and exit code of each run; infos do not weigh."""
    fails = fail_on_errors if isinstance(fail_on_errors, Column) else F.lit(fail_on_errors)
    return counts.withColumn(
        "status",
        F.when(F.col("errors") > 0, ACTION).when(F.col("warnings") > 0, ADVISORIES).otherwise(PASSED),
    ).withColumn("exit_code", F.when((F.col("errors") > 0) & fails, 1).otherwise(0))
