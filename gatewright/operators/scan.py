"""Regex and term rules over lines and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import sql_str
from gatewright.sources.texts import lines_of, to_lines


def _test(rule: dict, col: str, mode: str = "") -> str:
    """SQL test of one rule: the plain texts a match needs, then its pattern."""
    pattern = f"rlike({col}, {sql_str(mode + rule['pattern'])})"
    if not rule.get("needs"):
        return pattern
    needs = " OR ".join(
        "(" + " AND ".join(f"contains({col}, {sql_str(t)})" for t in together) + ")" for together in rule["needs"]
    )
    return f"(({needs}) AND {pattern})"


def scan(lines: DataFrame, rules: Sequence[dict], col: str = "line", every: bool = False) -> DataFrame:
    """One row per (rule, line) hit, or with `every` per match; all rules are tested in one pass over the lines.

    A rule is a dict with `rule_id`, `pattern` and optionally `unless`, a pattern
    that lets a line off, and `needs`, plain texts a match cannot do without. Two
    entries of one rule are two tests, and a line may hit both.
    """
    hits = []
    for rule in rules:
        test = _test(rule, col)
        if rule.get("unless"):
            test += f" AND NOT rlike({col}, {sql_str(rule['unless'])})"
        times = f"regexp_count({col}, {sql_str(rule['pattern'])})" if every else "1"
        hits.append(f"CASE WHEN {test} THEN array_repeat({sql_str(rule['rule_id'])}, {times}) END")
    return lines.withColumn("rule_id", F.explode(F.expr(f"flatten(array_compact(array({', '.join(hits)})))")))


def scan_texts(df: DataFrame, id_cols: Sequence[str], text: str, rules: Sequence[dict], every: bool = False) -> DataFrame:
    """`scan` over the lines of whole texts.

    A line can only match when its text does (patterns are tried in multi-line
    mode, and none looks outside its match), so texts without any hit are dropped
    before they are cut into lines.
    """
    suspects = df.filter(F.expr(" OR ".join(_test(rule, text, "(?m)") for rule in rules)))
    if len(id_cols) == 1:
        return scan(to_lines(suspects, id_cols[0], text), rules, every=every)
    packed = suspects.withColumn("__id", F.struct(*id_cols))
    return scan(to_lines(packed, "__id", text), rules, every=every).select("__id.*", "line_no", "line", "rule_id")


def line_hits(text: str, rules: Sequence[dict]) -> str:
    """SQL array of (rule_id, line_no, line) hits of a text column, built inside its row.

    For plans that draw several kinds of facts from one reading of the texts.
    """
    anywhere = " OR ".join(_test(rule, text, "(?m)") for rule in rules)
    hits = []
    for rule in rules:
        test = _test(rule, "l")
        if rule.get("unless"):
            test += f" AND NOT rlike(l, {sql_str(rule['unless'])})"
        hits.append(
            f"CASE WHEN {test} THEN named_struct('rule_id', {sql_str(rule['rule_id'])}, 'line_no', i + 1, 'line', l) END"
        )
    lines = lines_of(text)
    return (
        f"CASE WHEN {anywhere} THEN flatten(transform({lines}, (l, i) -> array_compact(array({', '.join(hits)})))) END"
    )


def has_any(col: str, terms: Sequence[str], also: str | None = None) -> Column:
    """The text holds any of the terms and, when given, matches `also`."""
    test = " OR ".join(f"contains({col}, {sql_str(t)})" for t in terms)
    return F.expr(f"({test})" + (f" AND rlike({col}, {sql_str(also)})" if also else ""))


def contains_any(df: DataFrame, col: str, terms: Sequence[str], also: str | None = None,
                 out: str = "n_terms") -> DataFrame:
    """Rows whose text holds any of the terms, with how many and which first."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(col), t))
    return df.filter(has_any(col, terms, also)).withColumn(out, F.size(found)).withColumn(
        "first_term", F.element_at(found, 1)
    )


def one_pass(df: DataFrame, keep: Sequence[str], tests: Sequence[tuple]) -> DataFrame:
    """Several row rules in one reading: (keep, rule_id, member) for every test a row meets.

    A test is (rule_id, condition, member), or (rule_id, condition, member, times) for several hits of a row.
    """
    rows = [
        F.when(condition, F.array_repeat(
            F.struct(F.lit(rule_id).alias("rule_id"), member.cast("string").alias("member")), times[0] if times else F.lit(1)))
        for rule_id, condition, member, *times in tests
    ]
    return df.select(*keep, F.inline(F.flatten(F.array_compact(F.array(*rows)))))


def per_match(col: Column, pattern: str) -> Column:
    """An array with one element per match, to be exploded."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
