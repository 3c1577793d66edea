"""Rows and texts of reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.functions.text import (
    COMMENT_KEEP, COMMENT_LIMIT_CHARS, SUMMARY_KEEP, SUMMARY_LIMIT_BYTES, escape_data, escape_property, truncate_text,
)
from gatewright.operators.numbering import chunk_of, numbered
from gatewright.reporting.findings import ACTION, ADVISORIES, PASSED, categorise
from gatewright.schema import ERROR, WARNING

# How many rows a report shows.
ERROR_ROWS = 50
WARNING_ROWS = {"comment": 10, "summary": 25}
BLUEPRINT_ROWS = {ERROR: 15, WARNING: 5}
CHUNK_ROWS = 500
# Status lines, badges, table heads and the notice of a cut.
HEADS = {
    PASSED: "## ✅ Code Quality Gate: **PASSED**",
    ADVISORIES: "## ⚠️ Code Quality Gate: **PASSED WITH ADVISORIES**",
    ACTION: "## 🚨 Code Quality Check: **ACTION REQUIRED**",
}
BADGES = {ERROR: "❌ **Error**", WARNING: "⚠️ **Warning**"}
TABLE_HEAD = (
    "| Severity | Rule | Location | Target | Actual vs Limit | Recommended Remediation |",
    "| :---: | :--- | :--- | :--- | :---: | :--- |",
)
RUN_FACTS = {"files": "Files analyzed", "commit_sha": "Commit", "analyzed_at": "Analysis time"}
CUT_NOTICE = "\n\n(cut: the findings table holds the rest)"
# `seq` alone may tie (two rules on one line, folded ids); rows that tie here too are equal in a report.
ORDER = ["seq", "target", "rule_id", "line_no", "end_line_no", "member", "description"]


def file_groups(findings: DataFrame, only_errors: bool = True, group: tuple[str, ...] = ("run_id", "target")) -> DataFrame:
    """Display rows with the place of their file: files in first-seen order.

    Rows stay rows; `group_seq` (the file's first `seq`) and `group_rows` come from
    one small row per file, so a file with very many findings is never gathered.
    Sort by (run_id, group_seq, target) and ORDER to print.
    """
    shown = findings.filter(F.col("severity") == ERROR) if only_errors else findings
    firsts = shown.groupBy(*group).agg(F.min("seq").alias("group_seq"), F.count("*").alias("group_rows"))
    return shown.join(firsts, list(group))


def topk_overflow(findings: DataFrame, k_by_severity: Mapping[str, int], run: str = "run_id") -> DataFrame:
    """The first k rows per run and severity, plus one "and N more" row where k was exceeded.

    Adds `row_kind` ("row" / "more"), `row_no` and, for the extra row, `more`.
    The rank filter is cut to k rows per task before the shuffle.
    """
    limit: Column = F.lit(None).cast("int")
    for severity, k in k_by_severity.items():
        limit = F.when(F.col("severity") == severity, k).otherwise(limit)
    graded = findings.filter(F.col("severity").isin(list(k_by_severity)))
    w = W.partitionBy(run, "severity").orderBy(*[c for c in ORDER if c in findings.columns])
    # The largest k bounds the rank first: a constant bound is what the optimizer pushes down.
    top = (
        graded.withColumn("row_no", F.row_number().over(w))
        .filter(F.col("row_no") <= max(k_by_severity.values()))
        .filter(F.col("row_no") <= limit)
        .withColumn("row_kind", F.lit("row"))
        .withColumn("more", F.lit(0).cast("bigint"))
    )
    over = (
        graded.groupBy(run, "severity").agg(F.count("*").alias("__n"))
        .withColumn("row_no", limit + 1)
        .withColumn("more", F.col("__n") - limit)
        .filter(F.col("more") > 0)
        .withColumn("row_kind", F.lit("more"))
        .drop("__n")
    )
    return top.unionByName(over, allowMissingColumns=True)


def blueprints(findings: DataFrame, rows: Mapping[str, int] = BLUEPRINT_ROWS, run: str = "run_id") -> DataFrame:
    """The first findings per severity that carry steps or an example, errors first."""
    carried = findings.filter((F.size("steps") > 0) | (F.trim("example") != ""))
    top = topk_overflow(carried, rows, run).filter(F.col("row_kind") == "row").drop("row_kind", "more")
    order = list(rows)
    place: Column = F.lit(len(order))
    for i, severity in enumerate(order):
        place = F.when(F.col("severity") == severity, i).otherwise(place)
    return top.withColumn("severity_place", place)


def metric_cell(severity: Column, actual: Column, threshold: Column) -> Column:
    return F.when(
        threshold > 0, F.format_string("**%d** (Max: %d)", actual, threshold)
    ).otherwise(F.when(severity == ERROR, "Critical Error").otherwise("Advisory"))


def annotation(path: Column | None = None) -> Column:
    """One annotation line of a finding. The severity Info is shown as a warning."""
    command = F.when(F.col("severity") == ERROR, "error").otherwise("warning")
    title = F.concat(F.col("rule_id"), F.lit(": "), F.col("rule_name"))
    message = F.concat(F.col("description"), F.lit(" -> How to fix: "), F.col("fix"))
    return F.concat(
        F.lit("::"), command, F.lit(" file="), F.col("target") if path is None else path,
        F.lit(",line="), F.col("line_no").cast("string"),
        F.lit(",endLine="), F.col("end_line_no").cast("string"),
        F.lit(",title="), escape_property(title), F.lit("::"), escape_data(message),
    )


def annotations(findings: DataFrame) -> DataFrame:
    return findings.withColumn("annotation", annotation())


def table_row() -> Column:
    """A markdown table row for a "row" or a "more" line of `topk_overflow`."""
    badge = F.when(F.col("severity") == ERROR, BADGES[ERROR]).otherwise(BADGES[WARNING])
    full = F.concat(
        F.lit("| "), badge, F.lit(" | `"), F.col("rule_id"), F.lit("` "), F.col("rule_name"),
        F.lit(" | `"), F.col("target"), F.lit(":"), F.col("line_no").cast("string"),
        F.lit("` | `"), F.col("member"), F.lit("` | "),
        metric_cell(F.col("severity"), F.col("actual"), F.col("threshold")),
        F.lit(" | "), F.col("fix"), F.lit(" |"),
    )
    more = F.concat(
        F.lit("| "), badge, F.lit(" | and "), F.col("more").cast("string"),
        F.lit(" more | - | - | - | see the findings table |"),
    )
    return F.when(F.col("row_kind") == "more", more).otherwise(full)


def _join_sorted(rows: Column) -> Column:
    """Collected (place, no, text) structs as lines in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "\n")


def blueprint_text() -> Column:
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("  1. "), s)), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("#### ["), F.col("rule_id"), F.lit("] "), F.col("rule_name"), F.lit(" `"),
                 F.col("target"), F.lit(":"), F.col("line_no").cast("string"), F.lit("`")),
        F.concat(F.lit("- Problem: "), F.col("description")),
        F.when(F.trim("rationale") != "", F.concat(F.lit("- Why: "), F.col("rationale"))),
        F.when(F.size("steps") > 0, steps),
        F.when(F.trim("example") != "", F.concat(F.lit("```\n"), F.col("example"), F.lit("\n```"))),
    )


def report_text(runs: DataFrame, findings: DataFrame, kind: str = "summary", with_blueprints: bool = True) -> DataFrame:
    """(run_id, report): one markdown text per run.

    `runs` is the output of `gate`, with any of the columns of RUN_FACTS. Texts over the size of
    their kind are cut. What is gathered per run is bounded by the row
    limits of the report kind: at most 52 + 27 table rows and 20 blueprints.
    """
    rows = topk_overflow(findings, {ERROR: ERROR_ROWS, WARNING: WARNING_ROWS[kind]})
    sev_place = F.when(F.col("severity") == ERROR, 0).otherwise(1)
    lines = rows.select(
        "run_id", F.lit("table").alias("part"),
        F.struct(sev_place.alias("place"), F.col("row_no").alias("no"), table_row().alias("text")).alias("row"),
    )
    if with_blueprints:
        lines = lines.unionByName(
            blueprints(findings).select(
                "run_id", F.lit("blueprint").alias("part"),
                F.struct(F.col("severity_place").alias("place"), F.col("row_no").alias("no"),
                         blueprint_text().alias("text")).alias("row"),
            )
        )
    body = lines.groupBy("run_id").agg(
        _join_sorted(F.collect_list(F.when(F.col("part") == "table", F.col("row")))).alias("__table"),
        _join_sorted(F.collect_list(F.when(F.col("part") == "blueprint", F.col("row")))).alias("__blue"),
    )
    head = F.when(F.col("status") == PASSED, HEADS[PASSED]).when(F.col("status") == ADVISORIES, HEADS[ADVISORIES]).otherwise(HEADS[ACTION])
    counts = F.concat_ws(
        "\n", F.concat(F.lit("- Errors: "), F.col("errors").cast("string")), F.concat(F.lit("- Warnings: "), F.col("warnings").cast("string")),
        *[F.concat(F.lit(f"- {shown}: "), F.col(name).cast("string")) for name, shown in RUN_FACTS.items() if name in runs.columns],
    )
    header = "\n".join(TABLE_HEAD)
    text = F.when(F.col("status") == PASSED, F.concat_ws("\n", head, counts)).otherwise(
        F.concat_ws(
            "\n", head, counts, F.lit(header), F.when(F.col("__table") != "", F.col("__table")),
            F.when(F.coalesce(F.col("__blue"), F.lit("")) != "", F.concat(F.lit("### Blueprints\n"), F.col("__blue"))),
        )
    )
    if kind == "summary":
        text = truncate_text(text, SUMMARY_LIMIT_BYTES, SUMMARY_KEEP, CUT_NOTICE, "bytes")
    else:
        text = truncate_text(text, COMMENT_LIMIT_CHARS, COMMENT_KEEP, CUT_NOTICE)
    return runs.join(body, "run_id", "left").select("run_id", text.alias("report"))


def _error_line() -> Column:
    return F.concat(
        F.lit("| `"), F.col("rule_id"), F.lit("` "), F.col("rule_name"), F.lit(" | "), F.col("category"), F.lit(" | `"),
        F.col("target"), F.lit(":"), F.col("line_no").cast("string"), F.lit("` | `"), F.col("member"), F.lit("` | "),
        metric_cell(F.col("severity"), F.col("actual"), F.col("threshold")), F.lit(" | "), F.col("fix"), F.lit(" |"),
    )


def error_report(findings: DataFrame) -> DataFrame:
    """All errors of all runs as rows: (run_id, group_seq, target, seq, rule_id, line, blueprint).

    The report of a run is its rows sorted by (group_seq, target) and ORDER; it has no limit, so
    it stays rows and is never one text.
    """
    return file_groups(categorise(findings), only_errors=True).select(
        "run_id", "group_seq", "target", "seq", "rule_id", _error_line().alias("line"), blueprint_text().alias("blueprint"))


def error_chunks(findings: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """The error report of each run as numbered pieces: (run_id, chunk, first_row, n_rows, text).

    A piece has `rows` lines of the report, the last one of a run what is left. Rows are numbered by
    ranges over all tasks (`numbered`), so what is gathered in one place is one piece.
    """
    shown = file_groups(categorise(findings), only_errors=True).withColumn("line", _error_line())
    order = ["group_seq", *ORDER, "line"]
    lines = numbered(shown.select("run_id", "target", *[c for c in order if c != "target"]), ["run_id"], ["group_seq", "target", *order[1:]])
    return lines.groupBy("run_id", chunk_of(F.col("row_no"), rows).alias("chunk")).agg(
        F.min("row_no").alias("first_row"), F.count("*").alias("n_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("text"),
    )
