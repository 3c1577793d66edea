"""Findings, reports, recipients, issues, streams and user rules on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatewright.catalogue.advice import ADVICE, advice_table
from gatewright.catalogue.rules import RULES, SCAN_RULES
from gatewright.catalogue.templates import ROWS
from gatewright.extend import Rules
from gatewright.lifecycle import close_scope, context_forms, issue_keys, lifecycle, match_context, match_issue, upsert
from gatewright.operators.groups import after_terminal, inverted_pairs
from gatewright.plans.code_facts import code_facts
from gatewright.plans.code_rules import code_findings
from gatewright.reporting.findings import categorise, enrich, gate, gate_counts, union_findings
from gatewright.reporting.recipients import recipients
from gatewright.reporting.report import topk_overflow
from gatewright.schema import as_findings
from gatewright.session import fresh_dir
from gatewright.sources.sinks import read_latest, write_findings


def test_catalogue_is_complete():
    ids = [r[0] for r in RULES]
    assert len(ids) == len(set(ids)) == 72
    assert [a[0] for a in ADVICE] == ids and all(a[3] and a[4] for a in ADVICE)
    assert {r["rule_id"] for r in SCAN_RULES} <= set(ids)
    assert len(ROWS) == 144 and {r[1] for r in ROWS} == set(ids)


def _code(spark, *bodies):
    files = spark.createDataFrame([(i, f"src/F{i}.cs", b) for i, b in enumerate(bodies)], "file_id long, path string, text string")
    return {(r.rule_id, r.target, r.line_no, r.severity) for r in code_findings(code_facts(files)).collect()}


def test_code_rules_on_hand_made_texts(spark):
    """Lines, severities, the multiset rule, and text that only looks like code."""
    guard_ignored = "class A\n{\n    void M()\n    {\n        int n = 0;\n        int half = n;\n        var x = n > 0 ? 500 / half : 0;\n        var y = 9 / 3;\n    }\n}\n"
    quoted = 'class B\n{\n    void M()\n    {\n        // throw new Exception("x");\n        var s = "while (true) { }";\n        /* lock\n (this) { } */\n        Step();\n        return;\n        Step();\n    }\n}\n'
    nested = "class C\n{\n    void M()\n    {\n        while (a)\n        {\n            while (b)\n            {\n                var s = t.Substring(1);\n            }\n        }\n    }\n}\n"
    found = _code(spark, guard_ignored, quoted, nested)
    assert ("SAF002", "src/F0.cs", 7, "Error") in found
    assert not any(f[0] == "SAF002" and f[2] == 8 for f in found)
    assert not any(f[0] in ("SAF007", "SAF009", "CON004") for f in found)
    assert ("SAF006", "src/F1.cs", 11, "Warning") in found
    files = spark.createDataFrame([(1, "c.cs", nested)], "file_id long, path string, text string")
    twice = code_findings(code_facts(files)).filter("rule_id = 'PERF006'").count()
    assert twice == 2


def test_advice_and_category(spark):
    found = spark.createDataFrame([("SAF003", "", "x{limit}"), ("ZZZ1", " ", "y"), ("CQ001", "Mine", "m")], "rule_id string, category string, member string")
    rows = {r.rule_id: r for r in categorise(enrich(as_findings(found, actual=60, threshold=50), advice_table(spark))).collect()}
    assert rows["SAF003"].rationale.startswith("x{limit} holds") and rows["SAF003"].category == "Runtime Safety"
    assert (rows["ZZZ1"].category, rows["ZZZ1"].fix, rows["CQ001"].category) == ("General", "", "Mine")
    assert rows["CQ001"].rationale == "m runs over 60 lines, the limit is 50. Long bodies hide several jobs in one place."


def test_union_keeps_duplicates_and_gate(spark):
    one = as_findings(spark.createDataFrame([("r1", "Error"), ("r1", "Error"), ("r2", "Warning")], "run_id string, severity string"))
    found = union_findings([one, one])
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    got = {r.run_id: (r.errors, r.warnings, r.status, r.exit_code) for r in gate(gate_counts(runs, found)).collect()}
    assert got == {"r1": (4, 0, "ACTION REQUIRED", 1), "r2": (0, 2, "PASSED WITH ADVISORIES", 0), "r3": (0, 0, "PASSED", 0)}
    assert gate(gate_counts(runs, found), False).agg(F.max("exit_code")).first()[0] == 0


def test_top_rows_are_cut_before_the_shuffle(spark):
    base = fresh_dir(spark, "top-test")
    as_findings(spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.lit("Error").alias("severity"))).write.parquet(base)
    found = spark.read.parquet(base)
    assert "WindowGroupLimit" in topk_overflow(found, {"Error": 3})._jdf.queryExecution().executedPlan().toString()
    top = topk_overflow(found, {"Error": 3, "Warning": 2})
    rows = sorted((r.row_no, r.row_kind, r.more) for r in top.collect())
    assert rows == [(1, "row", 0), (2, "row", 0), (3, "row", 0), (4, "more", 497)]

def test_recipients(spark):
    df = spark.createDataFrame([(1, 1, "Ann@x, bob;  ANN@X\nzed@y"), (1, 2, "carl@z ann@x"), (2, 1, "nobody")], "run int, no int, raw string")
    got = sorted((r["at"].pos, r.address, r.role) for r in recipients(df, ["run"], ["no"], "raw").filter("run = 1").collect())
    assert [(a, role) for _, a, role in sorted(got, key=lambda g: g[2] != "To")][0] == ("Ann@x", "To")
    assert {a for _, a, _ in got} == {"Ann@x", "zed@y", "carl@z"}


def test_sink_is_repeatable(spark):
    base = fresh_dir(spark, "sink-test")
    df = spark.range(5)
    assert write_findings(df, base, "2024-01-01_00-00-00", enabled=False) is None
    for _ in range(2):
        write_findings(df, base, "2024-01-01_00-00-00")
    write_findings(spark.range(3), base, "2024-01-02_00-00-00")
    assert read_latest(spark, base).count() == 3 and spark.read.parquet(base + "/history").count() == 8


def test_pairs_and_terminal(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "a", "b"), (2, "a", "b"), (1, "c", "c")], "g int, a string, b string")
    assert [tuple(r) for r in inverted_pairs(pairs, ["g"]).collect()] == [(1, "a", "b", 2, 1)]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "stop"), (1, 3, "y"), (1, 4, "stop"), (1, 5, "z"), (2, 1, "stop")], "g int, at int, kind string")
    assert [tuple(r) for r in after_terminal(rows, ["g"], ["at"], F.col("kind") == "stop").collect()] == [(1, 3, "y")]


ISSUE = "issue_id long, title string, body string, labels array<string>, state string, opened_at int"


def _issues(spark):
    return spark.createDataFrame([
        (1, "❌ [Branch: fix]a]", "", [], "open", 1),
        (2, "t", "Critical Blocking Errors [Branch: dev] in src/Cart.cs:3", [], "open", 2),
        (3, "t", "[Branch: dev]", [], "open", 9),
        (4, "t", "b", ["code-quality-violation", "dev"], "open", 3),
        (5, "t", "b", ["code-quality-violation", "dev"], "closed", 8),
    ], ISSUE)


def test_issue_matching(spark):
    issues = _issues(spark)
    keys = {(r.issue_id, r.context_key) for r in issue_keys(issues).collect()}
    assert keys == {(1, "fix"), (1, "fix]a"), (2, "dev"), (4, "dev"), (5, "dev")}
    runs = spark.createDataFrame([("dev",), ("fix]a",), ("none",)], "context_key string")
    assert {r.context_key: r.issue_id for r in match_issue(runs, issues).collect()} == {"dev": 4, "fix]a": 1, "none": None}


def test_context_matching(spark):
    issues = spark.createDataFrame([
        (1, "❌ [PR #7]", "", [], "open", 1), (2, "t", "b", ["code-quality-violation", "pr-7"], "open", 5),
        (3, "t [Branch: fix]a]", "❌ Critical Blocking Errors", [], "open", 2), (4, "t", "b", ["code-quality-violation", "branch-fix]a"], "open", 1),
        (5, "[PR #70]", "Critical Blocking Errors", [], "open", 9), (6, "t", "b", ["pr-8"], "open", 9),
    ], ISSUE)
    label, tag = context_forms(F.col("pr"), F.col("branch"))
    runs = spark.createDataFrame([(7, "x"), (None, "fix]a"), (8, None), (None, ""), (70, None)], "pr int, branch string")
    got = match_context(runs.withColumns({"label": label, "tag": tag}), issues).collect()
    assert {(r.pr, r.branch): r.issue_id for r in got} == {(7, "x"): 2, (None, "fix]a"): 3, (8, None): None, (None, ""): None, (70, None): 5}


def test_issue_closing(spark):
    runs = spark.createDataFrame([(1, "fix", 5, True), (2, "other", 4, True), (3, "dev", 1, False), (4, "main", 9, True)],
                                 "run_id int, context_key string, ts int, passed boolean")
    files = spark.createDataFrame([(2, "app\\src/Cart.cs"), (2, "notes.md"), (3, "x/Cart.cs")], "run_id int, path string")
    got = {r.issue_id: (r.closed_at, r.closed_by) for r in close_scope(runs, _issues(spark), files).collect()}
    assert got == {1: (5, 1), 2: (4, 2), 4: (9, 4)}
    got = {r.issue_id for r in close_scope(runs.filter("run_id < 4"), _issues(spark), files).collect()}
    assert got == {1, 2}


def test_upsert(spark):
    cur = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, state string, opened int")
    inc = spark.createDataFrame([(2, "B"), (3, "C")], "k int, state string")
    got = sorted(tuple(r) for r in upsert(cur, inc, ["k"]).collect())
    assert [(k, s, a) for k, s, _, a in got] == [(1, "a", "kept"), (2, "B", "updated"), (3, "C", "inserted")]
    assert got[1][2] == 20


def test_rules_are_registered_once(spark):
    rules = Rules()
    rules.register("U1", lambda df: df)
    with pytest.raises(ValueError):
        rules.register("U1", lambda df: df)
