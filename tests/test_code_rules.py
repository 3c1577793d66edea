"""Rules over small source texts: how many findings of which rules, in which lines."""

from collections import Counter
from dataclasses import replace

import pytest

from gatewright.catalogue.templates import ROWS
from gatewright.plans.code_facts import code_facts
from gatewright.plans.code_rules import code_findings, scope_findings
from gatewright.session import stage
from gatewright.sources.corpus import code_corpus
from gatewright.sources.settings import gate_settings

CHAIN = "".join(f"int v{i} = v{i - 1}; " for i in range(1, 60))
BODY = "class C {{\n    void Run(int t)\n    {{\n        {}\n    }}\n}}"

TEXTS = {
    "deep_chain": (BODY.format(f"int v0 = 0; {CHAIN}\n        Use(t / v59);"), [("SAF002", 5)]),
    "difference": (BODY.format("int a = 0; int ab = 0; int b = 3; int d = a - b;\n        Use(t / d);"), []),
    "signed": (BODY.format("int z = -(0);\n        Use(t / z);"), [("SAF002", 5)]),
    "two_types": ("class A\n{\n    int rate = 0;\n}\nclass B\n{\n    int rate = 5;\n    int Go(int t)\n    {\n        return t / rate;\n    }\n}", []),
    "own_field": ("class A\n{\n    int rate = 0;\n    int Go(int t)\n    {\n        return t / rate;\n    }\n}", [("SAF002", 6)]),
    "getter": ("class A\n{\n    int Half\n    {\n        get\n        {\n            int z = 0;\n            return 9 / z;\n        }\n    }\n}", [("SAF002", 8)]),
    "constructor": ("class Item\n{\n    public Item(int a, int b, int c, int d, int e)\n    {\n        Keep(a);\n    }\n}", [("CQ003", 3)]),
    "long_constructor": ("class Item\n{\n    public Item(int a, int b, int c, int d, int e, int f)\n    {\n        Keep(a);\n    }\n}", [("CQ003", 3), ("CQ006", 3)]),
    "nested_types": ("class C\n{\n    void Go(M<A, M<A, M<A, M<A, B>>>> x)\n    {\n        Step();\n    }\n}", []),
    "results": (BODY.format("Use(a.Result, b.Result, c.Result);"), [("CON003", 4)] * 3),
    "substrings": (BODY.format("foreach (var x in xs)\n        {\n            Use(x.Substring(1) + y.Substring(2));\n        }"), [("PERF006", 6)] * 2),
    "locks": ("class C\n{\n" + "".join(
        f"    void M{i}()\n    {{\n        lock ({a})\n        {{\n            lock ({b}) {{ Step(); }}\n        }}\n    }}\n"
        for i, (a, b) in enumerate([("l", "r"), ("r", "l"), ("r", "l")])) + "}", [("CON001", 12), ("CON001", 19)]),
}
WATCHED = {"SAF002", "CQ003", "CQ006", "CON001", "CON003", "PERF006"}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"{name}.cs", text) for i, (name, (text, _)) in enumerate(TEXTS.items())]
    files = spark.createDataFrame(rows, "file_id bigint, path string, text string")
    return [(r.target, r.rule_id, r.line_no, r.member) for r in code_findings(code_facts(files)).collect()]


@pytest.mark.parametrize("name", TEXTS)
def test_findings(found, name):
    assert sorted((rule, line) for target, rule, line, _ in found if target == f"{name}.cs" and rule in WATCHED) == sorted(TEXTS[name][1])


def test_lock_members(found):
    assert sorted(m for t, r, _, m in found if r == "CON001") == ["M1", "M2"]


def test_scope_and_settings(spark):
    """No change given, changed lines, a file without any, and limits from settings."""
    text = BODY.format("Use(a.Result);\n        Use(b.Result);") + "\n" + TEXTS["constructor"][0] + "\n" + TEXTS["locks"][0]
    files = spark.createDataFrame([(1, "Src\\One.cs", text), (2, "src/Two.cs", text)], "file_id bigint, path string, text string")
    facts = code_facts(files)
    of = lambda found: sorted((r.target[4:7], r.rule_id, r.line_no) for r in found.collect() if r.rule_id in WATCHED)
    both = lambda *hits: [(f, *h) for f in ("One", "Two") for h in hits]
    locks = [("CON001", 26), ("CON001", 33)]
    assert of(code_findings(facts)) == sorted(both(("CON003", 4), ("CON003", 5), ("CQ003", 10), *locks))
    schema = "path string, line_no int"
    some = spark.createDataFrame([("src/one.cs", 5), ("src/one.cs", 12), ("src/Two.cs", 99)], schema)
    assert of(code_findings(facts, some)) == sorted([("One", "CON003", 5), ("One", "CQ003", 10), *both(*locks)])
    none = spark.createDataFrame([], schema)
    assert of(code_findings(facts, none)) == sorted(both(("CQ003", 10), *locks))
    loose = gate_settings(spark.createDataFrame([('{"maxparametercount": 5}',)], "raw string"), "raw")
    assert of(code_findings(facts, none, loose)) == sorted(both(*locks))


def test_scoped_findings_run_the_rules_once(spark):
    """A change meets the findings as they are written, not a plan of all rules for each of its joins."""
    rows = [("a.cs", "CQ001", 4, 9), ("A.cs", "CON003", 5, 0), ("a.cs", "CON003", 6, 0), ("b.cs", "CQ001", 1, 2), ("b.cs", "CON003", 1, 0), ("b.cs", "CON001", 1, 0)]
    source = stage(spark.createDataFrame(rows, "target string, rule_id string, line_no int, end_line_no int"), "rules_run_here")
    found = scope_findings(source, spark.createDataFrame([("a.cs", 5)], "path string, line_no int"))
    assert "rules_run_here" not in found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|") and not any(
        "rules_run_here" in f for f in found.inputFiles())
    assert sorted(tuple(r) for r in found.collect()) == sorted([rows[0], rows[1], rows[3], rows[5]])


def test_corpus_is_dealt_before_texts_are_made(spark):
    part = spark.range(10_000).coalesce(1).selectExpr("id as p_partkey", "'a b' as p_name", "'Brand#1' as p_brand")
    corpus = code_corpus(part)
    assert corpus.rdd.getNumPartitions() == 3 and corpus.count() == 10_000


def test_inside_is_written_flat(spark):
    """Rules read the columns they ask for; what only asks about scopes around a statement joins nothing."""
    rows = [(1, "a.cs", TEXTS["getter"][0]), (2, "b.cs", TEXTS["own_field"][0]), (None, "c.cs", TEXTS["getter"][0])]
    facts = code_facts(spark.createDataFrame(rows, "file_id bigint, path string, text string"))
    plan = facts.inside._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {(r.file_id, r.text): (r.var_scope, r.type_scope, r.p_scope) for r in facts.stmts.collect()}
    assert got[(1, "int z = 0")] == ("1:3", "1:1", "1:3") and got[(2, "int rate = 0")] == (None, "2:1", "2:1")
    assert {r[0] for r in facts.inside.filter("text = 'int z = 0'").select("scope_id").collect()} == {"1:1", "1:2", "1:3"}


def test_repeated_file_keeps_all_pairs(spark):
    """Two rows of one file: each of its two segments meets both paths, and the eight scopes that the copies make of one."""
    rows = [(1, "a.cs", "class A\n{\n    int x;\n}")] * 2
    facts = code_facts(spark.createDataFrame(rows, "file_id bigint, path string, text string"))
    assert facts.stmts.filter("text = 'int x'").count() == 4
    assert [tuple(r) for r in facts.inside.filter("text = 'int x'").groupBy("scope_id").count().collect()] == [("1:1", 32)]


PLAIN = "class C\n{\n" + "".join(f"    private int n{i};\n" for i in range(300)) + "    void Run()\n    {\n" + "        Step(1);\n" * 50 + "    }\n}"
ODD = [
    "class C\n{\n    static int total; int Rate; public int open; string line;\n    void Run(C c)\n    {\n        total ??= 1; total <<= 2; int Big_Name; string T;\n"
    "        while (true) { if (a) { T += x; } }\n        { return; }\n        ;\n        Step();\n        Step();\n    }\n    int doIt(int x);\n}",
    "interface IMark\n{\n}\ninterface IOpen\n{\n    ;\n}\ninterface IFull\n{\n    { }\n}\nclass D\n{\n    void Run()\n    {\n        try { } catch (E e) { ; } try { } catch { { } }\n"
    "        for (int i = 0; i < 3; i++) { var p = new P { Name = x }; lock (a) { lock (b) { Step(); } } }\n        return; }\n    }\n    void Next() { lock (b) { lock (a) { } } }\n}",
    "class E\n{\n    int zero = 0;\n    int Go(int t) { var Left = zero; int r = Left; switch (t) { case 1: break; } return t % r; }\n    void Empty() { }\n    enum Kind { A }\n",
]


def test_rules_read_the_statements_they_ask_for(spark):
    """Plain statements are in no table that the rules read, and no rule finds more among all statements."""
    assert code_facts(spark.createDataFrame([(1, "a.cs", PLAIN)], "file_id bigint, path string, text string")).held.count() < 10
    texts = [r[4].replace("{id}", "7").replace("{name}", "a_b") for r in ROWS] + [t for t, _ in TEXTS.values()] + ODD + [PLAIN]
    rows = [(i, f"Domain/{i}.cs", t) for i, t in enumerate(texts)]
    # Copies of one number: the same text, another text, none, and texts without a number.
    rows += [(1000 + i, f"x{c}.cs", t) for i, (a, b) in enumerate([(ODD[0], ODD[0]), (ODD[1], ODD[2]), (ODD[2], None)]) for c, t in enumerate((a, b))]
    rows += [(None, "n.cs", ODD[0]), (None, "m.cs", ODD[1])]
    facts = code_facts(spark.createDataFrame(rows, "file_id bigint, path string, text string"))
    of = lambda facts: Counter((r.target, r.rule_id, r.member, r.line_no, r.actual, r.severity) for r in code_findings(facts).collect())
    found = of(facts)
    assert len(found) > 150 and found == of(replace(facts, asked=facts.stmts, held=facts.inside))
