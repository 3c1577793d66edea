"""Findings of a text corpus: the flagship flow from texts to one findings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.catalogue.advice import ADVICE
from gatewright.catalogue.rules import RULE_NAME, RULE_SEVERITY, SCAN_RULES
from gatewright.functions.text import sql_lookup
from gatewright.operators.groups import empty_groups
from gatewright.operators.metrics import POLICY_ROWS, grade, policy
from gatewright.operators.scan import line_hits
from gatewright.plans.detect_queries import scan_sql
from gatewright.plans.fixtures import quoted
from gatewright.reporting.findings import union_findings
from gatewright.schema import WARNING, as_findings, seq_of
from gatewright.session import spread, table
from gatewright.sources.texts import lines_of

SEP_TOKENS = "[,;]"
SECRET = next(r["pattern"] for r in SCAN_RULES if r["rule_id"] == "SEC002")
UNLABELLED = "DOC001"


def doc_findings(spark, d):
    """Findings over `documents`; a run is one source and language.

    All facts that need the text (line hits, length, separators) are drawn from one
    reading of it. The label check reads keys only.
    """
    docs = table(spark, d, "documents").select(
        "doc_id", "text", F.concat_ws("/", "source", "lang").alias("run_id")
    )
    texts = spread(docs, "doc_id")
    target = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))

    facts = texts.select(
        "doc_id", "run_id",
        F.expr(f"""inline(concat(
            array(named_struct('rule_id', 'CQ001', 'place', 2000000, 'line_no', 1, 'line', '', 'actual', size({lines_of("text")})),
                  named_struct('rule_id', 'CQ002', 'place', 3000000, 'line_no', 1, 'line', '', 'actual', regexp_count(text, '{SEP_TOKENS}') + 1)),
            coalesce(transform({line_hits("text", SCAN_RULES)},
                h -> named_struct('rule_id', h.rule_id, 'place', 1000000 + h.line_no, 'line_no', h.line_no, 'line', h.line, 'actual', 0)), array())))"""),
    )
    graded = grade(facts, policy(spark), sql_lookup("rule_id", RULE_SEVERITY))
    hit = F.col("actual") == 0
    found = as_findings(
        graded,
        target=target,
        rule_name=sql_lookup("rule_id", RULE_NAME),
        member=F.when(hit, F.lower(F.regexp_extract("line", SECRET, 1))).otherwise(target),
        end_line_no=F.when(hit, F.col("line_no")),
        description=F.when(hit, F.format_string("Line %d matches %s", "line_no", "rule_id"))
        .otherwise(F.format_string("Measured %d, allowed %d", "actual", "threshold")),
        seq=seq_of(F.col("doc_id"), F.col("place"), 8_000_000),
        vars=F.when(hit, F.create_map(F.lit("line"), F.col("line"))),
    )
    bare = as_findings(
        empty_groups(docs.drop("text"), table(spark, d, "labels"), ["doc_id"]),
        rule_id=UNLABELLED, rule_name="Document Without Label", target=target, member=target, severity=WARNING,
        description="No label: 100%, nobody, looked", fix="Label it",
        seq=seq_of(F.col("doc_id"), 4_000_000, 8_000_000),
    )
    return union_findings([found, bare])


_LIMIT = {r[0]: r[1] for r in POLICY_ROWS}

FINDINGS_SQL = f"""
{scan_sql("documents", "doc_id")},
docs AS (SELECT doc_id, text, source || '/' || lang AS run_id, 'doc-' || doc_id AS target FROM documents),
rule_names(rule_id, rule_name, rule_severity) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)}, {quoted(RULE_SEVERITY[k])})" for k, v in RULE_NAME.items())}),
measured AS (
  SELECT doc_id, run_id, target, 'CQ001' AS rule_id, 2 AS no, len(string_split(text, chr(10))) AS actual, {_LIMIT["CQ001"]} AS threshold FROM docs
  UNION ALL SELECT doc_id, run_id, target, 'CQ002', 3, len(regexp_extract_all(text, '{SEP_TOKENS}')) + 1, {_LIMIT["CQ002"]} FROM docs),
findings AS (
  SELECT d.run_id, h.doc_id * 8000000 + 1000000 + h.line_no AS seq, h.rule_id, n.rule_name, '' AS category, d.target,
         lower(regexp_extract(h.line, {quoted(SECRET)}, 1)) AS member, h.line_no, h.line_no AS end_line_no, 0 AS actual, 0 AS threshold,
         n.rule_severity AS severity, 'Line ' || h.line_no || ' matches ' || h.rule_id AS description, '' AS fix
  FROM scan_hits h JOIN docs d ON d.doc_id = h.doc_id JOIN rule_names n ON n.rule_id = h.rule_id
  UNION ALL
  SELECT run_id, doc_id * 8000000 + no * 1000000, m.rule_id, n.rule_name, '', target, target, 1, 0, CAST(actual AS INT), threshold,
         CASE WHEN actual > threshold * 1.5 THEN 'Error' ELSE 'Warning' END, 'Measured ' || actual || ', allowed ' || threshold, ''
  FROM measured m JOIN rule_names n ON n.rule_id = m.rule_id WHERE actual > threshold
  UNION ALL
  SELECT run_id, doc_id * 8000000 + 4000000, '{UNLABELLED}', 'Document Without Label', '', target, target, 0, 0, 0, 0,
         'Warning', 'No label: 100%, nobody, looked', 'Label it'
  FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels))
"""


def _list(items):
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def _fill(col):
    out = col
    for name, value in (("member", "member"), ("target", "target"), ("actual", "CAST(actual AS VARCHAR)"), ("limit", "CAST(threshold AS VARCHAR)")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


ENRICHED_SQL = f"""
advice(rule_id, a_rationale, a_fix, a_steps, a_example) AS (VALUES
{", ".join(f"({quoted(r)}, {quoted(w)}, {quoted(f)}, {_list(s)}, {quoted(e)})" for r, w, f, s, e in ADVICE)}),
enriched AS (
  SELECT f.* EXCLUDE (fix), coalesce({_fill('a_rationale')}, '') AS rationale, coalesce({_fill('a_fix')}, fix) AS fix,
         coalesce(array_to_string(list_transform(a_steps, lambda s: {_fill('s')}), chr(10)), '') AS steps_text,
         coalesce(a_example, '') AS example
  FROM findings f LEFT JOIN advice a ON a.rule_id = f.rule_id)
"""
