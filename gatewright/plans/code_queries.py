"""Registered queries: the rule catalogue over source-code texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.catalogue.advice import ADVICE, advice_table
from gatewright.catalogue.rules import RULE_SEVERITY, SCAN_RULES
from gatewright.catalogue.templates import expected_findings
from gatewright.operators.scan import scan_texts
from gatewright.plans.code_facts import code_facts
from gatewright.plans.code_rules import code_findings
from gatewright.plans.detect_queries import scan_sql
from gatewright.plans.fixtures import quoted
from gatewright.reporting.findings import ACTION, ADVISORIES, CATEGORIES, PASSED, enrich, gate, gate_counts
from gatewright.session import stage, table
from gatewright.sources.corpus import code_corpus, corpus_sql
from gatewright.sources.settings import gate_settings

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("rule_scan_code", f"WITH {corpus_sql()}, {scan_sql('code_corpus', 'file_id')} SELECT file_id, line_no, line, rule_id FROM scan_hits")
def rule_scan_code(spark, d):
    corpus = code_corpus(table(spark, d, "part"))
    return scan_texts(corpus.select("file_id", "text"), ["file_id"], "text", SCAN_RULES)


def corpus_findings(spark, d):
    """(corpus, findings) of all 72 rules over the code corpus."""
    corpus = stage(code_corpus(table(spark, d, "part")), "corpus")
    return corpus, code_findings(code_facts(corpus.select("file_id", "path", "text")))


@query("rule_catalogue_code", f"""
WITH {corpus_sql()}
SELECT rule_id, count(*) FILTER (violating) AS broken_files, count(*) FILTER (violating) AS flagged_broken,
       CAST(0 AS BIGINT) AS flagged_clean
FROM code_corpus GROUP BY rule_id
""")
def rule_catalogue_code(spark, d):
    """Each of the 72 rules flags all files that break it and none of its clean ones."""
    corpus, found = corpus_findings(spark, d)
    flagged = found.select(F.col("target").alias("path"), "rule_id").distinct().withColumn("flagged", F.lit(True))
    own = corpus.join(flagged, ["path", "rule_id"], "left")
    is_flagged = F.coalesce("flagged", F.lit(False))
    return own.groupBy("rule_id").agg(
        F.count_if("violating").alias("broken_files"),
        F.count_if(F.col("violating") & is_flagged).alias("flagged_broken"),
        F.count_if(~F.col("violating") & is_flagged).alias("flagged_clean"),
    )


_EXPECTED = expected_findings(RULE_SEVERITY)
EXPECTED_SQL = f"""
{corpus_sql()},
advice(rule_id, example, n_steps) AS (VALUES {", ".join(f"({quoted(r)}, {quoted(e)}, {len(s)})" for r, _, _, s, e in ADVICE)}),
category(prefix, category) AS (VALUES {", ".join(f"({quoted(p)}, {quoted(n)})" for p, n in CATEGORIES)}),
expected(tid, rule_id, line_no, end_line_no, severity) AS (VALUES {", ".join(f"({t}, {quoted(r)}, {n}, {e}, {quoted(s)})" for t, r, n, e, s in _EXPECTED)}),
findings AS (
  SELECT c.file_id, c.path AS target, regexp_extract(c.path, '/([^/_]+)_', 1) AS run_id, e.rule_id, e.line_no, e.end_line_no, e.severity
  FROM code_corpus c JOIN expected e ON e.tid = c.tid)
"""


def by_run(findings):
    """Findings with the run they belong to: the brand in the name of the file."""
    return findings.withColumn("run_id", F.regexp_extract("target", r"/([^/_]+)_", 1))


@query("code_findings_report", f"""
WITH {EXPECTED_SQL}
SELECT f.run_id, f.target, f.rule_id, category, f.line_no, f.end_line_no, f.severity, a.example, CAST(a.n_steps AS INT) AS n_steps
FROM findings f JOIN advice a ON a.rule_id = f.rule_id JOIN category ON regexp_extract(f.rule_id, '^[A-Z]+', 0) = prefix
""")
def code_findings_report(spark, d):
    """Every finding of the 72 rules in all files, those that break other rules too, with its advice."""
    found = enrich(by_run(corpus_findings(spark, d)[1]), advice_table(spark))
    return found.select("run_id", "target", "rule_id", "category", "line_no", "end_line_no", "severity", "example", F.size("steps").alias("n_steps"))


def gate_of(corpus, found):
    """Counts, status and exit code of each run that has files."""
    runs = by_run(corpus.select(F.col("path").alias("target"))).select("run_id").distinct()
    return gate(gate_counts(runs, found)).select("run_id", "errors", "warnings", "infos", "status", "exit_code")


def gate_sql(source: str) -> str:
    """`gate_of` over the table `source` of findings (run_id, severity)."""
    return f"""
counted AS (
  SELECT r.run_id, count(*) FILTER (s.severity = 'Error') AS errors, count(*) FILTER (s.severity = 'Warning') AS warnings, count(*) FILTER (s.severity = 'Info') AS infos
  FROM (SELECT DISTINCT regexp_extract(path, '/([^/_]+)_', 1) AS run_id FROM code_corpus) r LEFT JOIN {source} s ON s.run_id = r.run_id GROUP BY r.run_id)
SELECT run_id, errors, warnings, infos,
       CASE WHEN errors > 0 THEN '{ACTION}' WHEN warnings > 0 THEN '{ADVISORIES}' ELSE '{PASSED}' END AS status,
       CAST(errors > 0 AS INT) AS exit_code FROM counted
"""


@query("code_gate_status", f"WITH {EXPECTED_SQL}, {gate_sql('findings')}")
def code_gate_status(spark, d):
    """The gate of each run over a whole scan."""
    corpus, found = corpus_findings(spark, d)
    return gate_of(corpus, by_run(found))


#: What changed in a file, by its number modulo 4: nothing, its first statement, all lines, a line without code.
CHANGES = [(1, 7, 7), (2, 1, 400), (3, 2, 2)]


def corpus_changes(corpus):
    """(path, line_no) of a change that leaves a quarter of the files out."""
    runs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(a).alias("first"), F.lit(b).alias("last")) for m, a, b in CHANGES])
    return corpus.select(F.col("path"), F.explode(F.filter(runs, lambda r: r.m == F.col("file_id") % 4)).alias("r")).select(
        F.upper("path").alias("path"), F.explode(F.sequence("r.first", "r.last")).alias("line_no"))


@query("code_gate_diff", f"""
WITH {EXPECTED_SQL}, changes(m, first, last) AS (VALUES {", ".join(map(str, CHANGES))}),
touched AS (
  SELECT f.* FROM findings f LEFT JOIN changes c ON c.m = f.file_id % 4
  WHERE f.rule_id NOT IN ('CQ001', 'CQ003') AND (f.rule_id = 'CON001'
    OR (f.end_line_no > 0 AND (c.m IS NULL OR (c.first <= f.end_line_no AND c.last >= f.line_no)))
    OR (f.end_line_no = 0 AND f.line_no BETWEEN c.first AND c.last))),
{gate_sql('touched')}
""")
def code_gate_diff(spark, d):
    """The gate of each run over a change, with settings that raise two limits.

    A file that did not change keeps its measured spans and no findings in lines.
    """
    corpus = stage(code_corpus(table(spark, d, "part")), "corpus")
    raw = spark.range(1).select(F.lit('{"MaxMethodLines": 100, "maxparametercount": 9, "unknown": 1}').alias("raw"))
    found = code_findings(code_facts(corpus.select("file_id", "path", "text")), corpus_changes(corpus), gate_settings(raw, "raw"))
    return gate_of(corpus, by_run(found))
