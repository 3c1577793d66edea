"""Registered queries: findings, gate, reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.catalogue.advice import advice_table
from gatewright.functions.text import (
    DATA_ESCAPES, HTML_ESCAPES, html_escape, local_shown, local_stamp, relative_path, truncate_text,
)
from gatewright.plans.doc_findings import ENRICHED_SQL, FINDINGS_SQL, doc_findings
from gatewright.plans.fixtures import documents
from gatewright.reporting.findings import ACTION, ADVISORIES, PASSED, categorise, enrich, gate, gate_counts
from gatewright.reporting.recipients import recipients
from gatewright.reporting.report import (
    BADGES, CUT_NOTICE, HEADS, TABLE_HEAD, annotations, blueprints, error_chunks, error_report, file_groups, metric_cell, report_text,
    topk_overflow,
)
from gatewright.schema import ERROR, WARNING
from gatewright.session import stage, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def enriched(spark, d):
    return enrich(doc_findings(spark, d), advice_table(spark))


def stored_findings(spark, d):
    """The findings written once, for reports that read them several times."""
    return stage(doc_findings(spark, d), "findings")


def all_runs(spark, d):
    """Every source with every language it has, and one run per region that finds nothing."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("run_id"))
    return docs.unionByName(table(spark, d, "region").select(F.col("r_name").alias("run_id"))).distinct()


RUNS_SQL = """
runs AS (SELECT DISTINCT source || '/' || lang AS run_id FROM documents UNION SELECT r_name FROM region),
counts AS (
  SELECT r.run_id, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings,
         count(*) FILTER (severity = 'Info') AS infos
  FROM runs r LEFT JOIN findings f ON f.run_id = r.run_id GROUP BY r.run_id),
gates AS (SELECT *, CASE WHEN errors > 0 THEN 'ACTION REQUIRED' WHEN warnings > 0 THEN 'PASSED WITH ADVISORIES' ELSE 'PASSED' END AS status FROM counts)
"""

PLAIN = ["run_id", "seq", "rule_id", "rule_name", "category", "target", "member", "line_no", "end_line_no", "actual",
         "threshold", "severity", "description", "fix"]


@query("findings_union", f"WITH {FINDINGS_SQL} SELECT {', '.join(PLAIN)} FROM findings")
def findings_union(spark, d):
    return doc_findings(spark, d).select(PLAIN)


@query("findings_enrich", f"WITH {FINDINGS_SQL}, {ENRICHED_SQL} SELECT seq, rule_id, member, rationale, fix, steps_text, example FROM enriched")
def findings_enrich(spark, d):
    return enriched(spark, d).select(
        "seq", "rule_id", "member", "rationale", "fix", F.array_join("steps", "\n").alias("steps_text"), "example"
    )


@query("findings_category", f"""
WITH {FINDINGS_SQL}
SELECT seq, rule_id, CASE WHEN seq % 3 = 0 AND rule_id LIKE 'CQ%' THEN 'Own' WHEN rule_id LIKE 'CQ%' THEN 'Code Quality'
  WHEN rule_id LIKE 'SEC%' THEN 'Security' ELSE 'General' END AS category FROM findings
""")
def findings_category(spark, d):
    own = F.when((F.col("seq") % 3 == 0) & F.col("rule_id").startswith("CQ"), "Own").otherwise(" ")
    return categorise(doc_findings(spark, d).withColumn("category", own)).select("seq", "rule_id", "category")


@query("gate_counts", f"WITH {FINDINGS_SQL}, {RUNS_SQL} SELECT run_id, errors, warnings, infos FROM counts")
def gate_counts_query(spark, d):
    return gate_counts(all_runs(spark, d), doc_findings(spark, d))


@query("gate_status", f"""
WITH {FINDINGS_SQL}, {RUNS_SQL}
SELECT run_id, errors, warnings, infos, status, CAST(CASE WHEN errors > 0 AND run_id NOT LIKE '%/fr' THEN 1 ELSE 0 END AS INT) AS exit_code FROM gates
""")
def gate_status(spark, d):
    """The flagship: French runs do not fail on errors."""
    return gate(gate_counts_query(spark, d), ~F.col("run_id").endswith("/fr"))


@query("report_file_groups", f"""
WITH {FINDINGS_SQL}, shown AS (SELECT * FROM findings WHERE severity = 'Error')
SELECT run_id, target, seq, rule_id, min(seq) OVER w AS group_seq, count(*) OVER w AS group_rows
FROM shown WINDOW w AS (PARTITION BY run_id, target)
""")
def report_file_groups(spark, d):
    return file_groups(stored_findings(spark, d), only_errors=True).select(
        "run_id", "target", "seq", "rule_id", "group_seq", "group_rows"
    )


TOP_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, severity ORDER BY seq) AS row_no,
         count(*) OVER (PARTITION BY run_id, severity) AS n,
         CASE severity WHEN 'Error' THEN {e} WHEN 'Warning' THEN {w} END AS k FROM {source}),
top AS (
  SELECT run_id, severity, 'row' AS row_kind, CAST(row_no AS INT) AS row_no, 0 AS more, seq, rule_id FROM ranked WHERE row_no <= k
  UNION ALL SELECT DISTINCT run_id, severity, 'more', CAST(k + 1 AS INT), n - k, NULL, NULL FROM ranked WHERE n > k)
"""


@query("report_topk_overflow", f"""
WITH {FINDINGS_SQL}, {TOP_SQL.format(e=50, w=10, source='findings')} SELECT run_id, severity, row_kind, row_no, more, seq, rule_id FROM top
""")
def report_topk_overflow(spark, d):
    return topk_overflow(stored_findings(spark, d), {ERROR: 50, WARNING: 10}).select(
        "run_id", "severity", "row_kind", "row_no", "more", "seq", "rule_id"
    )


@query("report_blueprints", f"""
WITH {FINDINGS_SQL}, {ENRICHED_SQL}, carried AS (SELECT * FROM enriched WHERE steps_text <> '' OR example <> ''),
{TOP_SQL.format(e=15, w=5, source='carried')}
SELECT run_id, severity, row_no, seq, rule_id, CAST(CASE severity WHEN 'Error' THEN 0 ELSE 1 END AS INT) AS severity_place FROM top WHERE row_kind = 'row'
""")
def report_blueprints(spark, d):
    return blueprints(enriched(spark, d)).select("run_id", "severity", "row_no", "seq", "rule_id", "severity_place")


CELL_SQL = """CASE WHEN threshold > 0 THEN '**' || actual || '** (Max: ' || threshold || ')'
  WHEN severity = 'Error' THEN 'Critical Error' ELSE 'Advisory' END"""


@query("report_metric_cell", f"WITH {FINDINGS_SQL} SELECT seq, {CELL_SQL} AS cell FROM findings")
def report_metric_cell(spark, d):
    return doc_findings(spark, d).select(
        "seq", metric_cell(F.col("severity"), F.col("actual"), F.col("threshold")).alias("cell")
    )


def _sql_escape(expr: str, pairs) -> str:
    for old, new in pairs:
        code = {"\r": "chr(13)", "\n": "chr(10)"}.get(old) or "'" + old.replace("'", "''") + "'"
        expr = f"replace({expr}, {code}, '{new}')"
    return expr


@query("report_annotations", f"""
WITH {FINDINGS_SQL}, {ENRICHED_SQL}
SELECT seq, '::' || CASE WHEN severity = 'Error' THEN 'error' ELSE 'warning' END || ' file=' || target || ',line=' || line_no
  || ',endLine=' || end_line_no || ',title=' || {_sql_escape("rule_id || ': ' || rule_name", DATA_ESCAPES + [(':', '%3A'), (',', '%2C')])}
  || '::' || {_sql_escape("description || ' -> How to fix: ' || fix", DATA_ESCAPES)} AS annotation
FROM enriched
""")
def report_annotations(spark, d):
    return annotations(enriched(spark, d)).select("seq", "annotation")


_ROW_SQL = f"""
'| ' || CASE severity WHEN 'Error' THEN '{BADGES[ERROR]}' ELSE '{BADGES[WARNING]}' END || ' | `' || rule_id || '` ' || rule_name || ' | `' || target || ':' || line_no
  || '` | `' || member || '` | ' || {CELL_SQL} || ' | ' || fix || ' |'
"""
_BLUE_SQL = """
'#### [' || rule_id || '] ' || rule_name || ' `' || target || ':' || line_no || '`' || chr(10) || '- Problem: ' || description
  || CASE WHEN rationale <> '' THEN chr(10) || '- Why: ' || rationale ELSE '' END
  || CASE WHEN steps_text <> '' THEN chr(10) || '  1. ' || replace(steps_text, chr(10), chr(10) || '  1. ') ELSE '' END
  || CASE WHEN example <> '' THEN chr(10) || '```' || chr(10) || example || chr(10) || '```' ELSE '' END
"""


def _text_sql(warnings: int, facts: str = "") -> str:
    return f"""
WITH {FINDINGS_SQL}, {ENRICHED_SQL}, {RUNS_SQL},
ranked AS (
  SELECT *, CASE severity WHEN 'Error' THEN 0 ELSE 1 END AS place,
         row_number() OVER (PARTITION BY run_id, severity ORDER BY seq) AS row_no, count(*) OVER (PARTITION BY run_id, severity) AS n,
         CASE severity WHEN 'Error' THEN 50 WHEN 'Warning' THEN {warnings} END AS k FROM enriched),
tab AS (
  SELECT run_id, place, row_no, {_ROW_SQL} AS line FROM ranked WHERE row_no <= k
  UNION ALL SELECT DISTINCT run_id, place, k + 1, '| ' || CASE severity WHEN 'Error' THEN '{BADGES[ERROR]}' ELSE '{BADGES[WARNING]}' END
     || ' | and ' || (n - k) || ' more | - | - | - | see the findings table |' FROM ranked WHERE n > k),
tabs AS (SELECT run_id, string_agg(line, chr(10) ORDER BY place, row_no) AS body FROM tab GROUP BY run_id),
carried AS (SELECT *, row_number() OVER (PARTITION BY run_id, severity ORDER BY seq) AS blue_no FROM ranked WHERE steps_text <> '' OR example <> ''),
blues AS (SELECT run_id, string_agg({_BLUE_SQL}, chr(10) ORDER BY place, blue_no) AS blue FROM carried
          WHERE blue_no <= CASE severity WHEN 'Error' THEN 15 ELSE 5 END GROUP BY run_id)
SELECT g.run_id,
  CASE status WHEN '{PASSED}' THEN '{HEADS[PASSED]}' WHEN '{ADVISORIES}' THEN '{HEADS[ADVISORIES]}' ELSE '{HEADS[ACTION]}' END || chr(10) || '- Errors: ' || errors || chr(10) || '- Warnings: ' || warnings {facts}
  || CASE WHEN status = 'PASSED' THEN '' ELSE chr(10) || '{TABLE_HEAD[0]}' || chr(10)
       || '{TABLE_HEAD[1]}' || chr(10) || t.body
       || CASE WHEN b.blue IS NULL THEN '' ELSE chr(10) || '### Blueprints' || chr(10) || b.blue END END AS report
FROM gates g LEFT JOIN tabs t ON t.run_id = g.run_id LEFT JOIN blues b ON b.run_id = g.run_id
"""


@query("report_text", _text_sql(25))
def report_text_query(spark, d):
    found = stage(enriched(spark, d), "findings")
    return report_text(gate(gate_counts(all_runs(spark, d), found)), found)


_FACTS = "|| chr(10) || '- Files analyzed: ' || (SELECT count(*) FROM documents x WHERE x.source || '/' || x.lang = g.run_id)"


@query("report_text_comment", f"""
SELECT run_id, CASE WHEN length(report) > 60000 THEN left(report, 58000) || '{CUT_NOTICE.replace(chr(10), "' || chr(10) || '")}' ELSE report END AS report
FROM ({_text_sql(10, _FACTS)})
""")
def report_text_comment(spark, d):
    """The shorter report, with what is known of the run."""
    found = stage(enriched(spark, d), "findings")
    docs = table(spark, d, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("run_id")).agg(F.count("*").alias("files"))
    runs = gate(gate_counts(all_runs(spark, d), found)).join(docs, "run_id", "left").fillna(0, ["files"])
    return report_text(runs, found, "comment")


@query("report_errors", f"""
WITH {FINDINGS_SQL}, {ENRICHED_SQL}
SELECT run_id, min(seq) OVER (PARTITION BY run_id, target) AS group_seq, target, seq, rule_id,
  '| `' || rule_id || '` ' || rule_name || ' | ' || CASE WHEN rule_id LIKE 'CQ%' THEN 'Code Quality' WHEN rule_id LIKE 'SEC%' THEN 'Security' ELSE 'General' END
    || ' | `' || target || ':' || line_no || '` | `' || member || '` | ' || {CELL_SQL} || ' | ' || fix || ' |' AS line,
  {_BLUE_SQL} AS blueprint
FROM enriched WHERE severity = 'Error'
""")
def report_errors(spark, d):
    return error_report(stage(enriched(spark, d), "findings"))


@query("report_error_chunks", f"""
WITH {FINDINGS_SQL}, {ENRICHED_SQL},
lines AS (
  SELECT *, min(seq) OVER (PARTITION BY run_id, target) AS group_seq,
    '| `' || rule_id || '` ' || rule_name || ' | ' || CASE WHEN rule_id LIKE 'CQ%' THEN 'Code Quality' WHEN rule_id LIKE 'SEC%' THEN 'Security' ELSE 'General' END
      || ' | `' || target || ':' || line_no || '` | `' || member || '` | ' || {CELL_SQL} || ' | ' || fix || ' |' AS line
  FROM enriched WHERE severity = 'Error'),
numbered AS (
  SELECT run_id, line, row_number() OVER (PARTITION BY run_id
    ORDER BY group_seq, target, seq, rule_id, line_no, end_line_no, member, description, line) AS row_no FROM lines)
SELECT run_id, (row_no - 1) // 20 + 1 AS chunk, min(row_no) AS first_row, count(*) AS n_rows,
       string_agg(line, chr(10) ORDER BY row_no) AS text
FROM numbered GROUP BY ALL
""")
def report_error_chunks(spark, d):
    return error_chunks(stage(enriched(spark, d), "findings"), rows=20)


@query("report_truncate", """
SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN left(text, 1500) || chr(10) || '(cut)' ELSE text END AS by_bytes,
       CASE WHEN length(text) > 1000 THEN left(text, 900) || '…' ELSE text END AS by_chars
FROM documents
""")
def report_truncate(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        truncate_text(text, 2000, 1500, "\n(cut)", "bytes").alias("by_bytes"),
        truncate_text(text, 1000, 900, "…").alias("by_chars"),
    )


@query("path_relative", """
SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN url_decode(name) WHEN 1 THEN url_decode('deep/' || name)
  WHEN 2 THEN '../b/' || url_decode(name) ELSE path END AS relative
FROM (SELECT page_id, name, CASE page_id % 4 WHEN 0 THEN '/data/a/' WHEN 1 THEN '/data/a/deep/' WHEN 2 THEN '/data/b/'
        ELSE 'https://host/data/a/' END || name AS path
      FROM (SELECT page_id, split_part(url, '/', 3) || '/p%20q+r%2Cs' AS name FROM pages))
""")
def path_relative(spark, d):
    """Below the base, deeper, beside it, and under another root."""
    name = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/p%20q+r%2Cs"))
    folders = F.array(*[F.lit(x) for x in ("/data/a/", "/data/a/deep/", "/data/b/", "https://host/data/a/")])
    path = F.concat(F.element_at(folders, (F.col("page_id") % 4 + 1).cast("int")), name)
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn(
        "relative", relative_path(F.col("path"), "/data/a")
    )


@query("report_local_time", """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d_%H-%M-%S') AS stamp,
       strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %I:%M:%S %p') || ' IST' AS shown FROM events
""")
def report_local_time(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", local_stamp(ts).alias("stamp"), local_shown(ts).alias("shown")
    )


_HTML_SQL = _sql_escape("text", HTML_ESCAPES)
for _code in range(160, 256):
    _HTML_SQL = f"replace({_HTML_SQL}, chr({_code}), '&#{_code};')"


@query("report_html_cell", f"SELECT doc_id, {_HTML_SQL} AS cell FROM documents")
def report_html_cell(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", html_escape(F.col("text")).alias("cell"))


@query("recipients_dedupe", r"""
WITH parts AS (
  SELECT lang, doc_id, CAST(generate_subscripts(p, 1) AS INT) AS pos, trim(unnest(p)) AS address
  FROM (SELECT lang, doc_id, regexp_split_to_array(text, '[,; \n\r]+') AS p FROM documents)),
kept AS (SELECT * FROM parts WHERE regexp_matches(address, '^[\w.+-]+@[\w-]+[.][\w.-]+$')),
firsts AS (SELECT lang, lower(address) AS address_key, arg_min(address, (doc_id, pos)) AS address, min((doc_id, pos)) AS place FROM kept GROUP BY ALL)
SELECT lang, address_key, address, CASE WHEN place = min(place) OVER (PARTITION BY lang) THEN 'To' ELSE 'Cc' END AS role FROM firsts
""")
def recipients_dedupe(spark, d):
    """One list per language; only parts that look like an address count in running text."""
    return recipients(
        table(spark, d, "documents"), ["lang"], ["doc_id"], "text", r"^[\w.+-]+@[\w-]+[.][\w.-]+$"
    ).select("lang", "address_key", "address", "role")
