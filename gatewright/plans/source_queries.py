"""Registered queries: sources, settings, scope, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.operators.scope import changed_counts, scope_lines, scope_spans
from gatewright.plans.fixtures import DIFF_SQL, SPANS_SQL, diff_lines, line_spans
from gatewright.session import fresh_dir, stage, table
from gatewright.sources.choose import first_non_empty
from gatewright.sources.diffs import diff_files, diff_to_lines, diff_to_ranges
from gatewright.sources.isolate import isolate_json
from gatewright.sources.settings import json_settings, resolve_settings
from gatewright.sources.sinks import read_latest, write_findings
from gatewright.sources.texts import select_sources, to_lines

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("src_path_filter", """
SELECT page_id, url FROM pages
WHERE (lower(url) LIKE '%.html' OR lower(url) LIKE '%/' OR lower(url) LIKE '%#top')
  AND url NOT LIKE '%//blog.%' AND url NOT LIKE '%/fr/%' AND lower(url) NOT LIKE '%5#top'
""")
def src_path_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return select_sources(pages, "url", [".HTML", "/", "#top"], ["//blog.", "\\fr\\"], ["5#TOP"])


@query("src_lines", """
SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INT) AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
""")
def src_lines(spark, d):
    return to_lines(table(spark, d, "documents"), "doc_id", "text")


@query("diff_changed_lines", f"WITH {DIFF_SQL} SELECT diff_id, path, path_key, line_no FROM changed")
def diff_changed_lines(spark, d):
    return diff_to_lines(diff_lines(spark, d))


@query("src_first_nonempty", """
SELECT event_id, event_type, value, 3 AS priority FROM events WHERE event_type = 'error'
""")
def src_first_nonempty(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    return first_non_empty([
        ev.filter(F.col("event_type") == "deploy"),
        ev.filter(F.col("value") < 0),
        ev.filter(F.col("event_type") == "error"),
        ev,
    ])


@query("cfg_resolve", """
WITH layers AS (
  SELECT c_custkey AS key, 1 AS priority, CASE WHEN c_custkey % 3 = 0 THEN '   ' WHEN c_custkey % 3 = 1 THEN ' arg ' || c_custkey END AS value FROM customer
  UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'env' || c_nationkey END FROM customer
  UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END FROM customer
  UNION ALL SELECT c_custkey, 4, CASE WHEN c_custkey % 7 <> 0 THEN 'default' END FROM customer)
SELECT key, arg_min(v, p) AS value, CAST(min(p) AS INT) AS priority
FROM (SELECT key, CASE WHEN trim(value) <> '' THEN trim(value) END AS v,
             CASE WHEN trim(value) <> '' THEN priority END AS p FROM layers) GROUP BY key
""")
def cfg_resolve(spark, d):
    key = F.col("c_custkey")
    layer = [
        F.when(key % 3 == 0, "   ").when(key % 3 == 1, F.concat(F.lit(" arg "), key.cast("string"))),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("env"), F.col("c_nationkey").cast("string"))),
        F.when(key % 2 == 0, F.col("c_mktsegment")),
        F.when(key % 7 != 0, "default"),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("priority"), v.alias("value")) for i, v in enumerate(layer, 1)])
    layers = table(spark, d, "customer").select(key.alias("key"), F.inline(rows))
    return resolve_settings(layers)


@query("cfg_json_defaults", """
SELECT event_id,
       CASE WHEN event_id % 5 = 4 THEN 7 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS max_lines,
       CASE WHEN event_id % 5 = 1 THEN event_type ELSE 'issues' END AS folder,
       event_id % 5 <> 2 AS fail_on_errors
FROM events
""")
def cfg_json_defaults(spark, d):
    """Settings written with odd key case, comments, trailing commas and a broken object."""
    ev = table(spark, d, "events")
    inner = F.regexp_extract("props", r"\d+", 0)
    form = F.col("event_id") % 5
    raw = (
        F.when(form == 0, F.concat(F.lit('{"MaxLines": '), inner, F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"maxlines": 1, "MAXLINES": "'), inner, F.lit('", // last wins\n "Folder": "'), F.col("event_type"), F.lit('",}')))
        .when(form == 2, F.concat(F.lit('{/* gate */ "failOnErrors": false, "maxLines": '), inner, F.lit(", }")))
        .when(form == 3, F.concat(F.lit('{"other": "a,}", "maxlines": '), inner, F.lit(', "Fail_On": 1}')))
        .otherwise(F.lit('{"maxlines": "many"'))
    )
    out = json_settings(
        ev.select("event_id", raw.alias("raw")), "raw",
        {"MaxLines": "int", "Folder": "string", "FailOnErrors": "boolean"},
        {"MaxLines": 7, "Folder": "issues", "FailOnErrors": True},
    )
    return out.select(
        "event_id", F.col("settings.MaxLines").alias("max_lines"), F.col("settings.Folder").alias("folder"),
        F.col("settings.FailOnErrors").alias("fail_on_errors"),
    )


@query("sink_latest", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'error'
""")
def sink_latest(spark, d):
    """Two runs into one sink; "latest" holds the second, and a switched-off run writes nothing."""
    base = fresh_dir(spark, "sink")
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    write_findings(rows.filter(F.col("event_type") == "click"), base, "2024-01-30_10-00-00")
    write_findings(rows.filter(F.col("event_type") == "error"), base, "2024-01-31_10-00-00")
    write_findings(rows, base, "2024-02-01_10-00-00", enabled=False)
    return read_latest(spark, base)


@query("scan_error_isolation", """
SELECT event_id,
       CASE WHEN event_id % 10 IN (3, 5, 7) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k,
       CASE event_id % 10 WHEN 3 THEN 'malformed' WHEN 5 THEN 'bad value: k' WHEN 7 THEN 'empty' END AS error
FROM events
""")
def scan_error_isolation(spark, d):
    form = F.col("event_id") % 10
    raw = (
        F.when(form == 3, F.concat(F.lit("<"), "props"))
        .when(form == 5, F.lit('{"k": "x1"}'))
        .when(form == 7, F.lit(" "))
        .otherwise(F.col("props"))
    )
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return isolate_json(rows, "raw", {"k": "int"}).select("event_id", "k", "error")


@query("scope_span_overlap", f"""
WITH {DIFF_SQL}, {SPANS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, start_line, end_line FROM spans s
WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.path_key = s.path_key)
   OR EXISTS (SELECT 1 FROM changed c WHERE c.path_key = s.path_key AND c.line_no BETWEEN s.start_line AND s.end_line)
""")
def scope_span_overlap(spark, d):
    spans = line_spans(spark, d)
    changed = stage(diff_to_ranges(diff_lines(spark, d)), "changed")
    return scope_spans(spans, changed, line="first_line", last_line="last_line").select(
        "l_orderkey", "l_linenumber", "l_partkey", "start_line", "end_line"
    )


@query("scope_line_semi", f"""
WITH {DIFF_SQL}
SELECT l_orderkey, l_linenumber, 'SRC/O' || l_orderkey || '.cs' AS target,
       l_linenumber * 10 + CAST(round(l_tax * 100) AS INT) % 4 AS line_no
FROM lineitem l
WHERE EXISTS (SELECT 1 FROM changed c WHERE c.path_key = 'src/o' || l.l_orderkey || '.cs'
              AND c.line_no = l.l_linenumber * 10 + CAST(round(l.l_tax * 100) AS INT) % 4)
""")
def scope_line_semi(spark, d):
    hits = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("SRC/O"), F.col("l_orderkey").cast("string"), F.lit(".cs")).alias("target"),
        (F.col("l_linenumber") * 10 + F.round(F.col("l_tax") * 100).cast("int") % 4).alias("line_no"),
    )
    return scope_lines(hits, diff_to_lines(diff_lines(spark, d)))


@query("scope_changed_counts", f"""
WITH {DIFF_SQL}, named_files AS (
  SELECT DISTINCT substr(line, 7) AS path FROM diff_lines WHERE line LIKE '+++ b/%.cs')
SELECT f.path, count(DISTINCT c.line_no) AS changed_lines
FROM named_files f LEFT JOIN changed c ON c.path_key = lower(f.path) GROUP BY f.path
""")
def scope_changed_counts(spark, d):
    lines = diff_lines(spark, d)
    return changed_counts(diff_files(lines).select("path").distinct(), diff_to_lines(lines))
