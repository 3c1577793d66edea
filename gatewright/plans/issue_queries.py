"""Registered queries: issue state in batch, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.lifecycle import close_scope, context_forms, lifecycle, match_context, match_issue, upsert
from gatewright.operators.mentions import mentions
from gatewright.plans.fixtures import EVENTS_SQL, ISSUES_SQL, documents, events, issues, plain_times, runs
from gatewright.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("issue_match", f"""
WITH {EVENTS_SQL}, {ISSUES_SQL}
SELECT e.event_id AS run_id, 'user-' || e.user_id AS context_key, i.issue_id
FROM ev e LEFT JOIN (SELECT context_key, arg_max(issue_id, (opened_at, issue_id)) AS issue_id FROM open_quality GROUP BY 1) i
  ON i.context_key = 'user-' || e.user_id
""")
def issue_match(spark, d):
    return match_issue(runs(spark, d), issues(spark, d)).select("run_id", "context_key", "issue_id")


def _context():
    """(label, tag) of a user as a pull request (even) or a branch."""
    user = F.col("user_id")
    return context_forms(F.when(user % 2 == 0, user), F.concat(F.lit("b"), user.cast("string")))


def _marked_issues(spark, d):
    """Issues of pull requests and branches; half have the label, the others the tag."""
    user = F.col("user_id")
    label, tag = _context()
    marked = issues(spark, d).withColumn("user_id", F.regexp_extract(F.concat_ws(" ", "labels", "title", "body"), r"user-(\d+)", 1).cast("bigint"))
    by_label = F.col("issue_id") % 2 == 0
    quality = F.array_remove("labels", F.concat(F.lit("user-"), user.cast("string")))
    return marked.select(
        "issue_id", "state", "opened_at", F.when(by_label, F.array_append(quality, label)).otherwise(quality).alias("labels"),
        F.when(by_label, F.regexp_replace("title", r"\[.*$", "")).otherwise(F.concat(F.regexp_replace("title", r"\[.*$", ""), tag)).alias("title"),
        F.regexp_replace("body", r"\[[^\]]*\]", "").alias("body"))


@query("issue_match_context", f"""
WITH {EVENTS_SQL}, {ISSUES_SQL}, found AS (
  SELECT issue_id, opened_at, CAST(substr(context_key, 6) AS BIGINT) AS u FROM open_quality)
SELECT e.event_id AS run_id, CASE WHEN e.user_id % 2 = 0 THEN 'pr-' || e.user_id ELSE 'branch-b' || e.user_id END AS label, i.issue_id
FROM ev e LEFT JOIN (SELECT u, arg_max(issue_id, (opened_at, issue_id)) AS issue_id FROM found GROUP BY 1) i ON i.u = e.user_id
""")
def issue_match_context(spark, d):
    label, tag = _context()
    runs = events(spark, d).select(F.col("event_id").alias("run_id"), label.alias("label"), tag.alias("tag"))
    return match_context(runs, _marked_issues(spark, d)).select("run_id", "label", "issue_id")


@query("issue_close_context", f"""
WITH {EVENTS_SQL}, {ISSUES_SQL},
passing AS (SELECT event_id AS run_id, user_id, ts, k FROM ev WHERE event_type <> 'error'),
closers AS (
  SELECT i.issue_id, p.ts, p.run_id FROM open_quality i JOIN passing p ON 'user-' || p.user_id = i.context_key
  UNION ALL SELECT i.issue_id, p.ts, p.run_id FROM open_quality i JOIN passing p ON i.form = 1 AND p.k % 9 = 0 AND contains('src/file' || i.k || '.cs:1', 'file' || p.k || '.cs'))
SELECT issue_id, min(ts) AS closed_at, arg_min(run_id, (ts, run_id)) AS closed_by FROM closers GROUP BY issue_id
""")
def issue_close_context(spark, d):
    """Issues closed by the label or tag of a pull request or branch, and by files that passing runs touched."""
    label, tag = _context()
    passing = events(spark, d).select(
        F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("context_key"), "ts", "k",
        (F.col("event_type") != "error").alias("passed"), label.alias("label"), tag.alias("tag"))
    files = passing.filter(F.col("k") % 9 == 0).select("run_id", F.concat(F.lit("app\\file"), F.col("k").cast("string"), F.lit(".cs")).alias("path"))
    return plain_times(close_scope(passing, _marked_issues(spark, d), files, label=F.col("label"), tag=F.col("tag")))


@query("issue_file_match", """
SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
""")
def issue_file_match(spark, d):
    docs = documents(spark, d, "doc_id", "source", "text")
    return mentions(docs, "doc_id", "text", table(spark, d, "benchmark"), "text").select("doc_id", "source")


@query("issue_upsert", f"""
WITH {EVENTS_SQL},
cur AS (SELECT user_id, k, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated_at, min(ts) AS opened_at
        FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
inc AS (SELECT user_id, k, 'open' AS state, max(ts) AS updated_at FROM ev WHERE event_type = 'error' GROUP BY 1, 2)
SELECT coalesce(i.user_id, c.user_id) AS user_id, coalesce(i.k, c.k) AS k, coalesce(i.state, c.state) AS state,
       coalesce(i.updated_at, c.updated_at) AS updated_at, c.opened_at,
       CASE WHEN c.user_id IS NOT NULL AND i.user_id IS NOT NULL THEN 'updated' WHEN i.user_id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
FROM cur c FULL JOIN inc i ON i.user_id = c.user_id AND i.k = c.k
""")
def issue_upsert(spark, d):
    """Contexts are (user, k): what views and clicks left there meets what failed."""
    ev = events(spark, d)
    kind = F.col("event_type")
    current = ev.filter(kind.isin("view", "click")).groupBy("user_id", "k").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"),
        F.max("ts").alias("updated_at"), F.min("ts").alias("opened_at"),
    )
    incoming = ev.filter(kind == "error").groupBy("user_id", "k").agg(
        F.lit("open").alias("state"), F.max("ts").alias("updated_at")
    )
    return plain_times(upsert(current, incoming, ["user_id", "k"]))


LIFECYCLE_SQL = """
islands AS (
  SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM ev)
SELECT user_id, min(ts) FILTER (event_type = 'error') AS opened_at, max(ts) FILTER (event_type = 'error') AS updated_at,
       min(ts) FILTER (event_type <> 'error') AS closed_at, count(*) FILTER (event_type = 'error') AS failures,
       CASE WHEN bool_or(event_type <> 'error') THEN 'closed' ELSE 'open' END AS state
FROM islands GROUP BY user_id, island HAVING bool_or(event_type = 'error')
"""


@query("issue_lifecycle", f"WITH {EVENTS_SQL}, {LIFECYCLE_SQL}")
def issue_lifecycle(spark, d):
    return plain_times(lifecycle(
        events(spark, d), ["user_id"], "ts", "event_id", F.col("event_type") == "error"
    ))


@query("issue_close_scope", f"""
WITH {EVENTS_SQL}, {ISSUES_SQL},
passing AS (SELECT event_id AS run_id, 'user-' || user_id AS context_key, ts, event_type, k FROM ev WHERE event_type <> 'error'),
closers AS (
  SELECT i.issue_id, p.ts, p.run_id FROM open_quality i JOIN passing p ON p.context_key = i.context_key
  UNION ALL SELECT i.issue_id, p.ts, p.run_id FROM open_quality i JOIN passing p ON p.event_type = 'click' AND i.form = 1 AND contains('src/file' || i.k || '.cs:1', 'file' || p.k || '.cs')
  UNION ALL SELECT i.issue_id, p.ts, p.run_id FROM open_quality i JOIN passing p ON p.context_key = 'user-7')
SELECT issue_id, min(ts) AS closed_at, arg_min(run_id, (ts, run_id)) AS closed_by FROM closers GROUP BY issue_id
""")
def issue_close_scope(spark, d):
    passing = runs(spark, d).withColumn("passed", ~F.col("failed"))
    files = events(spark, d).filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("app/file"), F.col("k").cast("string"), F.lit(".cs")).alias("path")
    )
    return plain_times(close_scope(passing, issues(spark, d), files, default_keys=["user-7"]))
