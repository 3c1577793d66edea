"""Registered queries: measures and severity, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.operators.metrics import (
    branch_score, child_count, deep_nesting, grade, measures, nesting_depth, policy, span_length, weighted_depth,
)
from gatewright.operators.spans import pair_spans, positioned_tokens
from gatewright.plans.fixtures import BALANCED_TAGS, CLOSING, TAG_TOKENS, documents, pages, quoted
from gatewright.session import stage, table
from gatewright.sources.texts import line_count

QUERIES, ORACLES = {}, {}

RAW_TAGS = "html|head|body|nav|ul|li|a|article|div|h1|p|b|title|span"
RAW_TOKENS = rf"</?(?:{RAW_TAGS})(?:>|\s[^>]*>)"
BRANCH_TOKENS = r"<(?:li|a|p|div)[ >]"
OPEN_TAG = rf"<(?:{BALANCED_TAGS})(?:>|\s[^>]*>)"
CLOSE_TAG = rf"</(?:{BALANCED_TAGS})>"
FLAT_TOKEN = r"&amp;"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _severity(limit: int, worse: str) -> str:
    return f"CASE WHEN actual > {worse} THEN 'Error' ELSE 'Warning' END AS severity, CAST({limit} AS INT) AS threshold"


@query("metric_span_length", f"""
SELECT doc_id, actual, {_severity(50, '75')}
FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS actual FROM documents) WHERE actual > 50
""")
def metric_span_length(spark, d):
    spans = documents(spark, d, "doc_id", "text").select(
        "doc_id", F.lit(1).alias("start_line"), line_count("text").alias("end_line")
    )
    return span_length(spans, 50).select("doc_id", "actual", "severity", "threshold")


@query("metric_branch_tokens", f"""
SELECT page_id, actual, {_severity(10, '15')}
FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '{BRANCH_TOKENS}')) + 1 AS INT) AS actual FROM pages) WHERE actual > 10
""")
def metric_branch_tokens(spark, d):
    return branch_score(pages(spark, d), "html", BRANCH_TOKENS, 10).select(
        "page_id", "actual", "severity", "threshold"
    )


@query("metric_child_count", f"""
SELECT o_orderkey, actual, {_severity(4, '6')}
FROM (SELECT o_orderkey, CAST(count(*) AS INT) AS actual FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
WHERE actual > 4
""")
def metric_child_count(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return child_count(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", 4)


_TOKEN_ROWS = """
SELECT page_id, CAST(generate_subscripts(toks, 1) AS INT) AS tok_no, unnest(toks) AS token
FROM (SELECT page_id, regexp_extract_all(html, {pattern}) AS toks FROM pages)
"""


@query("metric_nesting_depth", f"""
WITH t AS ({_TOKEN_ROWS.format(pattern=quoted(RAW_TOKENS))}),
r AS (SELECT page_id, sum(CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END)
             OVER (PARTITION BY page_id ORDER BY tok_no) AS now FROM t)
SELECT p.page_id, CAST(greatest(coalesce(max(now), 0), 0) AS INT) AS depth
FROM pages p LEFT JOIN r ON r.page_id = p.page_id GROUP BY p.page_id
""")
def metric_nesting_depth(spark, d):
    html = pages(spark, d).select("page_id", "html")
    return nesting_depth(html, "html", RAW_TOKENS, CLOSING).select("page_id", "depth")


_WEIGHTED_SQL = f"""
wt AS ({_TOKEN_ROWS.format(pattern=quoted(f"{OPEN_TAG}|{CLOSE_TAG}|{FLAT_TOKEN}"))}),
wd AS (SELECT page_id, token,
        sum(CASE WHEN token LIKE '</%' THEN -1 WHEN token LIKE '<%' THEN 1 ELSE 0 END)
          OVER (PARTITION BY page_id ORDER BY tok_no) AS now FROM wt),
weighted AS (
SELECT p.page_id, CAST(coalesce(sum(CASE WHEN token LIKE '</%' THEN 0 WHEN token LIKE '<%' THEN now WHEN token IS NULL THEN 0 ELSE 1 END), 0) AS INT) AS score
FROM pages p LEFT JOIN wd ON wd.page_id = p.page_id GROUP BY p.page_id)
"""


@query("metric_weighted_depth", f"""
WITH {_WEIGHTED_SQL}
SELECT page_id, score, CASE WHEN score > 25 THEN 'Error' WHEN score > 15 THEN 'Warning' ELSE '' END AS severity FROM weighted
""")
def metric_weighted_depth(spark, d):
    html = pages(spark, d).select("page_id", "html")
    score = F.col("score")
    return weighted_depth(html, "html", OPEN_TAG, CLOSE_TAG, FLAT_TOKEN).select(
        "page_id", "score", F.when(score > 25, "Error").when(score > 15, "Warning").otherwise("").alias("severity")
    )


@query("severity_grade", f"""
WITH {_WEIGHTED_SQL},
m AS (
  SELECT 'CQ001' AS rule_id, 'doc-' || doc_id AS target, len(string_split(text, chr(10))) AS actual FROM documents
  UNION ALL SELECT 'CQ002', 'page-' || page_id, len(regexp_extract_all(html, '{BRANCH_TOKENS}')) + 1 FROM pages
  UNION ALL SELECT 'CQ003', 'order-' || l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'CQ007', 'page-' || page_id, score FROM weighted
  UNION ALL SELECT 'CQ009', 'cust-' || o_custkey, count(*) FROM orders GROUP BY o_custkey),
p(rule_id, threshold, worse) AS (VALUES ('CQ001', 50, 75.0), ('CQ002', 10, 15.0), ('CQ003', 4, 6.0), ('CQ007', 15, 25.0), ('CQ009', 20, 1e18))
SELECT rule_id, target, CAST(actual AS INT) AS actual, CAST(threshold AS INT) AS threshold,
       CASE WHEN actual > worse THEN 'Error' ELSE 'Warning' END AS severity
FROM m JOIN p USING (rule_id) WHERE actual > threshold
""")
def severity_grade(spark, d):
    def named(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string")).alias("target")

    docs, html = documents(spark, d, "doc_id", "text"), pages(spark, d)
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    count = F.count("*").cast("int").alias("actual")
    found = measures([
        docs.select(F.lit("CQ001").alias("rule_id"), named("doc-", "doc_id"), line_count("text").alias("actual")),
        html.select(F.lit("CQ002").alias("rule_id"), named("page-", "page_id"),
                     (F.regexp_count("html", F.lit(BRANCH_TOKENS)) + 1).alias("actual")),
        items.groupBy("l_orderkey").agg(count).select(F.lit("CQ003").alias("rule_id"), named("order-", "l_orderkey"), "actual"),
        weighted_depth(html, "html", OPEN_TAG, CLOSE_TAG, FLAT_TOKEN, "actual").select(
            F.lit("CQ007").alias("rule_id"), named("page-", "page_id"), "actual"),
        orders.groupBy("o_custkey").agg(count).select(F.lit("CQ009").alias("rule_id"), named("cust-", "o_custkey"), "actual"),
    ])
    return grade(found, policy(spark))


def page_spans(spark, d, stored: bool = False):
    """Tokens and spans of the balanced tags of each page, with character positions.

    `stored` writes the tokens once, for plans that read them again beside the spans.
    """
    toks = positioned_tokens(pages(spark, d), ["page_id"], "html", TAG_TOKENS)
    if stored:
        toks = stage(toks, "tokens")
    delta = F.when(F.col("token").rlike(CLOSING), -1).otherwise(1)
    return toks, pair_spans(toks, ["page_id"], delta, keep=["pos", "token"])


SPAN_SQL = f"""
tok AS (SELECT page_id, CAST(generate_subscripts(toks, 1) AS INT) AS tok_no, unnest(toks) AS token, unnest(gaps) AS gap
        FROM (SELECT page_id, regexp_extract_all(html, {quoted(TAG_TOKENS)}) AS toks,
                     regexp_split_to_array(html, {quoted(TAG_TOKENS)})[1:len(regexp_extract_all(html, {quoted(TAG_TOKENS)}))] AS gaps FROM pages)),
placed AS (
  SELECT *, CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END AS dl,
         CAST(sum(length(gap) + length(token)) OVER w - length(token) + 1 AS BIGINT) AS pos,
         sum(CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END) OVER w AS s
  FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY tok_no)),
lev AS (SELECT *, CASE WHEN dl = 1 THEN s ELSE s + 1 END AS depth FROM placed),
nxt AS (SELECT *, lead(dl) OVER w AS e_dl, lead(tok_no) OVER w AS close_no, lead(pos) OVER w AS close_pos, lead(token) OVER w AS close_token
        FROM lev WINDOW w AS (PARTITION BY page_id, depth ORDER BY tok_no)),
paired AS (SELECT page_id, tok_no AS open_no, close_no, CAST(depth AS INT) AS depth, pos AS open_pos, close_pos, token AS open_token, close_token
           FROM nxt WHERE dl = 1 AND e_dl = -1)
"""


@query("span_pairs", f"WITH {SPAN_SQL} SELECT page_id, open_no, close_no, depth, open_pos, close_pos, open_token, close_token FROM paired")
def span_pairs(spark, d):
    return page_spans(spark, d)[1]


@query("metric_deep_pages", f"""
WITH t AS ({_TOKEN_ROWS.format(pattern=quoted(TAG_TOKENS))}),
r AS (SELECT page_id, sum(CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY tok_no) AS now FROM t),
m AS (SELECT page_id, CAST(max(now) - 1 AS INT) AS actual FROM r GROUP BY page_id)
SELECT page_id, actual, {_severity(1, '2')} FROM m WHERE actual > 1
""")
def metric_deep_pages(spark, d):
    """M04 as a rule: the outermost element is the body and does not count."""
    return deep_nesting(pages(spark, d), "html", TAG_TOKENS, CLOSING, limit=1).select(
        "page_id", "actual", "severity", "threshold"
    )
