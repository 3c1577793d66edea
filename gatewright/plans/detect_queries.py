"""Registered queries: detection operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.catalogue.rules import SCAN_RULES
from gatewright.operators.columns import camel, chain_depth, identical, magic_numbers, pascal, zero_divisor
from gatewright.operators.enclosing import in_scope, in_scope_same_key
from gatewright.operators.groups import (
    after_terminal, empty_groups, extras, inverted_pairs, layer_boundary, missing_member, presence_xor, repeat_use,
    token_not_passed, unguarded,
)
from gatewright.operators.lookups import chain_ends, classify, latest_before, resolve_chain
from gatewright.operators.ordered import RowBlocks, last_before, next_after
from gatewright.operators.scan import contains_any, scan_texts
from gatewright.plans.fixtures import EVENTS_SQL, documents, events, quoted
from gatewright.plans.metric_queries import SPAN_SQL, page_spans
from gatewright.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def scan_sql(source: str, id_col: str) -> str:
    """The scan rules as SQL over the lines of `source` (id, text)."""
    tests = "\nUNION ALL ".join(
        f"SELECT {id_col}, line_no, line, '{r['rule_id']}' AS rule_id FROM scan_lines "
        f"WHERE regexp_matches(line, {quoted(r['pattern'])})"
        + (f" AND NOT regexp_matches(line, {quoted(r['unless'])})" if r.get("unless") else "")
        for r in SCAN_RULES
    )
    return f"""scan_lines AS (
  SELECT {id_col}, CAST(generate_subscripts(parts, 1) AS INT) AS line_no, unnest(parts) AS line
  FROM (SELECT {id_col}, string_split(text, chr(10)) AS parts FROM {source})),
scan_hits AS ({tests})"""


@query("rule_scan_lines", f"WITH {scan_sql('documents', 'doc_id')} SELECT doc_id, line_no, line, rule_id FROM scan_hits")
def rule_scan_lines(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return scan_texts(docs, ["doc_id"], "text", SCAN_RULES)


_TERMS = ["password", "token", "secret", "api_key", "Copyright", "http"]


@query("detect_contains_any", f"""
SELECT doc_id, len(found) AS n_terms, found[1] AS first_term
FROM (SELECT doc_id, list_filter({_TERMS}, lambda t: contains(text, t)) AS found
      FROM documents WHERE regexp_matches(text, '"[^"]+"'))
WHERE len(found) > 0
""")
def detect_contains_any(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return contains_any(docs, "text", _TERMS, also=r'"[^"]+"').select(
        "doc_id", F.col("n_terms").cast("bigint").alias("n_terms"), "first_term"
    )


@query("detect_unguarded", f"""
WITH {EVENTS_SQL}
SELECT event_id, user_id, day FROM ev a WHERE event_type = 'purchase'
AND NOT EXISTS (SELECT 1 FROM ev g WHERE g.event_type = 'view' AND g.user_id = a.user_id AND g.day = a.day)
""")
def detect_unguarded(spark, d):
    ev = events(spark, d)
    return unguarded(
        ev.filter(F.col("event_type") == "purchase"), ev.filter(F.col("event_type") == "view"), ["user_id", "day"]
    ).select("event_id", "user_id", "day")


@query("detect_pair_inversion", f"""
WITH {EVENTS_SQL}, tr AS (
  SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM ev)
SELECT user_id, least(a, b) AS a, greatest(a, b) AS b,
       count(*) FILTER (a < b) AS n_ab, count(*) FILTER (a > b) AS n_ba
FROM tr WHERE a <> b GROUP BY ALL HAVING n_ab > 0 AND n_ba > 0
""")
def detect_pair_inversion(spark, d):
    steps = last_before(
        events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"],
        RowBlocks(), F.col("event_type"), "before",
    )
    return inverted_pairs(steps.filter(F.col("before").isNotNull()), ["user_id"], "before", "event_type")


@query("detect_asof_value", f"""
WITH {EVENTS_SQL}
SELECT u.event_id, u.user_id, u.value, a.value AS assigned
FROM (SELECT * FROM ev WHERE event_type = 'purchase') u
ASOF JOIN (SELECT * FROM ev WHERE event_type = 'signup') a ON u.user_id = a.user_id AND u.ts > a.ts
WHERE floor(a.value) = 0
""")
def detect_asof_value(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "ts", "value", "event_type")
    uses = ev.filter(F.col("event_type") == "purchase").drop("event_type")
    assigns = ev.filter(F.col("event_type") == "signup")
    seen = latest_before(uses, assigns, ["user_id"], "ts", "value", RowBlocks())
    return seen.filter(F.floor("assigned") == 0).select("event_id", "user_id", "value", "assigned")


@query("resolve_chain", """
WITH RECURSIVE walk AS (
  SELECT p_partkey AS key, p_partkey AS node, 0 AS depth FROM part
  UNION ALL SELECT key, node // 2, depth + 1 FROM walk WHERE node > 1 AND node % 11 <> 0)
SELECT w.key, p.p_brand AS value, CAST(w.depth AS INT) AS depth
FROM walk w JOIN part p ON p.p_partkey = w.node WHERE w.node <= 1 OR w.node % 11 = 0
""")
def resolve_chain_query(spark, d):
    """Part -> part div 2, ending at 0, 1 and every multiple of 11."""
    key = F.col("p_partkey")
    ref = F.when((key > 1) & (key % 11 != 0), F.floor(key / 2))
    parts = table(spark, d, "part").select(key, ref.alias("parent"), "p_brand")
    return resolve_chain(parts, "p_partkey", "parent", "p_brand")


@query("resolve_chain_deep", """
WITH RECURSIVE walk AS (
  SELECT p_partkey AS key, p_partkey AS node, 0 AS depth FROM part
  UNION ALL SELECT key, node - 1, depth + 1 FROM walk WHERE node > 1 AND node % 97 <> 0)
SELECT w.key, p.p_brand AS value, CAST(w.depth AS INT) AS depth
FROM walk w JOIN part p ON p.p_partkey = w.node WHERE w.node <= 1 OR w.node % 97 = 0
""")
def resolve_chain_deep(spark, d):
    """Part -> the part before it, up to 96 steps to 0, 1 or a multiple of 97."""
    key = F.col("p_partkey")
    parts = table(spark, d, "part").select(key, F.when((key > 1) & (key % 97 != 0), key - 1).alias("parent"), "p_brand")
    return resolve_chain(parts, "p_partkey", "parent", "p_brand")


@query("resolve_chain_ends", """
WITH RECURSIVE raw AS (
  SELECT p_partkey // 2 AS key, p_brand AS lit, p_partkey % 2 AS again,
         CASE WHEN p_partkey // 2 % 10 IN (1, 2, 3, 9) THEN p_partkey // 2 - 1 WHEN p_partkey // 2 % 10 IN (4, 5) THEN p_partkey // 2 + 1
              WHEN p_partkey // 2 % 10 = 6 THEN p_partkey // 2 - 2 WHEN p_partkey // 2 % 10 = 7 THEN p_partkey // 2 - 3
              WHEN p_partkey // 2 % 10 = 8 THEN -1 END AS ref
  FROM part),
nodes AS (
  SELECT key, CASE WHEN key % 10 > 0 THEN min(ref + again) END AS ref, min(lit) AS lit FROM raw GROUP BY key),
walk AS (
  SELECT key, key AS node, [key] AS path FROM nodes
  UNION ALL SELECT w.key, n.ref, list_append(w.path, n.ref) FROM walk w JOIN nodes n ON n.key = w.node
  WHERE n.ref IS NOT NULL AND NOT list_contains(w.path, n.ref)),
ends AS (
  SELECT w.key, w.path, w.node, n.key AS there, n.ref, n.lit
  FROM (SELECT key, arg_max(path, len(path)) AS path, arg_max(node, len(path)) AS node FROM walk GROUP BY key) w
  LEFT JOIN nodes n ON n.key = w.node)
SELECT key, CASE WHEN there IS NOT NULL AND ref IS NULL THEN lit END AS value,
       CAST(CASE WHEN there IS NOT NULL AND ref IS NULL THEN len(path) - 1 END AS INT) AS depth,
       CASE WHEN there IS NULL THEN 'dangling' WHEN ref IS NULL THEN 'resolved' WHEN ref = key THEN 'cycle' ELSE 'to_cycle' END AS status,
       CASE WHEN there IS NOT NULL AND ref IS NOT NULL THEN list_min(list_slice(path, list_position(path, ref), len(path))) END AS cycle
FROM ends
""")
def resolve_chain_ends(spark, d):
    """Two parts a key; of each ten keys one chain of four, a cycle of three with a way in, and two that dangle."""
    key = F.floor(F.col("p_partkey") / 2)
    place = key % 10
    ref = (
        F.when(place.isin(1, 2, 3, 9), key - 1).when(place.isin(4, 5), key + 1).when(place == 6, key - 2)
        .when(place == 7, key - 3).when(place == 8, F.lit(-1))
    )
    parts = table(spark, d, "part").select(key.alias("k"), (ref + F.col("p_partkey") % 2).alias("ref"), "p_brand")
    return chain_ends(parts, "k", "ref", "p_brand")


@query("detect_zero_divisor", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, 0.0::DOUBLE AS safe_quotient FROM lineitem WHERE l_discount = 0
""")
def detect_zero_divisor(spark, d):
    return zero_divisor(table(spark, d, "lineitem"), "l_extendedprice", "l_discount").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "safe_quotient"
    )


@query("detect_after_terminal", f"""
WITH {EVENTS_SQL}, f AS (
  SELECT *, lag(event_type) OVER w AS before, count(*) FILTER (event_type = 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops
  FROM ev WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))
SELECT event_id, user_id, day, event_type FROM f WHERE before = 'error' AND stops = 1
""")
def detect_after_terminal(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "day", "ts", "event_type")
    return after_terminal(ev, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "error").select(
        "event_id", "user_id", "day", "event_type"
    )


@query("detect_presence_xor", f"""
WITH {EVENTS_SQL}
SELECT user_id, day, CASE WHEN bool_or(event_type = 'signup') THEN 'purchase' ELSE 'signup' END AS missing
FROM ev GROUP BY user_id, day HAVING bool_or(event_type = 'signup') <> bool_or(event_type = 'purchase')
""")
def detect_presence_xor(spark, d):
    kind = F.col("event_type")
    return presence_xor(events(spark, d), ["user_id", "day"], kind == "signup", kind == "purchase", "signup", "purchase")


@query("detect_extra_in_group", """
SELECT s_suppkey, s_nationkey, s_name, first_name FROM (
  SELECT *, row_number() OVER w AS rn, first_value(s_name) OVER w AS first_name
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE rn > 1
""")
def detect_extra_in_group(spark, d):
    return extras(table(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey"], "s_name").select(
        "s_suppkey", "s_nationkey", "s_name", "first_name"
    )


@query("detect_repeat_use", f"""
WITH {EVENTS_SQL}
SELECT user_id, event_type, day, count(*) AS uses FROM ev GROUP BY ALL HAVING count(*) >= 2
""")
def detect_repeat_use(spark, d):
    return repeat_use(events(spark, d), ["user_id", "event_type", "day"], 2)


@query("detect_in_scope", f"""
WITH {SPAN_SQL}
SELECT a.page_id, a.tok_no, a.pos, s.open_token, s.depth, s.open_pos, s.close_pos
FROM placed a JOIN paired s ON s.page_id = a.page_id AND s.open_pos < a.pos AND a.pos < s.close_pos
WHERE regexp_matches(a.token, '^<a[ >]')
""")
def detect_in_scope(spark, d):
    toks, spans = page_spans(spark, d, stored=True)
    links = toks.filter(F.col("token").rlike("^<a[ >]"))
    return in_scope(links, spans, ["page_id"], "pos", "open_pos", "close_pos").select(
        "page_id", "tok_no", "pos", "open_token", "depth", "open_pos", "close_pos"
    )


@query("detect_scope_key_match", f"""
WITH {EVENTS_SQL}, o AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN {{'props': props, 'event_id': event_id, 'value': value}} END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener
  FROM ev)
SELECT event_id, user_id, event_type, props, opener.event_id AS opened_by FROM o
WHERE event_type NOT IN ('signup', 'error') AND opener.props = props AND NOT coalesce(floor(opener.value) % 7 = 0, false)
""")
def detect_scope_key_match(spark, d):
    """Sessions run from one signup to the next; an event repeating the opener's `props` is a hit.

    Errors are no items, and sessions whose signup has a value of a whole part divisible by 7 let their events off.
    """
    ev = events(spark, d).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "ts", "event_type", "props", "value")
    signup = F.col("event_type") == "signup"
    opened = next_after(ev.filter(signup), ["user_id"], ["ts", "event_id"], RowBlocks(), F.col("pos"), "next")
    last = ev.agg(F.max("pos") + 1).scalar()
    spans = opened.select("user_id", F.col("pos").alias("start_pos"), F.coalesce("next", last).alias("end_pos"),
                          F.col("props").alias("opener"), F.col("event_id").alias("opened_by"), F.col("value").alias("opening"))
    items = ev.filter(~signup & (F.col("event_type") != "error")).select("event_id", "user_id", "pos", "event_type", "props")
    day = 24 * 3600 * 1_000_000
    free = spans.filter(F.floor("opening") % 7 == 0).select("user_id", "start_pos", "end_pos")
    hits = in_scope_same_key(items, spans, ["user_id"], ("props", "opener"), exempt=free, item_id=("event_id",), width=day)
    return hits.select("event_id", "user_id", "event_type", "props", "opened_by")


@query("detect_missing_member", """
SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_linestatus = 'F')
""")
def detect_missing_member(spark, d):
    return missing_member(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "F")


@query("detect_empty_group", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def detect_empty_group(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return empty_groups(docs, table(spark, d, "labels"), ["doc_id"])


@query("name_case_convert", """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name[1]) || replace(p_name, ' ', '')[2:] ELSE replace(p_name, ' ', '_') || '_' || p_size END AS name FROM part),
f AS (SELECT p_partkey, name, array_to_string(list_transform(list_filter(string_split(name, '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS pascal_name FROM n)
SELECT p_partkey, name, pascal_name, lower(pascal_name[1]) || pascal_name[2:] AS camel_name, name <> pascal_name AS flagged FROM f
""")
def name_case_convert(spark, d):
    plain = F.replace("p_name", F.lit(" "), F.lit(""))
    name = F.when(
        F.col("p_partkey") % 3 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr(plain, F.lit(2)))
    ).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumns(
        {"pascal_name": pascal(F.col("name")), "camel_name": camel(F.col("name"))}
    ).withColumn("flagged", F.col("name") != F.col("pascal_name"))


@query("detect_identical_operands", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem WHERE l_discount = l_tax
""")
def detect_identical_operands(spark, d):
    return identical(table(spark, d, "lineitem"), "l_discount", "l_tax").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"
    )


@query("detect_layer_boundary", """
SELECT p.page_id, p.url, r.lang FROM pages p
JOIN (SELECT page_id, regexp_extract(html, '<html lang="(\\w+)"', 1) AS lang FROM pages) r USING (page_id)
WHERE (regexp_matches(url, '//m\\.') AND lang IN ('fr', 'de')) OR (regexp_matches(url, '//blog\\.') AND lang = 'en')
""")
def detect_layer_boundary(spark, d):
    pages = table(spark, d, "pages")
    refs = pages.select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"))
    return layer_boundary(
        pages.select("page_id", "url"), "url", refs, "page_id", "lang",
        [(r"//m\.", "^(fr|de)$"), (r"//blog\.", "^en$")],
    ).select("page_id", "url", "lang")


@query("detect_magic_numbers", """
SELECT event_id, CAST(lit AS INT) AS literal FROM (SELECT event_id, unnest(regexp_extract_all(props, '\\d+')) AS lit FROM events)
WHERE TRY_CAST(lit AS INT) > 1 AND TRY_CAST(lit AS INT) <> 100
""")
def detect_magic_numbers(spark, d):
    return magic_numbers(table(spark, d, "events"), "props").select("event_id", "literal")


@query("detect_chain_depth", """
SELECT page_id, host, CAST(length(host) - length(replace(host, '.', '')) AS INT) AS dots
FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages)
WHERE length(host) - length(replace(host, '.', '')) >= 3 AND host NOT LIKE 'blog.%'
""")
def detect_chain_depth(spark, d):
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return chain_depth(hosts, "host", 3, exempt=["blog."])


@query("detect_type_lookup", """
SELECT p_partkey, p_brand, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'string'
  WHEN p_type = 'LARGE' THEN 'number' WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'number'
  WHEN p_size > 40 THEN 'string' WHEN lower(p_name) IN ('red widget', 'blue bolt') THEN 'number'
  WHEN lower(p_name) IN ('small ring') THEN 'string' ELSE 'unknown' END AS kind
FROM part
""")
def detect_type_lookup(spark, d):
    """Declared by type, else by brand, else by size; else by name lists."""
    parts = table(spark, d, "part")
    by_type = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "string").when(F.col("p_type") == "LARGE", "number")
    by_brand = F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "number")
    by_size = F.when(F.col("p_size") > 40, "string")
    found = F.array(*[F.struct(F.lit(i).alias("priority"), k.alias("kind")) for i, k in enumerate((by_type, by_brand, by_size), 1)])
    decls = parts.select("p_partkey", F.inline(found))
    return classify(
        parts, decls, ["p_partkey"], [("number", ["red widget", "blue bolt"]), ("string", ["Small Ring"])], "p_name", "unknown"
    ).select("p_partkey", "p_brand", "kind")


@query("detect_token_not_passed", f"""
WITH {EVENTS_SQL}, owners AS (
  SELECT user_id, day, arg_min(k, (ts, event_id)) AS token FROM ev WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, e.user_id, e.day, o.token FROM ev e JOIN owners o ON o.user_id = e.user_id AND o.day = e.day
WHERE e.event_type IN ('click', 'purchase')
  AND NOT list_contains([e.k, CAST(floor(e.value) AS INT), e.k % 10], o.token)
""")
def detect_token_not_passed(spark, d):
    """A user-day owns the number of its first signup; clicks and purchases must carry it."""
    ev = events(spark, d)
    owners = ev.filter(F.col("event_type") == "signup").groupBy("user_id", "day").agg(
        F.min_by("k", F.struct("ts", "event_id")).alias("token")
    )
    calls = ev.filter(F.col("event_type").isin("click", "purchase")).select(
        "event_id", "user_id", "day",
        F.array(F.col("k"), F.floor("value").cast("int"), F.col("k") % 10).alias("args"),
    )
    return token_not_passed(owners, calls, ["user_id", "day"]).select("event_id", "user_id", "day", "token")
