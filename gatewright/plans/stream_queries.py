"""Registered queries: streams driven over the given events, and user rules.

A stream's final state must equal the batch form, so the SQL is the batch SQL.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gatewright.extend import Rules
from gatewright.operators.groups import repeat_use
from gatewright.plans.fixtures import EVENTS_SQL, plain_times
from gatewright.plans.issue_queries import LIFECYCLE_SQL
from gatewright.schema import as_findings
from gatewright.session import fresh_dir, table
from gatewright.sources.texts import to_lines
from gatewright.streaming.feeds import SEAL, arrive, heartbeat, read_events
from gatewright.streaming.gates import GateTable, append_rows, notify_once, sink_latest_stream, stream_gate
from gatewright.streaming.issues import IssueTable

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: Events arrive in so many parts. One in seven is up to 20 hours late, one in 97 of the first ten days comes with the last part.
PARTS, PART_DAYS = 5, 6
ARRIVAL_SQL = f"""
arrived AS (
  SELECT *, CASE WHEN event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-11' THEN {PARTS - 1}
                 ELSE least({PARTS - 1}, date_diff('day', DATE '2024-01-01', CAST(ts + CASE WHEN event_id % 7 = 0 THEN to_hours(event_id % 20) ELSE INTERVAL 0 HOUR END AS DATE)) // {PART_DAYS}) END AS part
  FROM events),
marks AS (SELECT part, coalesce(max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY, TIMESTAMP '1970-01-01') AS mark,
                 coalesce(max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY, TIMESTAMP '1970-01-01') AS mark_before FROM arrived GROUP BY part)
"""


def _arrivals(spark, d, late: bool = True):
    """Events with `part`, the part of the feed they come in."""
    overdue = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 20).otherwise(0).cast("int")
    day = F.datediff(F.col("ts") + F.make_dt_interval(hours=overdue), F.lit("2024-01-01").cast("date"))
    part = F.least(F.lit(PARTS - 1), F.floor(day / PART_DAYS).cast("int"))
    if late:
        part = F.when((F.col("event_id") % 97 == 0) & (F.col("ts") < F.lit("2024-01-11")), F.lit(PARTS - 1)).otherwise(part)
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("part", part)


#: Files of a part, which a micro-batch takes together.
FILES = 4


def _feed(rows, beats=None):
    """A stream of the parts of `rows`, one micro-batch each. `beats` gives the times of heartbeats by part."""
    spark = rows.sparkSession
    root = fresh_dir(spark, "feed")
    bare = rows.drop("part")
    for part in range(PARTS):
        arrived = rows.filter(F.col("part") == part).drop("part")
        if at := (beats or {}).get(part):
            arrived = arrived.unionByName(heartbeat(bare, at))
        arrive(arrived.repartition(FILES), root)
    return read_events(spark, root, files_per_batch=FILES, schema=bare.schema)


def _severity(rows):
    return rows.withColumn("severity", F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "Warning").otherwise("Info"))


@query("stream_gate_window", f"""
WITH {ARRIVAL_SQL}, counted AS (
  SELECT a.*, date_trunc('day', ts) AS w, date_trunc('day', ts) + INTERVAL 1 DAY <= mark_before AS late FROM arrived a JOIN marks USING (part))
SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end,
       count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings,
       count(*) FILTER (event_type NOT IN ('error', 'signup')) AS infos, (SELECT count(*) FROM counted WHERE late) AS late_rows
FROM counted WHERE NOT late GROUP BY ALL
""")
def stream_gate_window(spark, d):
    """Counts per day over several micro-batches with rows out of order, and how many rows were too late to count."""
    found = GateTable(stream_gate(_severity(_feed(_arrivals(spark, d))), "1 day", "1 day"), buckets=4).run()
    return plain_times(found.windows().withColumn("late_rows", F.lit(found.late_rows()).cast("bigint")))


def _issues(spark, d, late: bool):
    feed = _feed(_arrivals(spark, d, late), {PARTS - 1: SEAL})
    return IssueTable(feed, ["user_id"], "ts", "event_id", F.col("event_type") == "error", "1 day", buckets=4).run()


@query("stream_issue_state", f"WITH {EVENTS_SQL}, {LIFECYCLE_SQL}")
def stream_issue_state(spark, d):
    """Rows out of order within the delay, in several micro-batches: the issues of the batch form."""
    return plain_times(_issues(spark, d, late=False).issues())


@query("stream_issue_late", f"""
WITH {ARRIVAL_SQL}, timed AS (
  SELECT user_id, event_id, event_type, ts, ts < date_trunc('millisecond', mark) AS late FROM arrived JOIN marks USING (part)),
ev AS (SELECT * FROM timed WHERE NOT late),
islands AS (
  SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM ev)
SELECT user_id, min(ts) FILTER (event_type = 'error') AS opened_at, count(*) FILTER (event_type = 'error') AS failures,
       (SELECT count(*) FROM timed WHERE late) AS late_rows
FROM islands GROUP BY user_id, island HAVING bool_or(event_type = 'error')
""")
def stream_issue_late(spark, d):
    """Rows that come after the watermark has passed them change no issue and are counted."""
    found = _issues(spark, d, late=True)
    return plain_times(found.issues().select("user_id", "opened_at", "failures", F.lit(found.late_rows()).cast("bigint").alias("late_rows")))


@query("stream_notify_once", f"""
WITH errors AS (
  SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS topic, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {PART_DAYS} AS part
  FROM events WHERE event_type = 'error'),
has AS (SELECT user_id, topic, bool_or(part = 0) AS n0, bool_or(part = 1) AND NOT n0 AS n1, bool_or(part = 2) AND NOT n0 AND NOT n1 AS n2,
               bool_or(part = 3) AND NOT n0 AND NOT n1 AND NOT n2 AS n3, bool_or(part = 4) AND NOT n1 AND NOT n2 AND NOT n3 AS n4
        FROM errors GROUP BY user_id, topic)
SELECT user_id, topic, unnest([x FOR x IN [0, 1, 2, 3, 4] IF [n0, n1, n2, n3, n4][x + 1]]) AS batch FROM has
""")
def stream_notify_once(spark, d):
    """One notification per user and topic while the last one is inside the bound; again when it is outside.

    A part is as wide as the delay and ends with a heartbeat at its end, so a notification of one part holds for three more:
    a bound ends at the end of the micro-batch after the one that moves the watermark past it.
    """
    start = F.lit("2024-01-01").cast("date")
    errors = table(spark, d, "events").filter(F.col("event_type") == "error").select(
        "user_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("topic"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    errors = errors.withColumn("batch", F.floor(F.datediff("ts", start) / PART_DAYS).cast("int")).withColumn("part", F.col("batch"))
    ends = {part: f"{date(2024, 1, 1) + timedelta(days=(part + 1) * PART_DAYS)} 00:00:00" for part in range(PARTS)}
    once = notify_once(_feed(errors, ends), ["user_id", "topic"], f"{PART_DAYS} days")
    return append_rows(once, fresh_dir(spark, "notify")).select("user_id", "topic", "batch")


@query("stream_latest_sink", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
""")
def stream_latest_sink(spark, d):
    """The table after several micro-batches, some of whose rows are older than what it holds."""
    reports = _feed(_arrivals(spark, d)).select("user_id", "event_id", "ts", "event_type")
    return plain_times(sink_latest_stream(reports, ["user_id"], ["ts", "event_id"], buckets=4))


@query("custom_rule", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT 'USR001' AS rule_id, 'doc-' || doc_id AS target, line AS member, CAST(count(*) AS INT) AS actual
FROM lines WHERE trim(line) <> '' GROUP BY doc_id, line HAVING count(*) >= 2
""")
def custom_rule(spark, d):
    """A user rule: lines a document repeats."""
    def repeated_lines(docs):
        lines = to_lines(docs, "doc_id", "text").filter(F.trim("line") != "")
        return as_findings(
            repeat_use(lines, ["doc_id", "line"], 2),
            target=F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), member=F.col("line"), actual=F.col("uses"),
        )

    rules = Rules()
    rules.register("USR001", repeated_lines)
    return rules.run(table(spark, d, "documents")).select("rule_id", "target", "member", "actual")


@udtf(returnType="line_no int, member string", useArrow=True)
class RepeatedLine:
    """Yields every line of a text that stood in it before."""

    def eval(self, text: str):
        seen = set()
        for line_no, line in enumerate((text or "").split("\n"), start=1):
            if line.strip(" ") and line in seen:
                yield line_no, line
            seen.add(line)


@query("custom_rule_udtf", """
WITH lines AS (SELECT doc_id, CAST(generate_subscripts(p, 1) AS INT) AS line_no, unnest(p) AS line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM lines)
SELECT 'USR002' AS rule_id, CAST(doc_id AS VARCHAR) AS target, line_no, line AS member, 'Error' AS severity FROM r WHERE nth > 1 AND trim(line) <> ''
""")
def custom_rule_udtf(spark, d):
    rules = Rules()
    rules.register_udtf("USR002", RepeatedLine, severity="Error")
    return rules.run(table(spark, d, "documents").select("doc_id", "text")).select(
        "rule_id", "target", "line_no", "member", "severity"
    )
