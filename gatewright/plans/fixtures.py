"""Derived tables the registered queries run on, all built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.session import spread, table

BALANCED_TAGS = "ul|li|a|nav|article|div|h1"
TAG_TOKENS = rf"</?(?:{BALANCED_TAGS})(?:>|\s[^>]*>)"
CLOSING = r"^</"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Documents for work on their texts."""
    return spread(table(spark, d, "documents").select(*cols), "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"), "page_id")


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """(diff_id, seq, line): a diff of 50 orders each, one file per order."""
    key = F.col("o_orderkey")
    files = table(spark, d, "orders").select(
        F.floor(key / 50).alias("diff_id"),
        (key * 100).alias("seq"),
        F.when(key % 7 == 0, "+++ /dev/null")
        .otherwise(F.concat(F.lit("+++ b/src/o"), key.cast("string"), F.when(key % 5 == 0, ".txt").otherwise(".cs")))
        .alias("line"),
    )
    count = F.col("l_quantity").cast("int") % 4
    hunks = table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 50).alias("diff_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.concat(
            F.lit("@@ -1 +"), (F.col("l_linenumber") * 10).cast("string"),
            F.when(count == 1, "").otherwise(F.concat(F.lit(","), count.cast("string"))), F.lit(" @@"),
        ).alias("line"),
    )
    return files.unionByName(hunks)


DIFF_SQL = """
diff_lines AS (
  SELECT o_orderkey // 50 AS diff_id, o_orderkey * 100 AS seq,
         CASE WHEN o_orderkey % 7 = 0 THEN '+++ /dev/null'
              ELSE '+++ b/src/o' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.txt' ELSE '.cs' END END AS line
  FROM orders
  UNION ALL
  SELECT l_orderkey // 50, l_orderkey * 100 + l_linenumber,
         '@@ -1 +' || (l_linenumber * 10)
           || CASE WHEN CAST(l_quantity AS INT) % 4 = 1 THEN '' ELSE ',' || (CAST(l_quantity AS INT) % 4) END || ' @@'
  FROM lineitem),
marked AS (
  SELECT *, CASE WHEN line LIKE '+++ b/%' THEN CASE WHEN line LIKE '%.cs' THEN substr(line, 7) ELSE '' END END AS named
  FROM diff_lines),
filed AS (
  SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM marked),
hunks AS (
  SELECT diff_id, path, CAST(regexp_extract(line, '\\+(\\d+)', 1) AS INT) AS s,
         CASE WHEN line LIKE '%,%' THEN greatest(CAST(regexp_extract(line, ',(\\d+) @@', 1) AS INT), 1) ELSE 1 END AS n
  FROM filed WHERE line LIKE '@@%' AND path <> ''),
changed AS (
  SELECT DISTINCT diff_id, path, lower(path) AS path_key, line_no FROM (
    SELECT diff_id, path, CAST(unnest(range(s, s + n)) AS INT) AS line_no FROM hunks))
"""


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """(path_key, start_line, end_line, ...) one span per line item."""
    start = F.col("l_linenumber") * 10 + 4
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".cs")).alias("path_key"),
        start.alias("start_line"),
        (start + F.col("l_quantity").cast("int") % 8).alias("end_line"),
    )


SPANS_SQL = """
spans AS (
  SELECT l_orderkey, l_linenumber, l_partkey, 'src/o' || l_orderkey || '.cs' AS path_key,
         l_linenumber * 10 + 4 AS start_line, l_linenumber * 10 + 4 + CAST(l_quantity AS INT) % 8 AS end_line
  FROM lineitem)
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a zoned `ts`, its `day` and the number of `props`."""
    return table(spark, d, "events").withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "day": F.to_date("ts"),
            "k": F.get_json_object("props", "$.k").cast("int"),
        }
    )


EVENTS_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day,
              CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as plain wall-clock time, like the given tables hold it."""
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    )


def context_key() -> F.Column:
    return F.concat(F.lit("user-"), F.col("user_id").cast("string"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run per event, failing on `error`; user 0 stands for the default branch."""
    return events(spark, d).select(
        F.col("event_id").alias("run_id"), context_key().alias("context_key"), "ts",
        (F.col("event_type") == "error").alias("failed"),
    )


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Up to two issues per user, named by label, by a tag in the title or by a tag in the body."""
    per_user = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min("k").alias("k"))
    key = context_key()
    tag = F.concat(F.lit("[Branch: "), key, F.lit("]"))
    form = F.col("issue_id") % 4
    return (
        per_user.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("user_id").cast("int") % 2)))
        .withColumn("issue_id", F.col("user_id") * 2 + F.col("copy"))
        .select(
            "issue_id",
            key.alias("context_key"),
            F.when(form == 0, F.concat(F.lit("❌ Code Quality Blocking Errors "), tag)).otherwise("Gate failed").alias("title"),
            F.when(form == 1, F.concat(F.lit("Critical Blocking Errors in "), tag, F.lit(" at src/file"), F.col("k").cast("string"), F.lit(".cs:1")))
            .when(form == 3, F.concat(F.lit("mentions "), tag)).otherwise("see report").alias("body"),
            F.when(form == 2, F.array(F.lit("code-quality-violation"), key))
            .when(form == 0, F.array(F.lit("code-quality-violation"))).otherwise(F.array().cast("array<string>")).alias("labels"),
            F.when(F.col("user_id") % 10 == 9, "closed").otherwise("open").alias("state"),
            (F.col("first_ts") + F.make_dt_interval(days=F.col("copy"))).alias("opened_at"),
        )
    )


ISSUES_SQL = """
per_user AS (SELECT user_id, min(ts) AS first_ts, min(k) AS k FROM ev GROUP BY user_id),
issues AS (
  SELECT user_id * 2 + copy AS issue_id, 'user-' || user_id AS context_key, k,
         '[Branch: user-' || user_id || ']' AS tag, (user_id * 2 + copy) % 4 AS form,
         CASE WHEN user_id % 10 = 9 THEN 'closed' ELSE 'open' END AS state,
         first_ts + copy * INTERVAL 1 DAY AS opened_at
  FROM per_user, (VALUES (0), (1)) c(copy) WHERE copy <= user_id % 2),
open_quality AS (SELECT * FROM issues WHERE state = 'open' AND form IN (0, 1, 2))
"""
