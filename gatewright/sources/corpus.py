"""A corpus of source-code texts spread over the rows of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.catalogue.templates import NEWLINE, ROWS
from gatewright.session import inline_table, spread_rows

#: Files that a partition of the corpus holds. A part is some bytes, its text up to 10 KB, so the parts of one split are very many texts.
FILES = 4096


def code_corpus(part: DataFrame) -> DataFrame:
    """(file_id, path, text, tid, rule_id, violating): each part gets one template.

    Parts are dealt out before their texts are made, so the work on texts is in partitions of `FILES` files.
    """
    spark = part.sparkSession
    rows = [(t, r, v, d, b.replace("\n", NEWLINE)) for t, r, v, d, b in ROWS]
    templates = inline_table(
        spark, rows, "tid bigint, rule_id string, violating boolean, dir string, body string"
    )
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.replace(F.replace("body", F.lit("{id}"), F.col("p_partkey").cast("string")), F.lit("{name}"), name)
    return (
        spread_rows(part.select("p_partkey", "p_name", "p_brand"), FILES).withColumn("tid", F.col("p_partkey") % len(rows))
        .join(templates, "tid")
        .select(
            F.col("p_partkey").alias("file_id"),
            F.concat("dir", F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".cs")).alias("path"),
            F.replace(text, F.lit(NEWLINE), F.lit("\n")).alias("text"),
            "tid", "rule_id", "violating",
        )
    )


def corpus_sql() -> str:
    """`code_corpus` in SQL."""
    def q(t):
        return "'" + t.replace("'", "''") + "'"

    values = ",\n".join(
        f"({t}, {q(r)}, {v}, {q(d)}, {q(b.replace(chr(10), NEWLINE))})" for t, r, v, d, b in ROWS
    )
    return f"""templates(tid, rule_id, violating, dir, body) AS (VALUES {values}),
code_corpus AS (
  SELECT p_partkey AS file_id, dir || replace(p_brand, '#', '') || '_' || p_partkey || '.cs' AS path,
         replace(replace(replace(body, '{{id}}', CAST(p_partkey AS VARCHAR)), '{{name}}', replace(p_name, ' ', '_')), '{NEWLINE}', chr(10)) AS text,
         t.tid, t.rule_id, t.violating
  FROM part JOIN templates t ON p_partkey % {len(ROWS)} = t.tid)"""
