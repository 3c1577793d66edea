"""Chat formatting by Spark expressions only: turns to one marked text with a loss mask, and back.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become
one block, found by array functions; blocks are joined. A block is OPEN, the role, a line feed, its
turns with BETWEEN between them, and CLOSE. Control strings inside texts and roles (those of the
template and those of other common templates) get a backslash after their first character; ones that
have backslashes there get one more. So no text can hold a mark, and taking one backslash off
gives the text back. Line feeds and backslashes in roles are written as \\n and \\b.

The loss mask is a list of (start, length) in code points, one per turn of a role under loss: its
escaped text without any mark, so it is also the list of what is left when all marks are taken off.

Rows: turns are ordered by turn, none first, then by role and text, so repeated rows are repeated
turns. A null text or role is an empty one. Rows without a conversation id are one conversation
without id. Other columns are not read, whatever their names are. An empty table gives an
empty table. A conversation is one row, as in any training file; rows are combined by
conversation before and after the only shuffle, and texts are never cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import inline_table

# Fixed strings: marks of this template, then those of other common ones that texts may try to pass for.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = [
    OPEN, BETWEEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]",
]
LOSS_ROLES = ("assistant",)

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
PLAIN = rf"([<\[])(\\*)({_RESTS})"
ESCAPED = rf"([<\[])\\(\\*)({_RESTS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_chat(table: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, conv_id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and its loss mask, an array of (start, length)."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = table.select(F.col(conv_id).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    # Columns that lambdas read are named more than once, so that plans keep them as columns and compute them once a row.
    marked = turns.select("conv_id", F.transform("turns", lambda t, i: F.struct(
        t.role.alias("role"), escape(t.text).alias("text"),
        ((i == 0) | (F.get("turns", i - 1).role != t.role)).alias("first"),
    )).alias("marked"))
    heads = marked.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("marked") - 1), lambda i: F.get("marked", i).first))
    blocks = heads.select("conv_id", F.transform("heads", lambda at, k: F.struct(
        F.get("marked", at).role.alias("role"),
        F.transform(F.slice("marked", at + 1, F.coalesce(F.get("heads", k + 1), F.size("marked")) - at), lambda m: m.text).alias("texts"),
    )).alias("blocks"))
    blocks = blocks.withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        b.role.isin(*loss_roles).alias("learned"),
        F.concat(F.lit(OPEN), _role_out(b.role), F.lit("\n")).alias("head"), b.texts.alias("texts"),
    )))

    span = "array<struct<start:int,length:int>>"

    def one_text(state: Column, said: Column, learned: Column) -> Column:
        here = F.array(F.struct(state.at.alias("start"), F.length(said).alias("length")))
        return F.struct(
            (state.at + F.length(said) + len(BETWEEN)).alias("at"),
            F.when(learned, F.concat(state.spans, here)).otherwise(state.spans).alias("spans"),
        )

    def one_block(state: Column, block: Column) -> Column:
        inside = F.struct((state.at + F.length(block["head"])).alias("at"), state.spans.alias("spans"))
        after = F.aggregate(block.texts, inside, lambda s, said: one_text(s, said, block.learned))
        return F.transform(F.array(after), lambda s: F.struct((s.at - len(BETWEEN) + len(CLOSE) + 1).alias("at"), s.spans.alias("spans")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b.texts, BETWEEN), F.lit(CLOSE + "\n"))), "").alias("formatted"),
        F.aggregate("blocks", start, one_block, lambda s: s.spans).alias("loss"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text again: array of (role, text)."""
    def block(text: Column) -> Column:
        inner = F.substr(text, F.lit(len(OPEN) + 1))
        name = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.length(name) + 2)
        return F.transform(F.split(body, re.escape(BETWEEN)), lambda said: F.struct(_role_in(name).alias("role"), unescape(said).alias("text")))

    parts = F.split(formatted, re.escape(CLOSE + "\n"))
    return F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), block))


def learned_text(formatted: Column, loss: Column) -> Column:
    """What stands under a loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))), "")


PROBE = "</s>[INST] ok [/INST]"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = inline_table(spark, [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    found = format_chat(table.unionByName(probe))
    found = found.withColumn("turns", read_chat(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("loss")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_OUT = f"regexp_replace({{}}, '{PLAIN}', '{chr(92)}1{chr(92) * 3}2{chr(92)}3', 'g')"
ORACLE_SQL = rf"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
placed AS (
    SELECT *, coalesce(lag(role) OVER o <> role, true) AS first, row_number() OVER o AS nth FROM said
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_OUT.format('text')}) + CASE WHEN first THEN {len(OPEN) + len(CLOSE) + 2} + length(replace(replace({_OUT.format('role')}, '\', '\b'), chr(10), '\n'))
                                                ELSE {len(BETWEEN)} END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
