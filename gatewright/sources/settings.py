"""Layered settings and JSON settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The settings keys, their types and their defaults.
GATE_SETTINGS = {
    "MaxMethodLines": ("int", 50),
    "MaxCyclomaticComplexity": ("int", 10),
    "MaxParameterCount": ("int", 4),
    "MaxNestingDepth": ("int", 3),
    "FailOnErrors": ("boolean", True),
    "ShowcaseOnlyErrorsInConsole": ("boolean", True),
    "SaveErrorsToMarkdown": ("boolean", True),
    "ErrorsDirectory": ("string", "issues"),
    "SaveWarningsToMarkdown": ("boolean", True),
    "WarningsDirectory": ("string", "issues"),
    "SendEmailNotification": ("boolean", True),
    "EmailSubjectPrefix": ("string", "[Quality Gate]"),
    "AdditionalRecipients": ("array<string>", []),
}


def resolve_settings(layers_df: DataFrame, keys: Sequence[str] = ("key",),
                     null_only: Sequence[int] = ()) -> DataFrame:
    """Per key the value of the lowest `priority` that has one.

    A blank value counts as missing, except in the layers listed in `null_only`,
    where only a null does. Values are trimmed. A key without any value is kept with null.
    """
    value = F.trim("value")
    usable = (value != "") if not null_only else ((value != "") | F.col("priority").isin(*null_only))
    return layers_df.groupBy(*keys).agg(
        F.min_by(F.when(usable, value), F.when(usable & F.col("value").isNotNull(), F.col("priority"))).alias("value"),
        F.min(F.when(usable & F.col("value").isNotNull(), F.col("priority"))).alias("priority"),
    )


def clean_json(raw: Column) -> Column:
    """Drop comments and trailing commas, which are allowed in settings files.

    The first alternative swallows whole strings, so their content stays as it is.
    """
    string = r'("(?:[^"\\]|\\.)*")'
    no_comments = F.regexp_replace(raw, string + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(no_comments, string + r"|,(?=\s*[}\]])", "$1")


def json_settings(df: DataFrame, col: str, schema: Mapping[str, str],
                  defaults: Mapping[str, object], out: str = "settings") -> DataFrame:
    """Typed struct from a JSON object column; key case is ignored, the last duplicate wins.

    Text that is no JSON object, and a value that does not fit its type, give the default.
    """
    pairs = F.map_entries(
        F.from_json(clean_json(F.col(col)), T.MapType(T.StringType(), T.StringType()))
    )

    def typed(name: str, dtype: str) -> Column:
        hits = F.filter(F.col("__pairs"), lambda e: F.lower(e["key"]) == name.lower())
        text = F.try_element_at(hits, F.lit(-1))["value"]
        value = F.from_json(text, dtype) if dtype.startswith("array") else text.try_cast(dtype)
        default = defaults.get(name)
        if isinstance(default, list):
            fallback = F.array(*[F.lit(v) for v in default]).cast(dtype)
        else:
            fallback = F.lit(default).cast(dtype)
        return F.coalesce(value, fallback).alias(name)

    return (
        df.withColumn("__pairs", pairs)
        .withColumn(out, F.struct(*[typed(n, t) for n, t in schema.items()]))
        .drop("__pairs")
    )


def gate_settings(df: DataFrame, col: str, out: str = "settings") -> DataFrame:
    """`json_settings` with the keys and defaults of the gate itself."""
    return json_settings(
        df, col,
        {k: t for k, (t, _) in GATE_SETTINGS.items()},
        {k: v for k, (_, v) in GATE_SETTINGS.items()},
        out,
    )
