"""Keys that tell the rows of a document table apart, whatever its ids are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import stage

KEY = ["id", "th"]
NO_ID = -(1 << 63)


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns, never null: the id, or the least number for none, and a hash of the text."""
    return [
        F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text, text.isNull(), doc_id.isNull()).alias("th"),
    ]


def id_of(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, with all their columns, of any names, less the rows whose key is in `gone` (id, th)."""
    gone = stage(gone.select(*KEY).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(F.col(doc_id), F.col(text)))
    return rows.join(gone, KEY, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
