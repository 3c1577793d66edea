"""Recipient lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the separators of an address list.
SEPARATORS = r"[,; \n\r]+"


def recipients(df: DataFrame, list_key: Sequence[str], order: Sequence[str], raw: str,
               pattern: str = "@") -> DataFrame:
    """Distinct addresses of each list with their place and role.

    `raw` texts of one list are read in `order`; parts that do not match `pattern`
    are no addresses. Case does not distinguish and the first spelling stays. The
    first address is To, the rest are Cc. Duplicates fall together before any
    row of a list meets another list row, so a long list is never gathered.
    """
    parts = (
        df.select(*list_key, F.struct(*order).alias("__o"), F.posexplode(F.split(F.col(raw), SEPARATORS)))
        .select(*list_key, F.struct("__o", "pos").alias("at"), F.trim("col").alias("address"))
        .filter((F.col("address") != "") & F.col("address").rlike(pattern))
    )
    distinct = parts.groupBy(*list_key, F.lower("address").alias("address_key")).agg(
        F.min_by("address", "at").alias("address"), F.min("at").alias("at")
    )
    firsts = distinct.groupBy(*list_key).agg(F.min("at").alias("__first"))
    return distinct.join(firsts, list(list_key)).withColumn("role", F.when(F.col("at") == F.col("__first"), "To").otherwise("Cc")).drop(
        "__first"
    )
