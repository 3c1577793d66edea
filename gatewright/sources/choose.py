"""Ordered candidate sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_non_empty(candidates: Sequence[DataFrame], priority_col: str = "priority") -> DataFrame:
    """The first candidate that has a row, tagged with its 1-based position.

    Each probe stops at the first row it meets, and only the chosen source is
    planned afterwards; the others are never scanned in full.
    """
    for position, df in enumerate(candidates, start=1):
        if position == len(candidates) or not df.isEmpty():
            return df.withColumn(priority_col, F.lit(position))
    raise ValueError("no candidate sources")
