"""Intervals of whole numbers as dyadic blocks, so that a long one is a few rows.

Level j cuts the numbers into blocks of 2 ** j. An interval of n numbers is the union of at most
2 * log2(n) blocks, its cover; a number lies in one block of each level. So a number is in an
interval just if one of its blocks, at a level that occurs in covers, is in the cover: an equi join on
(level, block) that meets each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "array<struct<level:int,block:bigint>>"


def _shift(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _block(level: Column, block: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), block.cast("bigint").alias("block"))


def cover(first: Column, last: Column) -> Column:
    """Blocks of first..last, both bigint and inclusive; none for a reversed or null interval."""
    top = F.floor(F.log2((last - first + 1).cast("double"))).cast("int")

    def at(level: Column) -> Column:
        # What is left of the interval at a level starts at `low` and ends before `high`; an odd end is a block of its own.
        low = _shift(first + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)
        high = _shift(last + 1, level)
        none = F.array().cast(BLOCK)
        left = F.when((low < high) & (F.abs(low % 2) == 1), F.array(_block(level, low))).otherwise(none)
        right = F.when((low < high - 1) & (F.abs(high % 2) == 1), F.array(_block(level, high - 1))).when(
            (low == high - 1) & (F.abs(low % 2) == 0), F.array(_block(level, low))).otherwise(none)
        return F.concat(left, right)

    return F.when(last >= first, F.flatten(F.transform(F.sequence(F.lit(0), top + 1), at))).otherwise(F.array().cast(BLOCK))


def block_at(number: Column, level: Column) -> Column:
    """The block of a number at a level."""
    return _shift(number.cast("bigint"), level)
