"""Unified diff text as a table of changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.operators.ordered import RowBlocks, last_before

# Fixed values of the diff format.
FILE_PREFIX = "+++ b/"
HUNK = r"^@@\s+-\d+(?:,\d+)?\s+\+(\d+(?:,\d+)?)\s+@@"


def _current_file(lines_df: DataFrame, suffix: str) -> DataFrame:
    """(diff_id, seq, range, path): each hunk's range of new lines, as it is written, with the file it belongs to.

    Only a `+++ b/` line switches files, so the hunks of a deleted file
    (`+++ /dev/null`) stay with the file named before. A file without the
    wanted suffix switches to "no file", stored as an empty path. A line is matched once, before
    it is dealt out, and only its range is shuffled.
    """
    name = F.trim(F.expr(f"substr(line, {len(FILE_PREFIX) + 1})"))
    named = F.when(
        F.col("line").startswith(FILE_PREFIX),
        F.when(F.lower(name).endswith(suffix.lower()), name).otherwise(F.lit("")),
    )
    relevant = lines_df.filter(
        F.col("line").startswith(FILE_PREFIX) | F.col("line").startswith("@@")
    ).select("diff_id", "seq", named.alias("__named"), F.regexp_extract("line", HUNK, 1).alias("range"))
    return last_before(
        relevant, ["diff_id"], ["seq"], RowBlocks(), F.col("__named"), "path", inclusive=True
    ).filter((F.col("path") != "") & (F.col("range") != "")).drop("__named")


def diff_to_ranges(lines_df: DataFrame, suffix: str = ".cs") -> DataFrame:
    """(diff_id, path, path_key, first_line, last_line) of every hunk of changed lines.

    `lines_df` is (diff_id, seq, line) with `seq` unique over file headers of a diff.
    A hunk without a count is one line, and so is one with count 0.
    """
    start = F.substring_index("range", ",", 1).try_cast("int")
    count = F.coalesce(F.when(F.contains("range", F.lit(",")), F.substring_index("range", ",", -1).try_cast("int")), F.lit(1))
    return (
        _current_file(lines_df, suffix)
        .select("diff_id", "path", F.lower("path").alias("path_key"), start.alias("first_line"),
                (start + F.greatest(count, F.lit(1)) - 1).alias("last_line"))
        .filter(F.col("first_line").isNotNull())
    )


def diff_to_lines(lines_df: DataFrame, suffix: str = ".cs") -> DataFrame:
    """(diff_id, path, path_key, line_no) of every changed line."""
    return (
        diff_to_ranges(lines_df, suffix)
        .select("diff_id", "path", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
        .distinct()
        .select("diff_id", "path", F.lower("path").alias("path_key"), "line_no")
    )


def diff_files(lines_df: DataFrame, suffix: str = ".cs") -> DataFrame:
    """(diff_id, path, path_key) of every selected file, also those without hunks."""
    name = F.trim(F.expr(f"substr(line, {len(FILE_PREFIX) + 1})"))
    return (
        lines_df.filter(F.col("line").startswith(FILE_PREFIX))
        .select("diff_id", name.alias("path"))
        .filter(F.lower("path").endswith(suffix.lower()))
        .withColumn("path_key", F.lower("path"))
        .distinct()
    )
