"""Sources of text: files, path filters and numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of every matching file below `root`, one row per file."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def select_sources(
    df: DataFrame,
    path_col: str,
    include: Sequence[str] = (),
    exclude_fragments: Sequence[str] = (),
    exclude_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Keep rows by path. Suffixes ignore case, fragments do not; `\\` counts as `/`."""
    path = F.replace(F.col(path_col), F.lit("\\"), F.lit("/"))
    folded = F.lower(path)
    keep: Column = F.lit(True)
    if include:
        wanted = F.lit(False)
        for suffix in include:
            wanted = wanted | folded.endswith(suffix.lower())
        keep = keep & wanted
    for fragment in exclude_fragments:
        keep = keep & ~path.contains(fragment.replace("\\", "/"))
    for suffix in exclude_suffixes:
        keep = keep & ~folded.endswith(suffix.lower())
    return df.filter(keep)


def lines_of(text: str) -> str:
    """SQL array of the lines of a text column, for any line ending.

    Texts without a carriage return, nearly all, take the single-character split,
    which needs no pattern matching.
    """
    return (
        f"CASE WHEN contains({text}, '\\r') THEN split({text}, '\\r\\n|\\r|\\n') "
        f"ELSE split({text}, '\\n') END"
    )


def to_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line, numbered from 1. No shuffle: a text never leaves its row."""
    return df.select(id_col, F.posexplode(F.expr(lines_of(text_col)))).select(
        id_col, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line")
    )


def line_count(text: str) -> Column:
    return F.expr(f"size({lines_of(text)})")
