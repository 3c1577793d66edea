"""Rules that need nothing but their own row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_divisor(df: DataFrame, num: str, den: str, fallback: float = 0.0) -> DataFrame:
    """Rows whose divisor is 0, with the quotient a safe division would give."""
    return df.filter(F.col(den) == 0).withColumn("safe_quotient", safe_divide(F.col(num), F.col(den), fallback))


def safe_divide(num: Column, den: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(fallback))


def identical(df: DataFrame, a: str, b: str, null_safe: bool = False) -> DataFrame:
    """Rows whose two operands are equal."""
    return df.filter(F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b))


def pascal(name: Column) -> Column:
    """Split on `_`, upper-case the first letter of each part, keep the rest.

    A name of nothing but underscores stays as it is.
    """
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    joined = F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""
    )
    return F.when(F.size(parts) == 0, name).otherwise(joined)


def camel(name: Column) -> Column:
    form = pascal(name)
    return F.concat(F.lower(F.substring(form, 1, 1)), F.substr(form, F.lit(2)))


def magic_numbers(df: DataFrame, col: str, condition: Column | None = None,
                  allowed: Sequence[int] = (100,)) -> DataFrame:
    """One row per integer literal above 1 that is not an allowed number.

    Text that does not fit an int is no integer literal and is skipped.
    """
    kept = df if condition is None else df.filter(condition)
    found = F.explode(F.regexp_extract_all(F.col(col), F.lit(r"\d+"), F.lit(0)))
    number = F.col("__literal").try_cast("int")
    return (
        kept.withColumn("__literal", found)
        .withColumn("literal", number)
        .filter((F.col("literal") > 1) & ~F.col("literal").isin(*allowed))
        .drop("__literal")
    )


def chain_depth(df: DataFrame, col: str, n: int = 3, exempt: Sequence[str] = (),
                unless_contains: Sequence[str] = ("?.",)) -> DataFrame:
    """Dotted chains with at least `n` dots."""
    dots = F.length(col) - F.length(F.replace(F.col(col), F.lit("."), F.lit("")))
    kept = df.withColumn("dots", dots).filter(F.col("dots") >= n)
    for text in unless_contains:
        kept = kept.filter(~F.col(col).contains(text))
    for prefix in exempt:
        kept = kept.filter(~F.col(col).startswith(prefix))
    return kept
