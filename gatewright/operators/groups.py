"""Rules about what a group holds, lacks, repeats or holds in the wrong order.

Every operator aggregates before it joins, so a hot group reaches a join as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unguarded(actions: DataFrame, guards: DataFrame, scope_keys: Sequence[str]) -> DataFrame:
    """Actions with no guard in the same scope."""
    return actions.join(guards.select(*scope_keys).distinct(), list(scope_keys), "left_anti")


def inverted_pairs(pairs: DataFrame, group: Sequence[str], first: str = "a", second: str = "b") -> DataFrame:
    """(group, a, b) met in both orders, with how often and where first.

    Both orders of a pair share one group row, so no row is joined with another:
    n_ab x n_ba is the number of conflicting occurrences.
    """
    low, high = F.least(first, second), F.greatest(first, second)
    forward = F.col(first) < F.col(second)
    return (
        pairs.filter(F.col(first) != F.col(second))
        .groupBy(*group, low.alias("a"), high.alias("b"))
        .agg(F.count_if(forward).alias("n_ab"), F.count_if(~forward).alias("n_ba"))
        .filter((F.col("n_ab") > 0) & (F.col("n_ba") > 0))
    )


def after_terminal(df: DataFrame, group: Sequence[str], order: Sequence[str], terminal: Column) -> DataFrame:
    """The row right after the first terminal row of each group."""
    at = F.struct(*order)
    stops = (
        df.filter(terminal).groupBy(*group).agg(F.min(at).alias("__stop"))
    )
    later = df.join(stops, list(group)).filter(at > F.col("__stop"))
    row = F.struct(*[F.col(c) for c in df.columns if c not in group])
    return (
        later.groupBy(*group).agg(F.min_by(row, at).alias("__row"))
        .select(*group, "__row.*").select(df.columns)
    )


def presence_xor(df: DataFrame, group: Sequence[str], a: Column, b: Column,
                 a_name: str, b_name: str) -> DataFrame:
    """Groups holding exactly one of two kinds, and which one is missing."""
    return (
        df.groupBy(*group)
        .agg(F.coalesce(F.bool_or(a), F.lit(False)).alias("__a"), F.coalesce(F.bool_or(b), F.lit(False)).alias("__b"))
        .filter(F.col("__a") != F.col("__b"))
        .select(*group, F.when(F.col("__a"), F.lit(b_name)).otherwise(F.lit(a_name)).alias("missing"))
    )


def extras(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Every member after the first of its group, with the first one's name.

    `order` must be unique within a group.
    """
    at = F.struct(*order)
    firsts = df.groupBy(*group).agg(
        F.min(at).alias("__first"), F.min_by(F.col(name), at).alias("first_name")
    )
    return df.join(firsts, list(group)).filter(at > F.col("__first")).drop("__first")


def repeat_use(df: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """Keys used at least `n` times."""
    return df.groupBy(*keys).agg(F.count("*").alias("uses")).filter(F.col("uses") >= n)


def missing_member(df: DataFrame, group: Sequence[str], pred: Column) -> DataFrame:
    """Non-empty groups in which no member satisfies `pred`."""
    return (
        df.groupBy(*group)
        .agg(F.count("*").alias("members"), F.coalesce(F.bool_or(pred), F.lit(False)).alias("__has"))
        .filter(~F.col("__has")).drop("__has")
    )


def empty_groups(parent: DataFrame, child: DataFrame, key: Sequence[str]) -> DataFrame:
    """Owners without children."""
    return parent.join(child.select(*key).distinct(), list(key), "left_anti")


def token_not_passed(scopes: DataFrame, calls: DataFrame, keys: Sequence[str], token: str = "token",
                     args: str = "args") -> DataFrame:
    """Calls inside a scope that owns a token, whose arguments omit it.

    A scope owns one token (its first). `args` is the argument array of one call.
    """
    owners = scopes.filter(F.col(token).isNotNull()).select(*keys, token)
    return calls.join(owners, list(keys)).filter(~F.coalesce(F.array_contains(args, F.col(token)), F.lit(False)))


def layer_boundary(sources: DataFrame, path: str, refs: DataFrame, ref_key: str, ref: str,
                   policy: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of a path class that reference something its class must not.

    `policy` lists (path pattern, forbidden reference pattern); it is written into
    the plan as expressions, so the join is the equi join of sources and references.
    """
    broken = F.lit(False)
    for path_regex, ref_regex in policy:
        broken = broken | (F.col(path).rlike(path_regex) & F.col(ref).rlike(ref_regex))
    governed = F.lit(False)
    for path_regex, _ in policy:
        governed = governed | F.col(path).rlike(path_regex)
    suspects = F.lit(False)
    for _, ref_regex in policy:
        suspects = suspects | F.col(ref).rlike(ref_regex)
    return sources.filter(governed).join(refs.filter(suspects), ref_key).filter(broken)
