"""Values found elsewhere: the latest earlier one, the end of a chain, the nearest declaration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.ordered import RowBlocks, last_before
from gatewright.session import materialise


def latest_before(uses: DataFrame, assigns: DataFrame, keys: Sequence[str], ts: str,
                  value: str, block: Column | RowBlocks | None, out: str = "assigned") -> DataFrame:
    """Each use with the value of the latest assignment strictly before it.

    Both sides are laid on one time line. A use at the same instant as an
    assignment does not see it: uses sort first. Of assignments sharing an
    instant the larger value wins.
    """
    cols = uses.columns
    timeline = uses.select(
        *keys, ts, F.lit(0).alias("__kind"), F.struct(*cols).alias("__use"),
        F.lit(None).cast(assigns.schema[value].dataType).alias("__value"),
    ).unionByName(
        assigns.filter(F.col(value).isNotNull()).select(
            *keys, ts, F.lit(1).alias("__kind"),
            F.lit(None).cast(uses.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("__use"),
            F.col(value).alias("__value"),
        )
    )
    seen = last_before(timeline, keys, [ts, "__kind", "__value"], block, F.col("__value"), out)
    return seen.filter(F.col("__kind") == 0).select("__use.*", out)


RESOLVED, DANGLING, ON_CYCLE, TO_CYCLE = "resolved", "dangling", "cycle", "to_cycle"


def chain_ends(df: DataFrame, key: str, ref: str, literal: str) -> DataFrame:
    """Where key -> key references end: (key, value, depth, status, cycle), one row per key.

    A row without a reference is terminal and holds the literal: its chain is `resolved`, with the
    number of steps as depth. A reference to a key that is not there is `dangling`. Keys of a cycle
    are `cycle`, keys that lead into one `to_cycle`; both carry the least key of the cycle. Of rows that
    share a key the one with the least (reference, literal) stands, so one without a reference first.

    References are doubled every round until no row is open, so the number of joins is the
    logarithm of the longest chain. A row still open after more steps than there are keys leads to
    a cycle, and what such rows point to by then are just the keys of cycles. Each round is written
    out, so the plan does not grow. A key that very many point to is one row on its side of
    the join, so Spark may split the other side.
    """
    firsts = df.groupBy(F.col(key).alias("key")).agg(
        F.min(F.struct(F.col(ref).alias("ref"), F.col(literal).alias("literal"))).alias("row")
    )
    # `jump` is the node after `depth` steps, `low` the least key on the way; `value` is set once it is terminal.
    state = materialise(firsts.select(
        "key", F.col("row.ref").alias("jump"),
        F.when(F.col("row.ref").isNull(), F.col("row.literal")).alias("value"),
        F.when(F.col("row.ref").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("key").alias("low"), F.lit(False).alias("lost"),
    ))
    is_open = F.col("jump").isNotNull()
    for _ in range(state.count().bit_length() + 1):
        open_rows = state.filter(is_open)
        if open_rows.isEmpty():
            break
        target = state.select(*[F.col(c).alias(f"t_{c}") for c in state.columns])
        moved = open_rows.join(target, F.col("jump") == F.col("t_key"), "left").select(
            "key", F.col("t_jump").alias("jump"), F.col("t_value").alias("value"),
            (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"),
            F.least("low", "t_low").alias("low"), F.coalesce("t_lost", F.lit(True)).alias("lost"),
        )
        state = materialise(state.filter(~is_open).unionByName(moved))
    status = F.when(F.col("lost"), F.lit(DANGLING)).otherwise(F.lit(RESOLVED))
    ended = state.filter(~is_open).select(
        "key", "value", F.when(~F.col("lost"), F.col("depth").cast("int")).alias("depth"), status.alias("status"),
        F.lit(None).cast(state.schema["key"].dataType).alias("cycle"),
    )
    looped = state.filter(is_open)
    members = looped.join(looped.select(F.col("jump").alias("key")).distinct(), "key", "left_semi").select(
        F.col("key").alias("member"), F.col("low").alias("cycle"))
    rounds = looped.join(members, F.col("jump") == F.col("member")).drop("member").join(
        members.select("member"), F.col("key") == F.col("member"), "left"
    ).select(
        "key", "value", F.lit(None).cast("int").alias("depth"),
        F.when(F.col("member").isNull(), F.lit(TO_CYCLE)).otherwise(F.lit(ON_CYCLE)).alias("status"), "cycle",
    )
    return ended.unionByName(rounds)


def resolve_chain(df: DataFrame, key: str, ref: str, literal: str) -> DataFrame:
    """The terminal literal of each key by `chain_ends`: (key, value, depth); cycles and dangling references give null."""
    ends = chain_ends(df, key, ref, literal)
    return ends.select("key", "value", F.when(F.col("value").isNotNull(), F.col("depth")).alias("depth"))


def classify(uses: DataFrame, decls: DataFrame, keys: Sequence[str],
             name_lists: Sequence[tuple[str, Sequence[str]]], name: str, default: str,
             out: str = "kind") -> DataFrame:
    """Kind of each use from its nearest declaration, else from name lists, else a default.

    `decls` is (keys, priority, kind) with 1 the nearest. One row per key is kept
    before the join. A declaration whose kind is null decides nothing.
    """
    nearest = (
        decls.filter(F.col("kind").isNotNull())
        .groupBy(*keys).agg(F.min_by("kind", F.struct("priority", "kind")).alias("__kind"))
    )
    by_name: Column = F.lit(None).cast("string")
    for kind, names in reversed(list(name_lists)):
        by_name = F.when(F.lower(name).isin([n.lower() for n in names]), F.lit(kind)).otherwise(by_name)
    return (
        uses.join(nearest, list(keys), "left")
        .withColumn(out, F.coalesce("__kind", by_name, F.lit(default)))
        .drop("__kind")
    )
