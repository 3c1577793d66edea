"""Trie of conversation prefixes: a node table behind a minimal perfect hash, built shard by shard.

A turn is known by 16 bytes of the SHA-256 of its role and text, a prefix by the SHA-256 of its parent
prefix and its last turn, cut likewise; texts are not shuffled. Conversations that are equal as a whole become
one path with its members counted, so a much copied conversation is one row. Paths are dealt to shards by their first
prefix that at most HEAVY paths share, so a light subtree is whole in its shard and a shard is bounded however
many conversations share an opening. Heavy prefixes, above those, are in many shards.

A shard enumerates its distinct prefixes, gives each a slot by a minimal perfect hash (levels of
bit maps, a slot is the rank of its bit), and checks every look-up against the digest kept in the slot, and that all
paths agree on the parent and the last turn of a prefix. Counts are scattered into flat arrays by slot and
accumulated through an array of parent slots, deepest slots first. What a shard knows of its heavy
prefixes is summed up over shards; each belongs to one shard, that of its smallest member, which alone counts it as a node.

The hash over the members that end at a node takes its ids in order, which may be a third of all.
They are sorted in ranges and made texts of bounded size there, and a node's texts go through one hash
in order, a batch at a time.

Rows: turns are ordered by turn, none first; turns of one number by their digests. A null role or text is an empty
one. Rows without a conversation id take no part. Repeated rows are repeated turns. Other columns are not read,
whatever their names are. An empty table has no nodes, as the root needs a member. A rebuilt conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import stage

#: Conversations of a family share the openings of its first member, up to OPENINGS - 1 turns.
FAMILY, OPENINGS = 5, 9
#: Paths that a prefix may have in one shard; turns a shard holds on average; ids in one text of members.
HEAVY, SHARD_TURNS, IDS = 64, 1 << 17, 4096
WIDTH = 16
ROOT = bytes(WIDTH)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Bits a level of the hash has for each key that is still without a slot.
ROOM = 2


def conversation_paths(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                       family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """(conv_id, pid, depth, digests, sizes) per rebuilt conversation.

    `digests` holds the prefixes of depth 1 on, 16 bytes each, `sizes` the UTF-8 bytes of their last texts; pid is the last digest.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.struct(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, WIDTH).alias("digest"),
        F.octet_length(text_).cast("bigint").alias("size"),
    )
    turns = table.filter(F.col(conv_id).isNotNull()).select((F.col(conv_id).cast("bigint") - F.col(conv_id).cast("bigint") % family).alias("first"), said.alias("said"))
    # A family has a few conversations, so what is collected is bounded by their length.
    families = turns.groupBy("first").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = said.values
                convs = said.field("conv").to_numpy()
                digests, sizes = said.field("digest").to_pylist(), said.field("size").to_numpy()
                ids, starts = np.unique(convs, return_index=True)
                ends = [*starts[1:].tolist(), len(convs)]
                place = dict(zip(ids.tolist(), zip(starts.tolist(), ends, strict=True), strict=True))
                base = place.get(first, (0, 0))
                for conv, (start, end) in place.items():
                    h = crc32(str(conv).encode()) % openings
                    rows = [*range(base[0], min(base[1], base[0] + h)), *range(min(end, start + h), end)]
                    path, last = [], ROOT
                    for at in rows:
                        last = hashlib.sha256(last + digests[at]).digest()[:WIDTH]
                        path.append(last)
                    out.append((conv, last, len(path), b"".join(path), sizes[rows].tolist() if rows else []))
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "pid", "depth", "digests", "sizes"])

    return families.mapInArrow(rebuild, "conv_id bigint, pid binary, depth int, digests binary, sizes array<bigint>")


def member_hashes(members: DataFrame) -> DataFrame:
    """(pid, first, n, ends): smallest member, number and hash of the members of each path.

    Ids are sorted over all tasks, so that a path with a third of all members is spread too.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), IDS):
                part = batch.slice(at, IDS)
                pids, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                cuts = [0, *(i for i in range(1, len(ids)) if pids[i] != pids[i - 1]), len(ids)]
                runs = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.record_batch([
                    pa.array([pids[a] for a, _ in runs], pa.binary()), pa.array([ids[a] for a, _ in runs], pa.int64()),
                    pa.array([b - a for a, b in runs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string()),
                ], names=["pid", "first", "n", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_ = [], None  # open_: pid, first, n, hash
        for batch in batches:
            for pid, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0] == pid:
                    open_[2] += n
                    open_[3].update(b"," + ids.encode())
                else:
                    out += [open_] if open_ else []
                    open_ = [pid, first, n, hashlib.sha256(ids.encode())]
            yield _hashed(out)
            out = []
        yield _hashed([open_] if open_ else [])

    ordered = members.select("pid", "conv_id").repartitionByRange("pid", "conv_id").sortWithinPartitions("pid", "conv_id")
    written = ordered.mapInArrow(texts, "pid binary, first bigint, n bigint, ids string")
    return written.repartition("pid").sortWithinPartitions("pid", "first").mapInArrow(hashes, "pid binary, first bigint, n bigint, ends string")


def _hashed(rows: list) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].hexdigest() for r in rows], pa.string()),
    ], names=["pid", "first", "n", "ends"])


class Slots:
    """Minimal perfect hash of distinct 16-byte keys, given as an array of two 64-bit words each.

    On each level a key is hashed to a bit; keys that are alone at theirs are done, the others go on. A key's
    slot is the number of set bits before its own. The key is kept in its slot, so a look-up of another key is noticed.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = keys, 0
        while len(left):
            at = self._bit(left, len(self.levels), ROOM * len(left))
            taken = np.bincount(at, minlength=ROOM * len(left))
            bits = taken == 1
            self.levels.append((bits, before + np.cumsum(bits) - bits))
            before += int(bits.sum())
            left = left[~bits[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._slots(keys)] = keys
        self.of(keys)  # raises if two keys share a slot

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ x >> np.uint64(29)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._bit(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        if len(keys) and (slots.min() < 0 or (self.keys[slots] != keys).any()):
            raise KeyError("a prefix has no slot of its own")
        return slots


def _shard_nodes(paths: pa.Table) -> pa.Table:
    """Nodes of the paths of one shard; what is known here of heavy ones."""
    depth = paths.column("depth").to_numpy().astype(np.int64)
    n, first = paths.column("n").to_numpy(), paths.column("first").to_numpy()
    heavy = paths.column("heavy").to_pylist()  # smallest members of the heavy prefixes, from depth 0 on
    digests = np.frombuffer(b"".join(ROOT + d for d in paths.column("digests").to_pylist()), dtype=np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(depth)), depth + 1)
    start = np.cumsum(depth + 1) - depth - 1
    at = np.arange(len(digests)) - start[row]  # depth of each prefix
    size = np.zeros(len(digests), dtype=np.int64)
    size[at > 0] = np.concatenate([np.asarray(x, dtype=np.int64) for x in paths.column("sizes").to_pylist()])

    slots = Slots(np.unique(digests, axis=0))
    slot = slots.of(digests)
    count = len(slots.keys)
    parent, level, last = np.full(count, -1), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    below = np.flatnonzero(at > 0)
    parent[slot[below]], level[slot], last[slot] = slot[below - 1], at, size
    if (parent[slot[below]] != slot[below - 1]).any() or (level[slot] != at).any() or (last[slot] != size).any():
        raise ValueError("two prefixes have one digest")

    members, least = np.zeros(count, dtype=np.int64), np.full(count, np.iinfo(np.int64).max)
    np.add.at(members, slot, n[row])
    np.minimum.at(least, slot, first[row])
    # Heavy prefixes: their smallest member is known for all shards, and belongs to one of them.
    is_heavy = np.zeros(count, dtype=bool)
    own = np.ones(count, dtype=bool)
    for i, mins in enumerate(heavy):
        here = slot[start[i]: start[i] + len(mins)]
        is_heavy[here], own[here] = True, least[here] == mins
    for i, mins in enumerate(heavy):
        least[slot[start[i]: start[i] + len(mins)]] = mins

    children = np.zeros(count, dtype=np.int64)
    mine = np.flatnonzero((parent >= 0) & own)
    np.add.at(children, parent[mine], 1)
    # A heavy prefix has more paths than one, so it is never a leaf.
    leaves = ((children == 0) & ~is_heavy).astype(np.int64)
    saved = (members - own) * last
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for group in np.split(order, cuts):
        if level[group[0]]:
            np.add.at(leaves, parent[group], leaves[group])
            np.add.at(saved, parent[group], saved[group])

    ends = np.full(count, None, dtype=object)
    ends[slot[start + depth]] = paths.column("ends").to_pylist()
    digest = slots.keys.tobytes()
    return pa.table({
        "digest": pa.array([digest[WIDTH * i: WIDTH * i + WIDTH] for i in range(count)], pa.binary()),
        "conv_id": least, "depth": level,
        "parent_conv_id": pa.array([None if p < 0 else int(least[p]) for p in parent], pa.int64()),
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends": pa.array(ends.tolist(), pa.string()), "heavy": is_heavy,
    })


def prefix_trie(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                heavy: int = HEAVY, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest), a row per node."""
    spark = table.sparkSession
    convs = stage(conversation_paths(table, conv_id, turn, role, text), "paths")
    ends = member_hashes(convs)
    # The smallest member stands for a path; ids are unique, so this join has no hot key.
    same = F.col("e.first") == F.col("c.conv_id")
    paths = ends.alias("e").join(convs.alias("c"), same).select("e.pid", "e.first", "e.n", "e.ends", "c.depth", "c.digests", "c.sizes")
    paths = stage(paths, "unique-paths")
    total = paths.agg(F.count("*").alias("n"), F.min("first").alias("first"), F.sum(F.col("depth") + 1).alias("turns")).first()

    prefix = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.struct(
        d.alias("at"), F.substring(F.col("digests"), (d - 1) * WIDTH + 1, F.lit(WIDTH)).alias("digest")))
    prefixes = paths.filter("depth > 0").select("pid", "first", F.explode(prefix).alias("x")).select("pid", "first", "x.*")
    hot = prefixes.groupBy("digest").agg(F.count("*").alias("paths"), F.min("first").alias("least")).filter(F.col("paths") > heavy).select("digest", "least")
    # Heavy prefixes of a path: the first ones from the root on, as many as meet the few heavy digests.
    above = prefixes.join(hot, "digest").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("at", "least"))).alias("above"))
    root = F.array(F.lit(total.first)) if total.n else F.array().cast("array<bigint>")
    with_heavy = paths.join(above, "pid", "left").withColumn("heavy", F.concat(root, F.coalesce(F.transform("above", lambda a: a.least), F.array().cast("array<bigint>"))))
    # A path belongs to the first light prefix, or to itself if it ends above it.
    top = F.when(F.col("depth") >= F.size("heavy"), F.substring(F.col("digests"), (F.size("heavy") - 1) * WIDTH + 1, F.lit(WIDTH))).otherwise(F.col("pid"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.turns or 0) // shard_turns))
    dealt = with_heavy.select(F.pmod(F.xxhash64(top), F.lit(shards)).alias("shard"), "first", "n", "ends", "depth", "digests", "sizes", "heavy")

    _shard_nodes.__annotations__ = {"paths": pa.Table, "return": pa.Table}
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = stage(dealt.groupBy("shard").applyInArrow(
        _shard_nodes, "digest binary, " + ", ".join(f"{c} bigint" for c in numbers) + ", ends string, heavy boolean"), "nodes")
    split = nodes.filter("heavy").groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in numbers[3:]], F.max("ends").alias("ends"),
    )
    # A root that is the only node has no child anywhere, so it is the only leaf.
    split = split.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("bigint")))
    found = nodes.filter("NOT heavy").select(split.columns).unionByName(split)
    return found.select(*numbers, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "digest")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
ORACLE_SQL = f"""
WITH said AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT *, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {OPENINGS} AS h FROM said),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM cut c LEFT JOIN said b ON b.conv_id = c.base),
prefix AS (
    SELECT conv_id, d, len(t) AS total, sha256(CAST(t[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(t[1:d - 1] AS VARCHAR)) END AS parent,
           CASE WHEN d > 0 THEN strlen(t[d].x) ELSE 0 END AS size FROM rebuilt, unnest(range(len(t) + 1)) AS u(d)),
nodes AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saves,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256
    FROM prefix GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT m.node AS lower, p.node AS upper FROM nodes m JOIN prefix q ON q.node = m.node AND q.conv_id = m.conv_id
          JOIN prefix p ON p.conv_id = q.conv_id AND p.d <= q.d),
sums AS (SELECT upper AS node, sum(saves) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
         FROM above JOIN nodes ON nodes.node = lower LEFT JOIN children c ON c.node = lower GROUP BY upper)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node
"""
