"""Conflict-constrained best-fit packing of documents into training sequences.

Documents longer than a sequence are cut into pieces of its length and a rest. Pieces are dealt to
shards of about SHARD_PIECES rows by a hash, and each shard packs its own bins: pieces from the
longest on, each into the tightest bin that has room and holds no piece of the same source and none
of the same duplicate cluster (equal texts). Bins are ordered by what room they have left. Each
carries a bitmap of sources and one of clusters; the search goes on from the tightest bin to its
successors until one is compatible, or a new bin is opened.

Full pieces need no search and make a bin each, next to the shards. Only lengths, sources and
hashes of texts are shuffled. The number of shards follows the number of pieces, so a task holds
about the same at any size, and a hot source is spread over all shards.

Rows: a null text or one without words has length 0 and no bin. A null source conflicts with
nothing; equal texts conflict in any case. Repeated rows are packed as often as they are there and
never into one bin; they are counted before they are dealt, so that they spread too. Ties go to the
smaller id, no id last, then to the hash of the text; among bins with equal room to the older one.
A row without an id is packed too. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import stage

CAPACITY, SHARD_PIECES = 2_048, 4_096
#: Fixed value: what a word is.
WORDS = r"[^\x20\x09-\x0D]++"


class Bins:
    """Open bins by room left; those with equal room and equal bitmaps of sources stand together."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # sorted, each once
        self.at: dict[int, list[int]] = {}  # room: sorted bins
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin for a piece; `source` and `cluster` are bitmaps with one bit or none."""
        found = self._find(length, source, cluster)
        if found is None:
            found = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._leave(found)
        self.left[found] -= length
        self.sources[found] |= source
        self.clusters[found] |= cluster
        if self.left[found]:
            self._enter(found)
        return found

    def _find(self, length: int, source: int, cluster: int) -> int | None:
        for k in range(bisect_left(self.rooms, length), len(self.rooms)):
            for one in self.at[self.rooms[k]]:
                if not (self.sources[one] & source or self.clusters[one] & cluster):
                    return one
        return None

    def _leave(self, one: int) -> None:
        room = self.left[one]
        bins = self.at[room]
        bins.remove(one)
        if not bins:
            del self.at[room]
            self.rooms.pop(bisect_left(self.rooms, room))

    def _enter(self, one: int) -> None:
        room = self.left[one]
        if room in self.at:
            insort(self.at[room], one)
        else:
            self.at[room] = [one]
            insort(self.rooms, room)


def pack_shard(pieces: list[tuple[int, str | None, int]], capacity: int) -> list[int]:
    """Bins for (length, source, cluster) pieces in the order given."""
    bins, sources, clusters = Bins(capacity), {}, {}
    return [
        bins.place(length, 0 if source is None else 1 << sources.setdefault(source, len(sources)),
                   1 << clusters.setdefault(cluster, len(clusters)))
        for length, source, cluster in pieces
    ]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, cluster, more, piece, n_words, copy): full pieces of long texts and the rest, of length 0 too.

    `copy` counts equal rows from 1.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.xxhash64(text).alias("cluster"), F.xxhash64(F.lit(1), text).alias("more"), words.alias("all"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    last = F.greatest(F.ceil(F.col("all") / capacity) - 1, F.lit(0)).cast("int")
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "n_words", F.least(F.col("all") - F.col("piece") * capacity, F.lit(capacity)).cast("int")).drop("all")


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, n_words, shard, bin, place): where each piece of each row goes.

    `place` counts the pieces of a bin from 0. A full piece has the shard -1, a number in it by
    its document, and place 0. Pieces of length 0 have neither shard, bin nor place.
    """
    rows = stage(pieces_of(docs, capacity, doc_id, text, source), "pieces")
    n = rows.filter(F.col("n_words").between(1, capacity - 1)).count()
    shards = max(1, -(-n // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[
            ("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("more", "ascending"), ("source", "ascending")])
        table = table.take(order)
        clusters = list(zip(table.column("cluster").to_pylist(), table.column("more").to_pylist(), strict=True))
        bins = pack_shard(list(zip(table.column("n_words").to_pylist(), table.column("source").to_pylist(), clusters, strict=True)), capacity)
        count: dict[int, int] = {}
        places = []
        for one in bins:
            places.append(count.get(one, 0))
            count[one] = places[-1] + 1
        return table.select(["doc_id", "piece", "n_words", "shard"]).append_column("bin", pa.array(bins, pa.int64())).append_column(
            "place", pa.array(places, pa.int32()))

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(shards)).cast("int")
    out = "doc_id bigint, piece int, n_words int, shard int, bin bigint, place int"
    packed = rows.filter(F.col("n_words").between(1, capacity - 1)).withColumn("shard", shard).groupBy("shard").applyInArrow(run, out)
    null = F.lit(None).cast("int")
    full = F.col("n_words") == capacity
    rest = rows.filter(full | (F.col("n_words") == 0)).select(
        "doc_id", "piece", "n_words", F.when(full, F.lit(-1)).otherwise(null).alias("shard"),
        F.when(full, F.xxhash64("doc_id", "piece", "cluster", "copy")).alias("bin"), F.when(full, F.lit(0)).otherwise(null).alias("place"))
    return packed.unionByName(rest)


def op1_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
