"""Repeated word windows across documents, found with count-min sketches and removed.

1. Documents are dealt into blocks by a hash of their row. Each block counts its windows in a
   count-min sketch of `DEPTH` rows, stored sparsely: sorted cells and whether they were hit twice.
   A document whose whole text also stands under a smaller doc_id adds nothing to that one's
   windows and loses all of them, so it is left out here: a group of copies counts once.
2. The sketches are merged by range of cells. A merged cell of 2 or more is estimated repeated;
   each block gets one bit back for each cell that it sent. The width of a row is a power of
   two of at least eight cells a window, so it grows with the corpus, and nothing is broadcast.
3. A block keeps the windows whose cells are repeated in all rows. An estimate is never too low, so
   no repeated window is lost. They are grouped exactly by 128 bits of hash: smallest doc_id.
4. Each block marks the words of its windows that start in a document with a smaller doc_id.

Rows: a null text has no words. A row without doc_id is kept whole and makes no other row lose
words. Rows that share a doc_id don't make each other lose words. Texts of any length are read
whole. Columns besides the id and the text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.session import stage

WINDOW, DEPTH, CELLS_PER_WINDOW = 13, 2, 8
#: Cells of a row of the sketch that are merged by one group, and text bytes in a block.
SEGMENT_BITS, BLOCK_BYTES = 24, 8 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # any odd number with well mixed bits does
MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
NO_ID = np.iinfo(np.int64).max


class WordHashes(dict):
    """Words to places in arrays of their hashes."""

    def __init__(self):
        self.high, self.low = [], []

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh3_128_intdigest(word)
        self.high.append(digest >> 64)
        self.low.append(digest & (1 << 64) - 1)
        self[word] = place = len(self.high) - 1
        return place


def text_hash(text: bytes) -> int:
    """Spark's xxhash64 of a binary column."""
    digest = xxhash.xxh64_intdigest(text, 42)
    return digest - (1 << 64) if digest >> 63 else digest


def rolled(words: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows, joined from hashes of windows of 1, 2, 4, ... words."""
    total, done, part, size, base = None, 0, words, 1, int(MULTIPLIER)
    while True:
        if window & size:
            # `part` covers `size` words and comes behind the `done` words joined so far.
            n = len(words) - done - size + 1
            total = part.copy() if total is None else total[:n] * np.uint64(base) + part[done: done + n]
            done += size
        if done == window:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(base) + part[size: size + n]
        size, base = 2 * size, base * base & (1 << 64) - 1
    total ^= total >> np.uint64(29)
    total *= MIXERS[0]
    return total ^ total >> np.uint64(32)


class Block:
    """Words and windows of some documents, document after document."""

    def __init__(self, table: pa.Table, window: int, copies: set[tuple[int, int]]):
        self.ids, texts = table.column("id"), [t or b"" for t in table.column("text").to_pylist()]
        ids = self.ids.to_pylist()
        self.words = [t.split() for t in texts]
        #: Rows without an id or with the text of a smaller one have no windows.
        self.copy = [i is not None and (i, text_hash(t)) in copies for i, t in zip(ids, texts, strict=True)]
        used = [[] if c or i is None else w for i, c, w in zip(ids, self.copy, self.words, strict=True)]
        sizes = np.fromiter(map(len, used), dtype=np.int64, count=len(used))
        self.ends = np.cumsum(sizes)
        seen = WordHashes()
        places = np.fromiter(map(seen.__getitem__, chain.from_iterable(used)), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        n = max(0, len(places) - window + 1)
        #: Windows start where the next words up to `window` belong to the same document.
        self.starts = np.flatnonzero(owner[:n] == owner[len(owner) - n:]) if n else np.zeros(0, np.int64)
        self.docs = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)[owner[self.starts]] if n else self.starts
        self.high, self.low = (
            rolled(np.array(x, dtype=np.uint64)[places], window)[self.starts] if n else np.zeros(0, np.uint64)
            for x in (seen.high, seen.low)
        )

    def cells(self, hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
        return (hashes * MIXERS[row % 2] + np.uint64(row)) * MULTIPLIER >> np.uint64(64 - bits)

    def sketch(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted cells, whether hit more than once by different documents or windows)."""
        cells = np.sort(self.cells(self.high, row, bits))
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        return cells[first], np.diff(np.concatenate((first, [len(cells)]))) > 1


def pack(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cells of a segment as differences; the lowest bit of each tells whether it was hit twice."""
    steps = np.diff(cells.astype(np.int64), prepend=0).astype(np.uint32) << np.uint32(1) | twice.astype(np.uint32)
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
    return np.cumsum(steps >> np.uint32(1)).astype(np.int64), (steps & np.uint32(1)).astype(np.uint8)


def _segments(cells: np.ndarray, low_bits: int):
    """(segment, its slice) of sorted cells."""
    high = cells >> np.uint64(low_bits)
    cut = np.flatnonzero(np.diff(high)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)], strict=True):
        if b > a:
            yield int(high[a]), slice(a, b)


def _blocks(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows (block, id, text) dealt by a hash of the row; rows (block, id, hash) whose whole text also stands
    under a smaller id; and the windows there can be at most."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.size(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+"))), F.lit(0)).alias("words"),
    ).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // BLOCK_BYTES))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "hash"), F.lit(n)).cast("int"))
    keys = rows.filter("id IS NOT NULL AND text IS NOT NULL").select(
        "block", "id", "hash", F.xxhash64(F.lit(1), "text").alias("more"), F.length("text").alias("length")
    )
    first = keys.groupBy("hash", "more", "length").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    # Written first, so that the join is one of two plain tables, whose hot texts Spark can split.
    first = stage(first.filter("most > least").drop("most"), "first-copies")
    copies = stage(keys.join(first, ["hash", "more", "length"]).filter("id > least").select("block", "id", "hash"), "copies")
    return rows.select("block", "id", "text").repartition(n, "block"), copies, max(size.words, 1)


def _copies(table: pa.Table) -> set[tuple[int, int]]:
    return set(zip(table.column("id").to_pylist(), table.column("hash").to_pylist(), strict=True))


def repeated_windows(blocks: DataFrame, copies: DataFrame, n_windows: int, window: int = WINDOW) -> DataFrame:
    """(block, high, low, least): windows of a block that also start in a document with a smaller id."""
    bits = max(SEGMENT_BITS, (CELLS_PER_WINDOW * n_windows - 1).bit_length())
    low_bits = SEGMENT_BITS

    def sketches(key: tuple[pa.Scalar, ...], known: pa.Table, table: pa.Table) -> pa.Table:
        block, out = Block(table, window, _copies(known)), []
        for row in range(DEPTH):
            cells, twice = block.sketch(row, bits)
            for segment, part in _segments(cells, low_bits):
                inside = cells[part] & np.uint64((1 << low_bits) - 1)
                out.append((key[0].as_py(), row, segment, pack(inside, twice[part])))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.binary())], names=["block", "row", "segment", "cells"])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total, parts = np.zeros(1 << low_bits, dtype=np.uint8), table.column("cells").to_pylist()
        for part in parts:
            cells, twice = unpack(part)
            total[cells] = np.minimum(total[cells] + 1 + twice, 2)  # cells are unique in a part
        answers = [zlib.compress(np.packbits(total[unpack(p)[0]] > 1).tobytes(), 1) for p in parts]
        return table.drop_columns(["cells"]).append_column("repeated", pa.array(answers, pa.binary()))

    def candidates(key: tuple[pa.Scalar, ...], side: pa.Table, table: pa.Table) -> pa.Table:
        answers, known = side.filter(pc.is_valid(side.column("row"))), side.filter(pc.is_null(side.column("row")))
        block = Block(table, window, _copies(known))
        keep = np.ones(len(block.starts), dtype=bool)
        rows = list(zip(*(answers.column(c).to_pylist() for c in ("row", "segment", "repeated")), strict=True))
        for row in range(DEPTH):
            cells, _ = block.sketch(row, bits)
            repeated = np.zeros(len(cells), dtype=bool)
            given = {segment: data for r, segment, data in rows if r == row}
            for segment, part in _segments(cells, low_bits):
                size = part.stop - part.start
                repeated[part] = np.unpackbits(np.frombuffer(zlib.decompress(given[segment]), np.uint8), count=size)
            left = np.flatnonzero(keep)
            keep[left] = repeated[np.searchsorted(cells, block.cells(block.high[left], row, bits))] if len(cells) else False
        # One row for each window of the block, with the smallest and the largest id it starts in.
        high, low, docs = block.high[keep], block.low[keep], block.docs[keep]
        order = np.lexsort((docs, low, high))
        high, low, docs = high[order], low[order], docs[order]
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(high)])) - 1 if len(first) else first
        return pa.table([pa.array(np.full(len(first), key[0].as_py(), np.int32)), pa.array(high[first].view(np.int64)),
                         pa.array(low[first].view(np.int64)), pa.array(docs[first]), pa.array(docs[last])],
                        names=["block", "high", "low", "least", "most"])

    sent = copies.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        sketches, "block int, row int, segment bigint, cells binary"
    )
    merged = sent.groupBy("row", "segment").applyInArrow(merge, "block int, row int, segment bigint, repeated binary")
    side = merged.unionByName(copies, allowMissingColumns=True)
    found = side.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        candidates, "block int, high bigint, low bigint, least bigint, most bigint"
    )
    # A window has at most one row for each block, so that no group is hot.
    whole = F.min("least").over(W.partitionBy("high", "low"))
    return found.withColumn("least", whole).filter("most > least").drop("most")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each row that no repeated window covers.

    A window counts as repeated in a document if its words also start in one with a smaller
    id. All windows are judged on the texts as given.
    """
    blocks, copies, n_windows = _blocks(docs, doc_id, text)

    def apply(key: tuple[pa.Scalar, ...], side: pa.Table, table: pa.Table) -> pa.Table:
        marks, known = side.filter(pc.is_valid(side.column("high"))), side.filter(pc.is_null(side.column("high")))
        block = Block(table, window, _copies(known))
        covered = np.zeros((int(block.ends[-1]) if len(block.ends) else 0) + 1, dtype=np.int32)
        if len(marks) and len(block.starts):
            high, low = (marks.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            least = marks.column("least").to_numpy()
            order = np.lexsort((low, high))
            high, low, least = high[order], low[order], least[order]
            hit = np.zeros(len(block.starts), dtype=bool)
            # Equal high halves with other low halves lie side by side: look at each of them.
            at = np.searchsorted(high, block.high)
            open_ = np.arange(len(at))
            while len(open_ := open_[at[open_] < len(high)]) and len(open_ := open_[high[at[open_]] == block.high[open_]]):
                place = at[open_]
                hit[open_] |= (low[place] == block.low[open_]) & (least[place] < block.docs[open_])
                at[open_] += 1
            covered[block.starts[hit]] += 1
            covered[block.starts[hit] + window] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        kept, removed, begin = [], [], 0
        for words, end, copy in zip(block.words, block.ends.tolist(), block.copy, strict=True):
            cut = gone[begin:end]
            begin = end
            if copy:
                removed.append(len(words) if len(words) >= window else 0)
                kept.append(b"" if removed[-1] else b" ".join(words))
                continue
            removed.append(int(cut.sum()))
            kept.append(b" ".join([w for w, g in zip(words, cut.tolist(), strict=True) if not g] if removed[-1] else words))
        return pa.table([block.ids.cast(pa.int64()), pa.array(list(map(len, block.words)), pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    marks = repeated_windows(blocks, copies, n_windows, window).unionByName(copies, allowMissingColumns=True)
    return marks.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        apply, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )


def op9_substring_countmin(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are compared by their words.
ORACLE_SQL = r"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), word AS (
    SELECT r, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
), windows AS (
    SELECT r, doc_id, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS x,
           count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
    FROM word
), hits AS (
    SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY x) AS hit FROM windows WHERE n = 13
), covered AS (
    SELECT r, i, coalesce(max(hit::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM word LEFT JOIN hits USING (r, i)
), kept AS (
    SELECT r, sum(gone)::bigint AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept
    FROM covered JOIN word USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
