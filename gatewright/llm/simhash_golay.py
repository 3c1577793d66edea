"""SimHash near-duplicates: fingerprints linked through fuzzy keys of the Golay code.

A 64-bit fingerprint is cut into three words of the code (23, 23 and 18 bits). If two
fingerprints differ in at most 3 bits, at least two of the three words differ in at most one
bit each, so for one of the three pairs of words they share a pair of fuzzy keys. Keys are
24 bits of codeword indices; all fingerprints with a key meet, and bits are counted exactly.

Keys are counted first, and those of more than GROUP fingerprints are split. The third word of two
linked fingerprints differs in at most 3 bits, so one of its four pieces is equal in both: they meet by
(key, piece). What is still too large is dealt into blocks, and each pair of blocks meets in a group of its own.

Rows: a null text has no words; fewer words than a shingle are one shingle; no words give
fingerprint zero, linked like any other. Repeated rows each get their row. A row without a
doc_id takes part, but can't name a component; a component without any id has null.
`near_duplicates` doesn't read other columns, `keep_one` returns all columns, of any names; there the smallest id
stays, rows without one stand behind those with one, and of rows equal in id and text one stays.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm import golay
from gatewright.llm.components import components
from gatewright.llm.rows import KEY, NO_ID, doc_key, without
from gatewright.session import stage

SEED, BITS, CHUNK = 42, 64, 200_000
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: (first bit, bits) of the words of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Differing bits up to which the keys find every pair.
LINK_BITS = 3
#: Groups up to this size compare all members at once, larger ones spread from member to member.
SMALL = 12
#: Fingerprints of a key beyond which the key is split.
GROUP = 1 << 14
#: Pieces of the word that a key leaves out: one more than the bits that may differ in it.
PIECES = LINK_BITS + 1


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a UTF-8 text, repeats included, in arrays of up to CHUNK."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def majority(parts: Iterator[np.ndarray]) -> int:
    """Signed 64-bit number whose bits are those that over half the hashes have."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        values = hashes.view(np.uint8)
        for k in range(8):  # count byte values, then the bits in them
            ones[8 * k: 8 * k + 8] += np.bincount(values[k::8], minlength=256) @ BITS_OF_BYTE
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of `docs` and `fp`, in the tasks that read the texts."""
    source = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            found = pa.array([fingerprint(x.as_py(), shingle) for x in column], pa.int64())
            yield batch.drop_columns(["__text"]).append_column("fp", found)

    return source.mapInArrow(run, schema)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) arrays: every pair of words times every pair of their codeword indices."""
    plain = fps.view(np.uint64)
    words = [golay.keys((plain >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    keys, owners = [], []
    for number, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        left, right = words[i][:, :, None], words[j][:, None, :]
        both = np.where((left >= 0) & (right >= 0), (left << 12 | right) + (number << 24), -1).reshape(len(fps), -1)
        row, _ = np.nonzero(both >= 0)
        keys.append(both[both >= 0])
        owners.append(fps[row])
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 20_000):
            key, fp = fuzzy_keys(fps[at: at + 20_000].copy())
            yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(fp)], names=["key", "fp"])


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within a group: fewer of them than members."""
    left = fps.view(np.uint64).copy()
    us, vs = [], []
    while len(left):
        queue, left = [left[-1]], left[:-1]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                us.append(np.full(len(found), one))
                vs.append(found)
                queue.extend(found)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def group_links(key: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group of equal, sorted keys."""
    edges = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    us, vs = [], []
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        u, v = spanning_links(fps[at: at + size], bits)
        us.append(u)
        vs.append(v)
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    key, plain = key[small], fps[small].view(np.uint64)
    for lag in range(1, SMALL):
        if lag >= len(key):
            break
        one, two = plain[:-lag], plain[lag:]
        near = (key[:-lag] == key[lag:]) & (np.bitwise_count(one ^ two) <= bits)
        us.append(one[near].view(np.int64))
        vs.append(two[near].view(np.int64))
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _met(keyed: DataFrame, bits: int) -> DataFrame:
    """(u, v) links within the groups of (key, fp), sorted by key, so that a task holds one group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fps):
            u, v = group_links(key, fps, bits)
            return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if parts[-1][0][0] == parts[-1][0][-1] and parts[0][0].size and parts[0][0][-1] == parts[-1][0][-1]:
                continue  # still inside one group
            key = np.concatenate([p[0] for p in parts])
            fps = np.concatenate([p[1] for p in parts])
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield out(key[:whole], fps[:whole])
            parts = [(key[whole:], fps[whole:])]
        key = np.concatenate([p[0] for p in parts])
        if len(key):
            yield out(key, np.concatenate([p[1] for p in parts]))

    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")


def _large(keyed: DataFrame, group: int) -> DataFrame:
    """(key, n) of the keys with more than `group` rows; rows are added up before they are shuffled."""
    return stage(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group), "large-keys")


def by_pieces(keyed: DataFrame) -> DataFrame:
    """(key, fp) with a new key for each piece of the word that is not in the old key.

    Keys are hashes: if two fall together, their fingerprints are compared needlessly, and none is lost.
    """
    def piece(word: int, number: int):
        at, n = SEGMENTS[word]
        first, last = (at + n * k // PIECES for k in (number, number + 1))
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << last - first) - 1))

    left_out = [({0, 1, 2} - set(pair)).pop() for pair in combinations(range(len(SEGMENTS)), 2)]
    which = F.shiftright("key", 24)
    value = lambda k: F.when(which == 0, piece(left_out[0], k)).when(which == 1, piece(left_out[1], k)).otherwise(piece(left_out[2], k))
    keys = F.array(*[F.xxhash64("key", F.lit(k), value(k)) for k in range(PIECES)])
    return keyed.select(F.explode(keys).alias("key"), "fp")


def by_blocks(keyed: DataFrame, large: DataFrame, group: int) -> DataFrame:
    """(key, fp) of the keys in `large`, dealt into blocks of about `group` rows, with a new key for each pair of blocks."""
    blocks = F.ceil(F.col("n") / F.lit(group)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = keyed.join(large, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def links(distinct: DataFrame, bits: int = LINK_BITS, group: int = GROUP) -> DataFrame:
    """(u, v) links that connect all fingerprints with at most `bits` differing bits.

    `distinct` has one row for each value of fp. A group of copies is one fingerprint here, a
    group of near copies gives fewer links than it has members, and no group holds
    many more than 2 * `group` fingerprints of 8 bytes.
    """
    if bits > LINK_BITS:
        raise ValueError(f"the keys find all pairs up to {LINK_BITS} bits")
    keyed = distinct.select("fp").mapInArrow(_key_rows, "key int, fp bigint")
    large = _large(keyed, group)
    if large.isEmpty():
        return _met(keyed, bits).distinct()
    found = _met(keyed.join(large, "key", "left_anti"), bits)
    finer = stage(by_pieces(keyed.join(large, "key", "left_semi")), "pieces")
    larger = _large(finer, group)
    found = found.unionByName(_met(finer.join(larger, "key", "left_anti"), bits))
    return found.unionByName(_met(by_blocks(finer, larger, group), bits)).distinct()


def rooted(distinct: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """`distinct`, a row for each fp, with the `root` that all fingerprints reachable by links share."""
    roots = components(links(distinct, bits))
    linked = distinct.join(roots, distinct.fp == roots.node, "left")
    return stage(linked.select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = LINK_BITS, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable by links."""
    marked = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle), "simhash")
    named = rooted(stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints"), bits)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = LINK_BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, with all its columns.

    Only keys and fingerprints are grouped; texts meet the keys of the rows that go, once.
    """
    source = docs.select(*doc_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    marked = stage(fingerprints(source, shingle, keep=tuple(KEY)), "simhash")
    place = F.struct((F.col("id") == NO_ID).cast("int").alias("last"), "id", "th")  # rows without an id come last
    named = rooted(stage(marked.groupBy("fp").agg(F.min(place).alias("least")), "fingerprints"), bits)
    best = named.groupBy("root").agg(F.min("least").alias("best")).select("best.id", "best.th")
    best = stage(best.withColumn("stays", F.lit(True)), "kept")
    times = marked.groupBy(*KEY).agg(F.count("*").alias("n")).join(best, KEY, "left")
    # Rows whose key is there once and stays need not be touched; of those there several times one comes back.
    moved = stage(times.filter("stays IS NULL OR n > 1").select(*KEY, F.coalesce("stays", F.lit(False)).alias("stays")), "moved")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(F.col(doc_id), F.col(text)))
    again = rows.join(moved.filter("stays").select(*KEY), KEY, "left_semi").dropDuplicates(KEY)
    return without(docs, moved, doc_id, text).unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op10_simhash_golay(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
