"""Nearest neighbours by inner product through cross-polytope hashing.

Vectors on the unit sphere are turned by pseudo-rotations (three rounds of random signs and a fast
Hadamard transform); a table's bucket is the signed axis nearest to the turned vector. A query looks
into the buckets of its nearest PROBES axes of each of TABLES tables, scores all vectors there and
keeps its best. If lengths differ, vectors get one more component that puts them on one sphere, and
queries a zero there, so that the nearest direction is the largest inner product.

Buckets are counted first (their number is bounded: tables times axes), then those with many
vectors or many queries are cut into groups of about GROUP_ROWS vectors by QUERY_ROWS queries, so
that a very common vector makes more groups, not a larger one. No vector is left out of a bucket.

Rows: vectors that are null, zero, of another length than the most common one, or that hold null
or non-finite components take no part, nor do rows without an id. Several rows of one id are one
candidate, by the better score, and one query, by the least vector. Scores sum products in double
precision from the first component on, so equal vectors have equal scores. Other columns are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.session import stage

TABLES, PROBES, ROUNDS, SEED = 10, 16, 3, 7
GROUP_ROWS, QUERY_ROWS = 512, 1_024
#: Relative difference of lengths up to which vectors count as equally long.
EQUAL = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the number of columns is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class Tables:
    """Pseudo-rotations for vectors of `size` components."""

    def __init__(self, size: int, longest: float, augment: bool, tables: int = TABLES):
        self.size, self.longest, self.augment = size, longest, augment
        self.width = 1 << max(0, size + augment - 1).bit_length()
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, ROUNDS, self.width))

    def turned(self, x: np.ndarray, queries: bool) -> Iterator[np.ndarray]:
        """For each table the closeness of each vector to each signed axis."""
        flat = np.zeros((len(x), self.width))
        lengths = np.linalg.norm(x, axis=1, keepdims=True)
        flat[:, : self.size] = x / (lengths if queries or not self.augment else self.longest)
        if self.augment and not queries:
            flat[:, self.size] = np.sqrt(np.maximum(0.0, 1 - (lengths[:, 0] / self.longest) ** 2))
        for signs in self.signs:
            y = flat
            for one in signs:
                y = hadamard(y * one)
            yield np.concatenate((y, -y), axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table, numbered over all tables."""
        return np.stack([y.argmax(1) + t * 2 * self.width for t, y in enumerate(self.turned(x, False))], axis=1)

    def probes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each query looks into."""
        probes = min(probes, 2 * self.width)
        found = [np.argpartition(-y, probes - 1, axis=1)[:, :probes] + t * 2 * self.width for t, y in enumerate(self.turned(x, True))]
        return np.concatenate(found, axis=1)


def valid_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): vectors of doubles that take part."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("v") == (size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component on, whatever the shapes are."""
    out = np.zeros((len(queries), len(vectors)))
    for j in range(queries.shape[1]):
        out += queries[:, j: j + 1] * vectors[:, j]
    return out


def search(table: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           tables: int = TABLES, probes: int = PROBES, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k found for the rows whose id satisfies `is_query`.

    A query's own id is no candidate. With every bucket probed the result is exact.
    """
    rows = stage(valid_vectors(table, vec_id, vector), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    shape = rows.agg(F.max(F.size("v")).alias("size"), F.min(length).alias("least"), F.max(length).alias("most")).first()
    turn = Tables(shape["size"] or 1, shape.most or 1.0, bool(shape["size"]) and shape.most - shape.least > EQUAL * shape.most, tables)
    asked = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n_buckets = tables * 2 * turn.width

    def counted(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_buckets, dtype=np.int64)
            for batch in batches:
                total += np.bincount(find(_matrix(batch.column(0))).ravel(), minlength=n_buckets)
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
        return run

    def sizes(source: DataFrame, find, most: int) -> np.ndarray:
        """Groups that each bucket is cut into."""
        got = source.select("v").mapInArrow(counted(find), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        out = np.ones(n_buckets, dtype=np.int64)
        for r in got:
            out[r.bucket] = -(-r.n // most)
        return out

    look = lambda x: turn.probes(x, probes)
    parts, query_parts = sizes(rows, turn.buckets, group_rows), sizes(asked, look, query_rows)

    def dealt(find, own: np.ndarray, other: np.ndarray):
        """A row for each bucket of a vector: in one group of its own side, in all of the other side."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    buckets = find(_matrix(part.column(1)))
                    ids = part.column(0).to_numpy()
                    row = np.repeat(np.arange(len(part)), buckets.shape[1])
                    bucket = buckets.ravel()
                    mixed = ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    mine = (mixed % own[bucket].astype(np.uint64)).astype(np.int32)
                    times = other[bucket]
                    again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, bucket, mine = (np.repeat(x, times) for x in (row, bucket, mine))
                    yield pa.record_batch([pa.array(bucket), pa.array(mine), pa.array(again.astype(np.int32)),
                                           *(c.take(pa.array(row)) for c in part.columns)], names=["bucket", "mine", "other", "id", "v"])
        return run

    out = "bucket bigint, mine int, other int, id bigint, v array<double>"
    data = rows.mapInArrow(dealt(turn.buckets, parts, query_parts), out)
    data = data.withColumnsRenamed({"mine": "part", "other": "query_part"})
    query = asked.mapInArrow(dealt(look, query_parts, parts), out).withColumnsRenamed({"mine": "query_part", "other": "part"})

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        query_ids, ids = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
        q, x = _matrix(queries.column("v")), _matrix(vectors.column("v"))
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(q) if len(x) else 0, 64):
            near = scores(q[at: at + 64], x)
            near[query_ids[at: at + 64, None] == ids] = -np.inf
            for i, row in enumerate(near):
                top = np.arange(len(row))
                if len(row) > k:
                    top = np.flatnonzero(row >= np.partition(row, -k)[-k])
                top = top[row[top] > -np.inf]
                top = top[np.lexsort((ids[top], -row[top]))][:k]
                found.append((np.full(len(top), query_ids[at + i]), ids[top], row[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    best.__annotations__ = {"queries": pa.Table, "vectors": pa.Table, "return": pa.Table}
    keys = ["bucket", "part", "query_part"]
    found = query.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(best, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op7_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 20 == 0)
