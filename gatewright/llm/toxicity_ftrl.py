"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Features are the set of hashed words, neighbouring pairs and pairs with one word between them. For
inflected languages stems (the first letters of longer words) count too, at up to STEM_LEVELS
features for a stem, one for each time it is met.
At most TRAIN_ROWS labelled rows, those with the smallest hash of their id, are learned from, in
shards of SHARD_ROWS: each shard runs FTRL-proximal with a learning rate per coordinate and L1,
and the weights of the shards are averaged. L1 leaves few weights other than zero; the model is
bounded by the hash space and goes to the tasks with the scoring function. All whole texts are scored.

Rows: null and empty texts have no features and get the score of the bias. Repeated rows each get
their score. Labels that are null are not used; of several for one id the largest counts. Without
any usable label the score is 1/3. Ids, sources, languages and labels are never features, and
other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import stage

#: Bits of the hash space; bound of the labelled sample; rows of a shard; passes over a shard.
SPACE_BITS, TRAIN_ROWS, SHARD_ROWS, PASSES = 20, 16_384, 2_048, 8
#: Learning rate and its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
WORD = re.compile(r"[^\W\d_]+")
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers that tell pairs apart
KNOWN_WORDS = 500_000
#: Letters of stems, and what lies between the places of a stem's levels.
STEMS, STEM_LEVELS, LEVEL_STEP = (5, 7), 4, 7_919


class Words(dict):
    """Words to rows of `hashes`: the word and its stems; 0 stands for no stem."""

    def __init__(self):
        self.hashes = np.zeros((1 << 12, 1 + len(STEMS)), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        parts = [word] + [word[:n] + "*" if len(word) > n else "" for n in STEMS]
        self.hashes[row] = [xxhash.xxh3_64_intdigest(p) if p else 0 for p in parts]
        self[word] = row
        return row

    def rows(self, text: str | None) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        words = WORD.findall((text or "").lower())
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.hashes[rows]


def feature_places(text: str | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places in the hash space, with repeats: of words and pairs, and of stems."""
    rows, shift = known.rows(text), np.uint64(64 - SPACE_BITS)
    h, stems = rows[:, 0], rows[:, 1:].ravel()
    parts = [h * PAIR >> shift]
    for lag, mult in ((1, PAIR), (2, SKIP)):
        if len(h) > lag:
            parts.append(((h[:-lag] * mult) ^ (h[lag:] >> np.uint64(lag))) * PAIR >> shift)
    return np.concatenate(parts).astype(np.int64), (stems[stems != 0] * PAIR >> shift).astype(np.int64)


def features(once: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """The set of places of a text: each of `once`, and of a stem met k times its first k levels."""
    stem, times = np.unique(stems, return_counts=True)
    levels = [(stem[times > k] + k * LEVEL_STEP) & (1 << SPACE_BITS) - 1 for k in range(STEM_LEVELS)]
    return np.unique(np.concatenate([once, *levels]))


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> Model:
    """FTRL-proximal over (features, label) rows in order. The bias has no L1."""
    size = 1 << SPACE_BITS
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(y for _, y in rows)
    start = math.log((ones + 1) / (len(rows) - ones + 2))
    bias_z = bias_n = 0.0
    for _ in range(passes):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
            bias = start - bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - y
            z[x] += g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] += g * g
            moved = bias - start
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * moved
            bias_n += g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    places = np.flatnonzero(w)
    return Model(places, w[places], start - bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA))


def labelled_sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, y) of at most `rows` labelled ids, in order of a hash of the id."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the texts of `docs` and the labels given."""
    sample = stage(labelled_sample(labels, doc_id, label), "sample")
    n = sample.count()
    shards = max(1, -(-n // SHARD_ROWS))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [features(*feature_places(t.as_py(), known)).astype(np.int32) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "x"])

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        model = train([(x.values.to_numpy(), y.as_py()) for x, y in zip(table.column("x"), table.column("y"), strict=True)])
        places = np.concatenate(([-1], model.places))
        return pa.table([pa.array(places, pa.int64()), pa.array(np.concatenate(([model.bias], model.weights)))], names=["place", "w"])

    shard.__annotations__ = {"table": pa.Table, "return": pa.Table}
    found = rows.mapInArrow(featured, "id bigint, y int, x array<int>").withColumn("order", F.xxhash64("id"))
    found = found.groupBy(F.pmod("order", F.lit(shards)).alias("shard")).applyInArrow(shard, "place bigint, w double")
    total = found.groupBy("place").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    trained = int(total.loc[total.place == -1, "n"].sum())
    if not trained:
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(1 / 2))
    total = total.sort_values("place")
    rest = total[total.place >= 0]
    bias = float(total.loc[total.place == -1, "w"].iloc[0]) / trained
    return Model(rest.place.to_numpy(), rest.w.to_numpy() / trained, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out` in place of the text: the chance of label 1."""
    source = docs.withColumn(text, F.col(text).cast("string"))
    schema = source.drop(text, out).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros(1 << SPACE_BITS), Words()
        table[model.places] = model.weights
        weighs = table != 0
        stem_weighs = np.any([np.roll(weighs, -k * LEVEL_STEP) for k in range(STEM_LEVELS)], axis=0)
        for batch in batches:
            scores = []
            for value in batch.column(batch.schema.get_field_index(text)):
                once, stems = feature_places(value.as_py(), known)
                used = features(once[weighs[once]], stems[stem_weighs[stems]])
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, model.bias + table[used].sum())))))
            rest = batch.drop_columns([c for c in (text, out) if c in batch.schema.names])
            yield rest.append_column(out, pa.array(scores, pa.float64()))

    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op3_toxicity_ftrl(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
