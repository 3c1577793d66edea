"""The corpus pipeline: documents through filters and deduplication to packed training sequences.

Each stage takes what its predecessor kept, as written and read again, and returns the columns of
documents; the last returns where each piece of text goes. What a stage does with nulls, empty
and repeated rows, empty tables and other columns is said in the module of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.best_fit import pack
from gatewright.llm.language_fusion import keep_identified
from gatewright.llm.line_templates import drop_templates
from gatewright.llm.positional_index import drop_contaminated
from gatewright.llm.simhash_golay import keep_one
from gatewright.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts of none, or without letters, go."""
    return keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur across documents."""
    found = drop_templates(docs)
    if "n_chars" in found.columns:
        found = found.withColumn("n_chars", F.length("text").cast(found.schema["n_chars"].dataType))
    return found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: three words a shingle, links at up to three bits."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints and trained likelihoods have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
