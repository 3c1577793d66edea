"""Line dedup by a tree of line templates.

A line's tokens stand in a tree of fixed depth: token count, then the leading LEAD tokens; tokens with
a digit are variable fields there, `<*>`. In a leaf a line is its masked form, a variant.

- A variant recurs if enough documents have it: two if it has LONG tokens or LONG_CHARS characters, three from SHORT_CHARS
  characters on, RARE if it is shorter, as short lines are equal by chance.
- Lines of LONG tokens or more that do not recur so may have variable fields that no digit gives away. A token is fixed if the variants
  of its leaf have it at that place in at least `min_docs` documents (counted by variant); the other places are fields, at most a quarter of all. The
  sequence of fixed tokens and fields is the line's template, and the template recurs if at least `min_docs` documents have lines of it.

Recurring lines are dropped, except in the document with the smallest id of those that have the variant, or the
template. So of every line that is dropped, a line of its template stays, and a line that nothing is like
stays itself. Lines with more variable than fixed tokens by digits are compared as they are. No leaf is ever gathered: all steps are
grouped sums over hashes, and only variants of leaves with several are read again.

Rows: a null text stays null, an empty one empty; blank lines stay. Lines end with a newline. A row without
an id counts as a document and is nobody's first while rows with ids have the line. Rows equal
in id and text count as one document and are treated alike; rows that share only the id are several
documents, all of which are first. Other columns stay as they are, whatever their names are.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.rows import KEY, NO_ID, doc_key, id_of
from gatewright.session import stage

LEAD, LONG, MIN_DOCS = 3, 8, 3
#: Characters from which two, and three, documents make a variant recur; documents that shorter ones need.
LONG_CHARS, SHORT_CHARS, RARE = 40, 12, 10
DIGIT, FIELD = re.compile(rb"[0-9]"), b"<*>"
VARIANT = ["leaf", "a", "b"]


def masked(line: bytes) -> list[bytes]:
    """Tokens with those that hold a digit as variable fields, unless most do."""
    tokens = line.split()
    if DIGIT.search(line):
        fields = [FIELD if DIGIT.search(t) else t for t in tokens]
        if 2 * fields.count(FIELD) <= len(tokens):
            return fields
    return tokens


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def variant_of(tokens: list[bytes]) -> tuple[int, int, int]:
    """Hashes of the leaf and, in two halves, of the masked line."""
    whole = xxhash.xxh3_128_intdigest(b" ".join(tokens))
    leaf = xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:LEAD]))
    return signed(leaf), signed(whole >> 64), signed(whole & (1 << 64) - 1)


def line_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, leaf, a, b, n, chars, lines): each variant of each row, its tokens, characters and the numbers of its lines."""
    source = docs.select(*doc_key(F.col(doc_id), F.col(text)), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, th, value in zip(*batch.columns, strict=True):
                found: dict[tuple, list[int]] = {}
                for number, line in enumerate((value.as_py() or b"").split(b"\n")):
                    tokens = masked(line)
                    if tokens:
                        chars = len(b" ".join(tokens).decode("utf-8", "replace"))
                        found.setdefault((*variant_of(tokens), len(tokens), chars), []).append(number)
                out += [(key.as_py(), th.as_py(), *v, lines) for v, lines in found.items()]
                if len(out) > 20_000:
                    yield to_batch(out)
                    out = []
            if out:
                yield to_batch(out)

    types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.list_(pa.int32())]
    names = [*KEY, *VARIANT, "n", "chars", "lines"]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return source.mapInArrow(run, "id bigint, th bigint, leaf bigint, a bigint, b bigint, n int, chars int, lines array<int>")


def _tokens(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(leaf, a, b, n, docs, pos, token): tokens of one line for each variant in `wanted`."""
    rep = F.min(F.struct(*KEY, F.col("lines")[0].alias("line"))).alias("rep")
    lists = wanted.groupBy(*VARIANT, "n", "docs").agg(rep).groupBy("rep.id", "rep.th").agg(
        F.collect_list(F.struct(*VARIANT, "n", "docs", "rep.line")).alias("want"))
    lists = stage(lists, "wanted-lines")
    source = docs.select(*doc_key(F.col(doc_id), F.col(text)), F.col(text).cast("binary").alias("text")).join(lists, KEY).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, want in zip(*batch.columns, strict=True):
                lines = value.as_py().split(b"\n")
                for w in want.as_py():
                    tokens = [signed(xxhash.xxh3_64_intdigest(t)) for t in masked(lines[w["line"]])]
                    same = [np.full(len(tokens), w[c]) for c in (*VARIANT, "n", "docs")]
                    yield pa.record_batch([*(pa.array(x, pa.int64()) for x in same), pa.array(range(len(tokens)), pa.int64()), pa.array(tokens, pa.int64())],
                                          names=[*VARIANT, "n", "docs", "pos", "token"])

    return source.mapInArrow(run, "leaf bigint, a bigint, b bigint, n bigint, docs bigint, pos bigint, token bigint")


def recurring(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(leaf, a, b, keep): recurring variants and the id whose rows keep them."""
    variants = stage(lines.groupBy(*VARIANT, "n", "chars").agg(
        F.count_distinct(*KEY).alias("docs"), F.min(id_of(F.col("id"))).alias("first")), "variants")
    long = (F.col("n") >= LONG) | (F.col("chars") >= LONG_CHARS)
    needed = F.when(long, 2).when(F.col("chars") >= SHORT_CHARS, min_docs).otherwise(RARE)
    exact = variants.filter(F.col("docs") >= needed).select(*VARIANT, F.col("first").alias("keep"))

    leaves = variants.filter(F.col("n") >= LONG).groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("docs").alias("all"))
    leaves = stage(leaves.filter((F.col("variants") > 1) & (F.col("all") >= min_docs)).select("leaf"), "leaves")
    inside = variants.filter(F.col("n") >= LONG).join(leaves, "leaf").select(*VARIANT, "docs")
    tokens = stage(_tokens(docs, lines.join(stage(inside, "leaf-variants"), VARIANT), doc_id, text), "tokens")
    shared = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs).drop("all")
    fixed = tokens.filter(F.col("docs") < min_docs).join(shared, ["leaf", "pos", "token"])
    at = F.sort_array(F.collect_list(F.struct("pos", "token")))
    formed = fixed.groupBy(*VARIANT, "n").agg(at.alias("at")).filter(F.size("at") >= F.col("n") - F.floor(F.col("n") / 4))
    formed = stage(formed.select(*VARIANT, F.xxhash64("leaf", "at").alias("t1"), F.xxhash64("at", F.lit(1), "n").alias("t2")), "templates")
    # Documents are counted by template: one with several of its variants is one document.
    templates = lines.join(formed, VARIANT).groupBy("leaf", "t1", "t2").agg(
        F.count_distinct(*KEY).alias("docs"), F.min(id_of(F.col("id"))).alias("keep")).filter(F.col("docs") >= min_docs).drop("docs")
    loose = stage(formed.join(templates, ["leaf", "t1", "t2"]).select(*VARIANT, F.lit(True).alias("loose"), F.col("keep").alias("kept")), "loose")
    # A template's keeper goes before a variant's: it has the smallest id of all that have a line of it.
    both = exact.join(loose, VARIANT, "full").select(*VARIANT, F.when(F.col("loose"), F.col("kept")).otherwise(F.col("keep")).alias("keep"))
    return both.withColumn("keep", F.coalesce("keep", F.lit(NO_ID)))


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` without recurring lines; with `count`, a column of that name tells how many each row lost."""
    lines = stage(line_variants(docs, doc_id, text), "line-variants")
    marked = lines.join(stage(recurring(docs, lines, min_docs, doc_id, text), "recurring"), VARIANT).filter("id <> keep")
    gone = stage(marked.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone")), "gone")
    # The row is one column, so that no name of its own can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(F.col(doc_id), F.col(text))).join(gone, KEY, "left")
    rows = rows.withColumn("parts", F.split(F.col("row")[text], "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(F.col("parts"), i + 1)), "\n")
    out = [
        (F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("row")[c]) if c == text else F.col("row")[c]).alias(c)
        for c in docs.columns if c != count
    ]
    return rows.select(*out, *([F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(count)] if count else []))


def op4_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_templates(docs, count="n_dropped").select("doc_id", "n_dropped", "text")
