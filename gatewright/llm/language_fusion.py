"""Language identification that fuses evidence by Bayes' rule.

- Text: likelihood of hashed letter trigrams in each language, counted on a bounded sample of
  labelled texts (about SAMPLE texts a language, by a hash of the text). Every label that occurs has
  its model, kept sparse: only trigrams that were seen in it. A class UND, which finds all
  trigrams equally likely, stands for what is in none of the languages.
- Markup and address: how often a declared language or an address suffix goes with each language.
- Host: a prior smoothed over its site, and that over all rows, without the row's own part.

The last two are grouped sums of what the texts say, over all rows; they count little where there
is much text. Tables of counts are keyed by host, suffix or declared code and joined, so they may
grow; a hot host is summed before the shuffle and its join can be split.

Rows: a null or empty text, or one without letters, has no text evidence and is UND with chance 1.
Null hosts, suffixes and declarations are no evidence. Repeated rows each count. A label that is
null is not learned from; without labels all is UND. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.rows import KEY, doc_key, id_of, without
from gatewright.session import inline_table, stage

UND, SAMPLE = "und", 2_000
PLACES = 1 << 16
#: Trigrams whose evidence counts in full, as neighbouring trigrams are not independent.
FULL = 60.0
#: Rows that the wider level counts for: all rows within a site, a site within a host; of a code within its language.
SITE_ROWS, HOST_ROWS, CODE_ROWS = 20.0, 10.0, 5.0
LEAST_CHANCE = 0.5
SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
TAG = re.compile(r"<(/?)(script|style)?[^<>]*>", re.I)


def strip_markup(text: str) -> str:
    """Text between tags, without scripts and styles, in one pass."""
    out, at, hidden = [], 0, None
    for tag in TAG.finditer(text):
        if not hidden:
            out.append(text[at:tag.start()])
        name = (tag[2] or "").lower()
        if hidden:
            hidden = None if tag[1] and name == hidden else hidden
        elif name and not tag[1]:
            hidden = name
        at = tag.end()
    if not hidden:
        out.append(text[at:])
    return html.unescape(" ".join(out))


def trigrams(text: str | None, markup: bool = False) -> np.ndarray:
    """Places of the letter trigrams of a text; at most one blank stands between words."""
    if not text:
        return np.zeros(0, np.int64)
    plain = (strip_markup(text) if markup else text).lower().encode("utf-8", "replace").translate(SPACE)
    b = np.frombuffer(b" " + b" ".join(plain.split()) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Languages, the last of them UND, and log likelihoods by place and language.

    `unseen` has one of each language for places it never had; from `starts[place]` on stand the
    languages in `seen` that had the place, and what they add to it in `more`.
    """

    languages: list[str]
    unseen: np.ndarray
    starts: np.ndarray
    seen: np.ndarray
    more: np.ndarray

    def evidence(self, text: str | None, markup: bool) -> list[float] | None:
        places = trigrams(text, markup)
        if not len(places):
            return None
        used, times = np.unique(places, return_counts=True)
        sizes = self.starts[used + 1] - self.starts[used]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[used] - np.cumsum(sizes) + sizes, sizes)
        total = self.unseen * len(places) + np.bincount(self.seen[at], self.more[at] * np.repeat(times, sizes), len(self.languages))
        total *= min(1.0, FULL / len(places))
        return (total - total.max()).tolist()


def fit_text(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Counts from about `sample` texts of each label."""
    known = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    sizes = known.groupBy("label").count().collect()
    languages = sorted(r.label for r in sizes)
    number = {name: i for i, name in enumerate(languages)}
    if languages:
        cut = inline_table(docs.sparkSession, [(r.label, int(sample / r["count"] * 1_000_000)) for r in sizes], "label string, cut bigint")
        known = known.join(cut, "label").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("cut")).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[int, np.ndarray] = {}
            for value, name in zip(batch.column(0), batch.column(1), strict=True):
                one = total.setdefault(number[name.as_py()], np.zeros(PLACES, dtype=np.int64))
                np.add.at(one, trigrams(value.as_py()), 1)
            for language, one in total.items():
                place = np.flatnonzero(one)
                yield pa.record_batch([pa.array(np.full(len(place), language, np.int32)), pa.array(place.astype(np.int32)), pa.array(one[place])],
                                      names=["language", "place", "n"])

    size = len(languages)
    language, place, n = (np.zeros(0, np.int64),) * 3
    if languages:
        rows = known.mapInArrow(count, "language int, place int, n bigint").groupBy("language", "place").agg(F.sum("n").alias("n")).toPandas()
        rows = rows.sort_values(["place", "language"])
        language, place, n = (rows[c].to_numpy().astype(np.int64) for c in ("language", "place", "n"))
    unseen = np.log(0.1 / (np.bincount(language, n, size) + 0.1 * PLACES))
    starts = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=PLACES))))
    return TextModel([*languages, UND], np.append(unseen, -np.log(PLACES)), starts, language, np.log((n + 0.1) / 0.1))


def declared_language(markup: Column) -> Column:
    """The code in the lang attribute of the html tag, or null."""
    code = F.lower(F.regexp_extract(markup, r"(?i)<html[^<>]*?\slang\s*+=\s*+[\"']?+([a-z]{2,3})", 1))
    return F.when(code != "", code)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:]++)", 1))
    return F.when(host != "", host)


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host with several, unless it is a number."""
    last = F.substring_index(host, ".", -1)
    return F.when(F.contains(host, F.lit(".")) & ~last.rlike("^[0-9]*$"), last)


def identify(rows: DataFrame, model: TextModel, keys: Sequence[str], markup: bool = False) -> DataFrame:
    """`keys`, language, chance and accepted for each row of (keys, text, host, declared).

    `host` and `declared` may be null. With `markup` tags are taken out of texts first.
    """
    size = len(model.languages)
    source = rows.select(*keys, "host", "declared", "text")
    lists = T.ArrayType(T.DoubleType())
    schema = T.StructType([*source.drop("text").schema.fields, T.StructField("text_log", lists), T.StructField("p", lists)])

    def chances(logs: np.ndarray) -> np.ndarray:
        raw = np.exp(logs - logs.max(-1, keepdims=True))
        return raw / raw.sum(-1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = [model.evidence(t.as_py(), markup) for t in column]
            own = [None if x is None else chances(np.array(x)) for x in found]
            yield batch.drop_columns(["text"]).append_column("text_log", pa.array(found, pa.list_(pa.float64()))).append_column(
                "p", pa.array(own, pa.list_(pa.float64())))

    scored = source.mapInArrow(run, schema)
    scored = stage(scored.withColumn("site", site_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "text-evidence")
    known = scored.filter("p IS NOT NULL")

    def summed(table: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
        """(keys, out, rows): sums of the arrays in `column`, place by place, and the number of rows."""
        each = table.select(*keys, F.posexplode(column).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.count("*").alias("rows"))
        return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out), F.max("rows").alias("rows"))

    total = summed(known, [], "p", "all").first()["all"] or [0.0] * size
    everywhere = sum(total) or 1.0
    overall = (np.array(total) + 0.5) / (everywhere + 0.5 * size)

    def code_logs(column: str) -> DataFrame:
        """(column, <column>_log): log chance of the code in each language, smoothed with its chance overall."""
        table = summed(known.filter(F.col(column).isNotNull()), [column], "p", "n")
        share = F.col("rows") / F.lit(everywhere)
        logs = F.zip_with("n", F.array(*[F.lit(x) for x in total]), lambda n, t: F.log((n + CODE_ROWS * share) / (t + CODE_ROWS)))
        return stage(table.select(F.col(column).alias(f"{column}_key"), logs.alias(f"{column}_log")), column)

    hosts = stage(summed(known.filter("host IS NOT NULL"), ["host", "site"], "p", "at_host").drop("rows").withColumnRenamed("site", "of_site"), "host-sums")
    sites = summed(hosts, ["of_site"], "at_host", "at_site").drop("rows")
    # Tables of counts are written first: joins of plain tables, whose hot keys Spark can split.
    hosts = stage(hosts.join(sites, "of_site", "left").select(F.col("host").alias("host_key"), "at_host", "at_site"), "hosts")
    joined = scored.join(hosts, scored.host == hosts.host_key, "left")
    for column in ("declared", "suffix"):
        codes = code_logs(column)
        joined = joined.join(codes, joined[column] == codes[f"{column}_key"], "left")
    joined = joined.select(*keys, "text_log", "p", "at_host", "at_site", "declared_log", "suffix_log")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def table(name: str, default: np.ndarray | float) -> np.ndarray:
                column = batch.column(batch.schema.get_field_index(name))  # noqa: B023
                out = np.array(np.broadcast_to(default, (len(column), size)), dtype=np.float64)
                out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy().reshape(-1, size)
                return out

            def smoothed(counts: np.ndarray, wider: np.ndarray, weight: float) -> np.ndarray:
                return (counts + wider * weight) / (counts.sum(1, keepdims=True) + weight)

            own = table("p", 0.0)
            rest = lambda name: np.maximum(table(name, own) - own, 0.0)  # noqa: B023, E731
            prior = smoothed(rest("at_host"), smoothed(rest("at_site"), overall, SITE_ROWS), HOST_ROWS)
            known = batch.column(batch.schema.get_field_index("text_log")).is_valid().to_numpy(zero_copy_only=False)
            found = chances(table("text_log", 0.0) + np.log(prior) + table("declared_log", 0.0) + table("suffix_log", 0.0))
            language = [model.languages[i] if k else UND for i, k in zip(found.argmax(1), known, strict=True)]
            chance = np.where(known, found.max(1), 1.0)
            yield pa.record_batch([*(batch.column(i) for i in range(len(keys))), pa.array(language, pa.string()), pa.array(chance)],
                                  names=[*keys, "language", "chance"])

    out = T.StructType([*joined.select(*keys).schema.fields, T.StructField("language", T.StringType()), T.StructField("chance", T.DoubleType())])
    return joined.mapInArrow(fuse, out).withColumn("accepted", (F.col("language") != UND) & (F.col("chance") >= LEAST_CHANCE))


def identify_documents(docs: DataFrame, model: TextModel, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, th, language, chance, accepted) of documents; their source stands for a host."""
    rows = docs.select(*doc_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"), F.col(host).alias("host"),
                       F.lit(None).cast("string").alias("declared"))
    return identify(rows, model, KEY)


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(page_id, language, chance, accepted) of web pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(markup).alias("text"), host_of(F.col(url)).alias("host"),
                        declared_language(F.col(markup)).alias("declared"))
    return identify(rows, model, ["page_id"], markup=True)


def keep_identified(docs: DataFrame, label: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is accepted; languages are learned from their column `label`."""
    rejected = identify_documents(docs, fit_text(docs, label=label)).filter(~F.col("accepted"))
    return without(docs, rejected)


def op6_language_fusion(spark, sf_dir: str) -> DataFrame:
    """All documents and all pages: a row for each, with doc_id or page_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = fit_text(docs)
    found = identify_documents(docs, model).select(id_of(F.col("id")).alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"),
                                                   "language", "chance", "accepted")
    return found.unionByName(identify_pages(pages, model).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id",
                                                                 "language", "chance", "accepted"))
