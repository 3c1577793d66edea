"""Benchmark decontamination over a distributed positional inverted index.

Postings (term, document, position) of all terms that any benchmark item uses are written once,
clustered by term within each file. Every benchmark window then takes its terms from the rarest on:
the list of the rarest gives candidate places, offset by the place of the term in the window; the
second list thins them out; the rest of the terms confirm them. Lists are intersected as joins on
(document, term, position), so a frequent term is only looked up where a rare one already fits.

Only built-in functions are used. Tables that are joined small are written first, so that Spark
sees their size and broadcasts them only below its limit.

Rows: a null or empty text has no words and gets a row with zeros. Repeated rows each get their row.
A row without doc_id is judged like any other. Items without words match nothing; items with equal
texts all count. Items that share an id count as one in `items`, whatever their texts; items without an id
are found like any other, but are not named there. Other columns are not read. Empty documents give an empty table, an empty
benchmark gives no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.llm.rows import KEY as DOC
from gatewright.llm.rows import doc_key, id_of, without
from gatewright.session import stage

#: What a word is, and letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Term of the one row a document has besides its postings; its position is the number of words.
LENGTH = ""
#: Words that a term may stand from its place in the proximity matches of the query.
SLOP = 2
#: More probes than a window has.
MANY = 1 << 30
#: Terms of a window in a proximity search: ranks are bits of a bigint.
BITS = 62
PLACE = ["window", *DOC, "start"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """Postings (id, th, term, pos), pos from 1, and a row of LENGTH per document row."""

    postings: DataFrame

    def lengths(self) -> DataFrame:
        return self.postings.filter(F.col("term") == LENGTH).select(*DOC, F.col("pos").cast("bigint").alias("n_words"))

    def counts(self) -> DataFrame:
        return self.postings.filter(F.col("term") != LENGTH).groupBy("term").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of `docs`, of all their terms or of those in `vocabulary` (term)."""
    found = terms(F.col(text))
    rows = docs.select(*doc_key(F.col(doc_id), F.col(text)), found.alias("terms"))
    rows = rows.select(*DOC, F.size("terms").alias("n"), F.posexplode(F.concat(F.array(F.lit(LENGTH)), F.col("terms"))))
    rows = rows.select(*DOC, F.col("col").alias("term"), F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("pos")).alias("pos"))
    if vocabulary is not None:
        wanted = vocabulary.select("term").union(vocabulary.sparkSession.sql(f"SELECT '{LENGTH}' AS term"))
        rows = rows.join(stage(wanted.distinct(), "vocabulary"), "term", "left_semi")
    # A sort by one number is a radix sort; it puts the postings of a term together and keeps their order.
    return Index(stage(rows.sortWithinPartitions(F.xxhash64("term")), "postings"))


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, at, terms): each window of each item; a shorter item is one window."""
    rows = items.select(F.col(item_id).alias("item_id"), terms(F.col(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return rows.select("item_id", "all", F.explode(starts).alias("at")).select(
        "item_id", "at", F.slice("all", F.col("at") + 1, F.lit(window)).alias("terms")
    )


def _probes(windows: DataFrame, index: Index) -> DataFrame:
    """(window, probes): distinct windows, numbered, with their terms from the rarest on."""
    spread = windows.select("window", F.posexplode("terms").alias("off", "term"))
    counted = spread.join(stage(index.counts(), "term-counts"), "term", "left")
    probe = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term")
    ranked = counted.groupBy("window").agg(F.array_sort(F.collect_list(probe)).alias("probes"))
    return ranked.filter(F.col("probes")[0]["n"] > 0)


def _asked(found: DataFrame, first: int, last: int) -> DataFrame:
    """The probes of ranks first..last-1 of each place: the term and where it is due; `used` is the place of the rarest term."""
    chosen = F.slice("probes", first + 1, last - first)
    rows = found.select(
        *PLACE, (F.col("start") + F.col("probes")[0]["off"]).alias("used"), "probes", F.size(chosen).alias("need"), F.posexplode(chosen))
    return rows.select(*PLACE, "used", "probes", "need", (F.col("pos") + first).alias("rank"), F.col("col.term").alias("term"),
                       (F.col("start") + F.col("col.off")).alias("due"))


def _near(asked: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """`asked` with each posting `pos` of its term at most `slop` words from where it is due, but for the used one."""
    width = 2 * slop + 1
    zones = F.array_distinct(F.transform(F.array(F.lit(-slop), F.lit(slop)), lambda d: F.floor((F.col("due") + d) / width)))
    met = asked.withColumn("zone", F.explode(zones)).join(
        postings.withColumn("zone", F.floor(F.col("pos") / width)), [*DOC, "term", "zone"])
    return met.filter((F.abs(F.col("pos") - F.col("due")) <= slop) & (F.col("pos") != F.col("used")))


def _confirm(found: DataFrame, postings: DataFrame, first: int, last: int, slop: int = 0) -> DataFrame:
    """Places whose probes of ranks first..last-1 are all in the postings; those without such probes stay."""
    need = F.size(F.slice("probes", first + 1, last - first))
    asked = _asked(found.filter(need > 0), first, last).drop("probes")
    met = _near(asked, postings, slop) if slop else asked.join(postings.withColumnRenamed("pos", "due"), [*DOC, "term", "due"])
    kept = met.groupBy(*PLACE, "need").agg(F.count_distinct("rank").alias("got")).filter("got = need").select(*PLACE)
    return kept.unionByName(found.filter(need <= 0).select(*PLACE))


def _bit(rank: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), rank)


def _complete(found: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(window, id, th, start, exact): places whose probes all have a posting within `slop`.

    Ranks are bits of a number, so a place is one small row however many postings it meets.
    """
    few = F.when(F.size("probes") <= BITS, F.size("probes")).otherwise(F.raise_error(F.lit(f"proximity takes windows of {BITS} terms at most")))
    met = _near(_asked(found.filter(few > 1), 1, MANY).drop("probes"), postings, slop)
    bit = _bit(F.col("rank"))
    bits = met.select(*PLACE, "need", bit.alias("near"), F.when(F.col("pos") == F.col("due"), bit).otherwise(0).alias("hit"))
    every = _bit(F.col("need") + 1) - 2
    whole = bits.groupBy(*PLACE, "need").agg(F.bit_or("near").alias("near"), F.bit_or("hit").alias("hit")).filter(F.col("near") == every)
    return whole.select(*PLACE, (F.col("hit") == every).alias("exact")).unionByName(
        found.filter(F.size("probes") == 1).select(*PLACE, F.lit(True).alias("exact")))


def _unserved(found: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(window, id, th, start): complete places where the probes of a term can't each have a posting of its own.

    Probes of one term are served in the order of their places, each with the first posting left to it:
    their ranges are equally long, so this finds an assignment if there is one.
    """
    met = _near(_asked(found, 1, MANY).drop("probes"), postings, slop).groupBy(*PLACE).agg(
        F.collect_set(F.struct("rank", "pos")).alias("met")).join(found.select("window", "probes").distinct(), "window")
    # Probes with their ranks, by term and then by place in the window.
    others = F.slice(F.transform("probes", lambda p, i: F.struct(p["term"].alias("term"), p["off"].alias("off"), i.alias("rank"))), 2, MANY)

    def serve(state: Column, probe: Column) -> Column:
        left = F.filter("met", lambda m: (m["rank"] == probe["rank"]) & ((probe["term"] != state["term"]) | (m["pos"] > state["last"])))
        pos = F.array_min(F.transform(left, lambda m: m["pos"]))
        return F.struct(probe["term"].alias("term"), F.coalesce(pos, state["last"]).alias("last"), (state["ok"] & pos.isNotNull()).alias("ok"))

    start = F.struct(F.lit(LENGTH).alias("term"), F.lit(0).alias("last"), F.lit(True).alias("ok"))
    served = F.aggregate(F.array_sort(others), start, serve, lambda state: state["ok"])
    return met.filter(~served).select(*PLACE)


def phrase_matches(index: Index, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(window, id, th, start, size, exact): places in documents where all terms of a window stand.

    `windows` is (window bigint, terms). With `slop` 0 these are exact phrases from word `start`
    on. Otherwise proximity matches come with them: each term may stand up to `slop` words from its
    place, as seen from the rarest term, in any order, and each has a word of its own.
    """
    probes = stage(_probes(windows, index), "probes")
    post = index.postings
    firsts = stage(probes.select("window", F.col("probes")[0]["term"].alias("term"), F.col("probes")[0]["off"].alias("off")), "firsts")
    places = post.join(firsts, "term").select("window", *DOC, (F.col("pos") - F.col("off")).alias("start"))
    # An exact phrase starts at word 1 or later; a near one may hang over the edge.
    places = (places if slop else places.filter("start > 0")).distinct()
    seconds = stage(probes.filter(F.size("probes") > 1).select(F.col("probes")[1]["term"].alias("term")).distinct(), "seconds")
    thinned = stage(_confirm(places.join(probes, "window"), post.join(seconds, "term", "left_semi"), 1, 2, slop), "thinned")
    in_docs = stage(thinned.select(*DOC).distinct(), "hit-docs")
    found, hit_post = thinned.join(probes, "window"), post.join(in_docs, DOC, "left_semi")
    if slop:
        # Only near places with a repeated term can lack words: few, so their postings are met once more.
        complete = stage(_complete(found, hit_post, slop), "complete")
        repeated = F.size(F.array_distinct(F.col("probes.term"))) < F.size("probes")
        doubtful = stage(complete.filter("NOT exact").drop("exact").join(probes.filter(repeated), "window"), "doubtful")
        doubtful_docs = stage(doubtful.select(*DOC).distinct(), "doubtful-docs")
        rest = complete.join(_unserved(doubtful, post.join(doubtful_docs, DOC, "left_semi"), slop), PLACE, "left_anti")
    else:
        rest = _confirm(found, hit_post, 2, MANY).withColumn("exact", F.lit(True))
    return rest.join(probes.select("window", F.size("probes").alias("size")), "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                  slop: int = 0) -> DataFrame:
    """(id, th, n_words, n_hit, items, near): a row for each row of `docs`, keyed by `doc_key`.

    `n_hit` and `items` are of exact matches. `near` are the items of which no window stands in the
    text as it is, but one by a proximity match within `slop`; with 0 there are none.
    """
    every = stage(item_windows(items, window), "windows")
    vocabulary = every.select(F.explode("terms").alias("term")).distinct()
    index = build_index(docs, vocabulary, doc_id, text)
    # Equal windows are searched once, under a number; the benchmark bounds this table.
    # Written once with its numbers, which no two windows share, whatever the ids of their items are.
    numbered = stage(every.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "numbered")
    owners = stage(every.join(numbered, "terms").select("window", "item_id").distinct(), "owners")
    matches = stage(phrase_matches(index, numbered.select("window", "terms"), slop), "matches")
    # A word counts once however many windows cover it: only what reaches past earlier ends is new.
    spans = matches.filter("exact").groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    earlier = W.partitionBy(*DOC).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy(*DOC).agg(F.sum("fresh").alias("n_hit"))
    of_windows = matches.groupBy(*DOC, "window").agg(F.max("exact").alias("exact"))
    of_items = of_windows.join(owners, "window").groupBy(*DOC, F.col("item_id").cast("string").alias("item")).agg(F.max("exact").alias("exact"))
    named = of_items.groupBy(*DOC).agg(
        F.collect_set(F.when(F.col("exact"), F.col("item"))).alias("items"), F.collect_set(F.when(~F.col("exact"), F.col("item"))).alias("near"),
    )
    return index.lengths().join(hits, DOC, "left").join(named, DOC, "left").select(
        *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        *[F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("items", "near")],
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with all their columns."""
    return without(docs, contamination(docs, items, window, doc_id, text).filter("n_hit > 0"), doc_id, text)


def op5_positional_index(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, of exact matches, and `n_near`: items met only by proximity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items, slop=SLOP).select(
        id_of(F.col("id")).alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
    )


# `n_near`: a place is near if for any two probes of a term, none of them the rarest one, there are as many
# words of that term between their ranges as there are probes from one to the other.
ORACLE_SQL = rf"""
WITH texts AS (
    SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
    UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark
), split AS (
    SELECT kind, id, r, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM texts
), grams AS (
    SELECT DISTINCT id AS item_id, len(words) AS n, least(10, len(words)) AS size,
           array_to_string(words[i + 1: i + 10], ' ') AS gram
    FROM (SELECT *, unnest(range(greatest(len(words) - 10, 0) + 1)) AS i FROM split WHERE kind = 1 AND len(words) > 0)
), places AS (
    SELECT r, i, size, array_to_string(words[i: i + size - 1], ' ') AS gram
    FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i
          FROM split, (SELECT DISTINCT size FROM grams) WHERE kind = 0 AND len(words) >= size)
), hits AS (
    SELECT r, i, p.size, item_id FROM places p JOIN grams g ON p.gram = g.gram AND p.size = g.size
), covered AS (
    SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS w FROM hits) GROUP BY r
), named AS (
    SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS items
    FROM hits GROUP BY r
), probes AS (
    SELECT gram, generate_subscripts(terms, 1) - 1 AS off, unnest(terms) AS term
    FROM (SELECT DISTINCT gram, string_split(gram, ' ') AS terms FROM grams)
), postings AS (
    SELECT * FROM (SELECT r, generate_subscripts(words, 1) AS pos, unnest(words) AS term FROM split WHERE kind = 0)
    WHERE term IN (SELECT term FROM probes)
), counted AS (
    SELECT p.*, coalesce(n, 0) AS n FROM probes p LEFT JOIN (SELECT term, count(*) AS n FROM postings GROUP BY term) USING (term)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY gram ORDER BY n, off) AS rank FROM counted
), pairs AS (
    SELECT a.gram, a.term, a.off AS first, b.off AS last, count(*) AS need
    FROM ranked a JOIN ranked b ON a.gram = b.gram AND a.term = b.term AND a.off <= b.off
    JOIN ranked m ON m.gram = a.gram AND m.term = a.term AND m.off BETWEEN a.off AND b.off AND m.rank > 1
    WHERE a.rank > 1 AND b.rank > 1 GROUP BY ALL
), starts AS (
    SELECT DISTINCT gram, r, pos, pos - off AS start FROM ranked JOIN postings USING (term) WHERE rank = 1
), met AS (
    SELECT s.gram, s.r, s.start, p.first, p.last, p.need, count(d.pos) AS got
    FROM starts s LEFT JOIN pairs p USING (gram) LEFT JOIN postings d
    ON d.r = s.r AND d.term = p.term AND d.pos BETWEEN s.start + p.first - {SLOP} AND s.start + p.last + {SLOP} AND d.pos <> s.pos
    GROUP BY ALL
), near AS (
    SELECT DISTINCT m.r, item_id
    FROM (SELECT gram, r, start FROM met GROUP BY ALL HAVING bool_and(coalesce(got >= need, true))) m JOIN grams USING (gram)
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.r = m.r AND h.item_id = grams.item_id)
), nears AS (
    SELECT r, count(DISTINCT item_id) AS n_near FROM near GROUP BY r
)
SELECT id AS doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
       coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::bigint AS n_near
FROM split LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN nears USING (r) WHERE kind = 0
"""
