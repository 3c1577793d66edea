import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewright.llm.positional_index import build_index, contamination, drop_contaminated, item_windows, phrase_matches
from gatewright.llm.rows import doc_key
from tests.llm.brute import decontaminate, terms_of


def tables(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f the The é Zz 7").upper() if rng.random() < .1 else
                              rng.choice("a b c d e f the éx Zz 7".split()) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([14, 12, 10, 4, 3, 25])]
    items += [(6, items[0][1]), (7, None), (8, ""), (9, "!!"), (10, "x y z x y z x y z x y z"), (11, "solo")]
    docs = []
    for i in range(40):
        item = rng.choice([t for _, t in items if t])
        docs.append((i, text(rng.randrange(0, 60)) + ", " + item.replace(" ", " -- ") + ". " + text(9)))
    docs += [(50, None), (51, ""), (None, items[5][1]), (1, docs[1][1]), (1, "x y z x y z x y z x y z x y z x"), (53, "... !")]
    docs += [(60 + i, text(300)) for i in range(4)]
    return docs, items, (
        spark.createDataFrame([(d, t, 0, "k") for d, t in docs], "doc_id bigint, text string, pos int, term string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def test_brute_force(spark):
    docs, items, (d, b) = tables(spark)
    got = [(None if r.id == -(1 << 63) else r.id, r.n_words, r.n_hit, len(r["items"]), ",".join(r["items"]))
           for r in contamination(d, b).collect()]
    key = lambda r: tuple(map(str, r))
    want = decontaminate(docs, items, 10)
    assert sorted(got, key=key) == sorted(want, key=key)
    clean = drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[2])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "q alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma z z z z beta alpha")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    windows = item_windows(items).select(F.lit(1).cast("bigint").alias("window"), "terms")
    index = build_index(docs)
    ids = lambda slop: sorted({r.id for r in phrase_matches(index, windows, slop).collect()})
    assert ids(0) == [2] and ids(1) == [1, 2] and ids(8) == [1, 2, 3]
    assert docs.select(*doc_key(F.col("doc_id"), F.col("text"))).count() == 3


def _assignable(ranges, places):
    """Whether each range gets a place of its own, by augmenting paths."""
    owner = {}

    def give(i, tried):
        for p in places:
            if ranges[i][0] <= p <= ranges[i][1] and p not in tried:
                tried.add(p)
                if p not in owner or give(owner[p], tried):
                    owner[p] = i
                    return True
        return False

    return all(give(i, set()) for i in range(len(ranges)))


@pytest.mark.parametrize("slop", [1, 2, 5])
def test_proximity_brute_force(spark, slop):
    """Windows of few different terms against an assignment of each term to a word of its own."""
    rng = random.Random(slop)
    text = lambda n: " ".join(rng.choice("the the cat sat on mat".split()) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 12, 13])] + [(20, "the the cat"), (21, "unseen the"), (22, "the the the")]
    docs = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 8, 12, 20, 40, 7, 7, 9, 30, 30, 60])] + [(30, "the cat sat"), (31, "cat"), (31, "cat"), (None, "mat the the cat")]
    terms = [(d, terms_of(t)) for d, t in docs]
    counts = Counter(w for _, words in terms for w in words)
    want = []
    for doc, words in terms:
        near = set()
        for item, line in items:
            every = terms_of(line)
            grams = [every[i:i + 10] for i in range(max(len(every) - 10, 0) + 1)]
            if any(words[i:i + len(g)] == g for g in grams for i in range(len(words))):
                continue
            for g in grams:
                mark = min(range(len(g)), key=lambda o: (counts[g[o]], o))
                for at in [i for i, w in enumerate(words) if w == g[mark]]:
                    if all(_assignable([(at - mark + o - slop, at - mark + o + slop) for o, w in enumerate(g) if w == t and o != mark],
                                       [i for i, w in enumerate(words) if w == t and i != at]) for t in set(g)):
                        near.add(str(item))
        want.append((str(doc), len(words), sorted(near)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(d, b, slop=slop).collect()
    assert sorted((str(None if r.id == -(1 << 63) else r.id), r.n_words, r.near) for r in got) == sorted(want)
    assert sum(len(w[2]) for w in want) > 5
    exact = {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination(d, b).collect()}
    assert {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == exact


def test_empty(spark):
    docs, items, (d, b) = tables(spark)
    assert contamination(d.limit(0), b).collect() == []
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}


def test_ids_of_items(spark):
    """Items that share an id, or have none, are all found."""
    items = [(1, "red green blue"), (1, "one two three"), (None, "salt and pepper"), (None, "to and fro")]
    docs = [(i, f"x {t} y") for i, (_, t) in enumerate(items)] + [(9, "red two pepper")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.id: (r.n_hit, r["items"]) for r in contamination(d, b).collect()}
    assert got == {0: (3, ["1"]), 1: (3, ["1"]), 2: (3, []), 3: (3, []), 9: (0, [])}
    assert [r.doc_id for r in drop_contaminated(d, b).collect()] == [9]
