import random

import __spark_entry__ as driver
from gatewright.llm.best_fit import CAPACITY, pack, pack_shard
from tests.llm.brute import words_of


def brute(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fit = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins)
               if sum(x[0] for x in b) + length <= capacity and cluster not in {x[2] for x in b}
               and (source is None or source not in {x[1] for x in b})]
        if fit:
            at = min(fit)[1]
        else:
            at = len(bins)
            bins.append([])
        bins[at].append((length, source, cluster))
        out.append(at)
    return out


def test_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 5, 300):
        pieces = [(rng.randint(1, 40), rng.choice(["a", "a", "b", "c", None]), rng.randrange(max(1, n // 2))) for _ in range(n)]
        for order in (pieces, sorted(pieces, key=lambda p: -p[0])):
            assert pack_shard(order, 40) == brute(order, 40)


def check(rows, packed, capacity):
    assert sum(r.n_words for r in packed) == sum(len(words_of(t)) for _, t, _ in rows)
    text = {}
    for d, t, s in rows:
        text.setdefault(d, []).append((t, s))
    bins = {}
    for r in packed:
        if r.n_words == 0:
            assert r.shard is None and r.bin is None and r.place is None
        else:
            bins.setdefault((r.shard, r.bin), []).append(r)
    for (shard, _), rs in bins.items():
        assert sum(r.n_words for r in rs) <= capacity and sorted(r.place for r in rs) == list(range(len(rs)))
        assert (shard == -1) == any(r.n_words == capacity for r in rs)
        if all(len(text[r.doc_id]) == 1 for r in rs):
            sources = [text[r.doc_id][0][1] for r in rs if text[r.doc_id][0][1] is not None]
            texts = [text[r.doc_id][0][0] for r in rs]
            assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    return bins


def test_rows(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 25), rng.choice(["a", "a", "b", "c", None])) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "b"), (202, "x " * 1000, "a"), (None, "y z", "b"), (None, "y z", "b"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, source string, piece int, shard string")
    for shard_pieces in (1000, 20):
        check(rows, pack(docs, 10, shard_pieces=shard_pieces).collect(), 10)
    assert pack(docs.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = driver.queries()["op1_best_fit"](spark, folder).collect()
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bins = check(rows, got, CAPACITY)
    order = sorted((r for r in got if 0 < r.n_words < CAPACITY), key=lambda r: (r.shard, -r.n_words))
    source = {d: s for d, _, s in rows}
    hot = max(sum(source[r.doc_id] == s for r in order) for s in set(source.values()))
    assert len(bins) <= max(hot, sum(r.n_words for r in order) / CAPACITY * 1.3) + sum(r.n_words == CAPACITY for r in got)
