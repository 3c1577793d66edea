import random
from collections import defaultdict

import numpy as np

import __spark_entry__ as driver
from gatewright.llm import golay
from gatewright.llm.components import components
from gatewright.llm.rows import doc_key
from gatewright.llm.simhash_golay import GROUP, by_blocks, by_pieces, fingerprint, fuzzy_keys, group_links, keep_one, links, near_duplicates
from pyspark.sql import functions as F
from tests.llm import brute


def test_golay():
    rng = np.random.default_rng(1)
    words, bits = rng.integers(0, 1 << 23, 20_000), rng.integers(0, 23, 20_000)
    one, two = golay.keys(words), golay.keys(words ^ (1 << bits))
    assert all(set(a) & set(b) - {-1} for a, b in zip(one.tolist(), two.tolist(), strict=True))
    assert set(np.bincount((one >= 0).sum(1)).nonzero()[0]) == {1, 6}


def test_keys_find_three_bits():
    rng = np.random.default_rng(2)
    for x in rng.integers(-(1 << 63), (1 << 63) - 1, 200, dtype=np.int64):
        y = x
        for b in rng.choice(64, 3, replace=False):
            y = (np.array([y]).view(np.uint64) ^ np.uint64(1 << int(b))).view(np.int64)[0]
        key, owner = fuzzy_keys(np.array([x, y]))
        assert set(key[owner == x]) & set(key[owner == y])


def test_group_links():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 30, 400)).astype(np.int32)
    fps = rng.integers(0, 1 << 12, 400)
    u, v = group_links(key, fps, 3)
    assert all(bin(a ^ b).count("1") <= 3 for a, b in zip(u.tolist(), v.tolist(), strict=True))
    for k in set(key.tolist()):
        own = sorted(set(fps[key == k].tolist()))
        links = {frozenset(p) for p in zip(u.tolist(), v.tolist(), strict=True)}
        want = brute.components(len(own), lambda a, b: bin(own[a] ^ own[b]).count("1") <= 3)  # noqa: B023
        got = brute.components(len(own), lambda a, b: frozenset((own[a], own[b])) in links and bin(own[a] ^ own[b]).count("1") <= 3)  # noqa: B023
        assert want == got


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    out = []
    for i in range(40):
        words = [word() for _ in range(rng.choice([0, 1, 2, 3, 50, 300]))]
        out.append(" ".join(words))
        for _ in range(3):
            if words:
                words[rng.randrange(len(words))] = word()
            out.append("\n".join(words).upper() if i % 3 else " ".join(words))
    return out + [None, "", " \t", "é É x", "A\x85B c", "aé b"]


def test_near_duplicates(spark):
    rows = [(7 * i % 500, t) for i, t in enumerate(texts())] + [(None, texts()[30]), (7, texts()[1]), (3, "q " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, fp int, root string")
    prints = [brute.simhash(t, 3) for _, t in rows]
    assert prints == [fingerprint(None if t is None else t.encode(), 3) % (1 << 64) for _, t in rows]
    root = brute.components(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), f, least.get(r)) for (d, _), f, r in zip(rows, prints, root, strict=True))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    assert near_duplicates(docs.limit(0)).collect() == []


def test_keys_above_the_size_are_split(spark):
    """Links connect the same fingerprints whether no key, many or nearly all are above the size."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 6, dtype=np.int64)
    # A hot key: first two words equal, third words of all kinds, many of them within three bits.
    hot = [int(base[0]) & (1 << 46) - 1 | int(x) << 46 for x in rng.integers(0, 1 << 17, 500)]
    flipped = []
    for x in base.tolist() * 40:
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x = (x % (1 << 64)) ^ (1 << int(b))
        flipped.append(x - (1 << 64) if x >> 63 else x)
    fps = sorted(set(hot + flipped + base.tolist()))
    distinct = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    want = brute.components(len(fps), lambda a, b: ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 3)
    for group in (GROUP, 60, 3):
        found = links(distinct, group=group).collect()
        assert all(((r.u ^ r.v) % (1 << 64)).bit_count() <= 3 for r in found)
        near = {(r.u, r.v) for r in found} | {(r.v, r.u) for r in found}
        assert want == brute.components(len(fps), lambda a, b: (fps[a], fps[b]) in near), group  # noqa: B023


def test_pieces_and_blocks_keep_every_pair(spark):
    """Pairs of up to three bits meet by a piece; rows of a large key meet in some pair of blocks of bounded size."""
    fps = [0, 0b111 << 46, 1 << 46 | 1 << 51 | 1 << 56, -1 ^ ((1 << 46) - 1)]
    keyed = spark.createDataFrame([(5, x) for x in fps], "key int, fp bigint")  # the third word is left out
    met = defaultdict(set)
    for r in by_pieces(keyed).collect():
        met[r.fp].add(r.key)
    assert met[0] & met[fps[1]] and met[0] & met[fps[2]] and not met[0] & met[fps[3]]
    rows = spark.range(1000).selectExpr("1L AS key", "id AS fp")
    groups = defaultdict(set)
    for r in by_blocks(rows, spark.createDataFrame([(1, 1000)], "key bigint, n bigint"), 100).collect():
        groups[r.key].add(r.fp)
    assert len(groups) == 55 and max(map(len, groups.values())) < 300
    assert all(any({a, b} <= g for g in groups.values()) for a in range(0, 1000, 37) for b in range(0, 1000, 41))


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [brute.simhash(t, 3) for _, t in rows]
    root = brute.components(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    got = driver.queries()["op10_simhash_golay"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, prints, root, strict=True))


def test_keep_one(spark):
    rows = [(7 * i % 500, t) for i, t in enumerate(texts())] + [(None, texts()[30]), (None, "alone here, no id"), (7, texts()[1]), (7, texts()[1])]
    docs = spark.createDataFrame([(*r, i % 2, "k") for i, r in enumerate(rows)], "doc_id bigint, text string, id int, `a.b` string")
    prints = [brute.simhash(t, 3) for _, t in rows]
    root = brute.components(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((d is None, d), least.get(r, (True, None)), key=lambda x: (x[0], x[1] or 0))
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(d) for _, d in least.values())
    assert {(r.doc_id, r.text) for r in got.collect()} <= set(rows)
    assert keep_one(docs.limit(0)).collect() == []


def test_keep_one_small(spark):
    a, b = "one two three four five six seven " * 9, "other words stand here " * 9
    rows = [(5, a), (2, a.upper()), (9, a), (None, a), (7, b), (7, b), (8, None), (4, ""), (None, "alone here"), (3, " x ")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, node string, root int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(
        [("2", a.upper()), ("7", b), ("4", ""), ("None", "alone here"), ("3", " x ")])
    assert keep_one(docs.limit(0)).collect() == []
    assert docs.select(*doc_key(F.col("doc_id"), F.col("text"))).distinct().count() == 9
