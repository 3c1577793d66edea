"""Spans as dyadic blocks: few rows, the same results."""

import random

from pyspark.sql import functions as F

from gatewright.operators.enclosing import enclosing_chains, in_scope, lay_spans
from gatewright.operators.intervals import block_at, cover
from gatewright.operators.scope import lay_line_spans, scope_spans


def test_covers(spark):
    rng = random.Random(1)
    rows = [(a, a + n) for a in (-9, -1, 0, 1, 7, 64) for n in range(-2, 40)]
    rows += [(a := rng.randrange(-10**6, 10**6), a + rng.randrange(1, 10**7)) for _ in range(200)] + [(0, 2**40), (None, 3)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        blocks = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.c)
        if r.a is None or r.b < r.a:
            assert blocks == []
            continue
        assert blocks[0][0] == r.a and blocks[-1][1] == r.b + 1
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:], strict=False))
        assert len(blocks) <= max(1, 2 * (r.b - r.a + 1).bit_length())
    (r,) = spark.range(1).select(*[block_at(F.lit(-9), F.lit(x)) for x in (0, 3, 40)]).collect()
    assert tuple(r) == (-9, -2, -1)


def test_long_spans_are_few_rows(spark):
    one = spark.createDataFrame([(1, 5, 10_000_005)], "doc int, start_pos long, end_pos long")
    assert lay_spans(one, "start_pos", "end_pos", 2048).count() < 50
    assert lay_line_spans(one, "start_pos", "end_pos").count() < 50
    items = spark.createDataFrame([(1, 5), (1, 6), (1, 9_999_999), (1, 10_000_005), (2, 9)], "doc int, pos long")
    assert sorted(r.pos for r in in_scope(items, one, ["doc"]).collect()) == [6, 9_999_999]


def test_long_and_short_spans(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), s := rng.randrange(3000), s + rng.choice([-1, 0, 1, 5, 63, 64, 65, 200, 2500])) for _ in range(300)] + [("c", 1, 9)]
    runs = [(rng.choice("ab"), s := rng.choice([rng.randrange(5600), rng.randrange(100)]), s + rng.choice([0, 0, 3, 130])) for _ in range(25)]
    s, c = spark.createDataFrame(spans, "path_key string, start_line int, end_line int"), spark.createDataFrame(runs, "path_key string, f int, l int")
    want = sorted(x for x in spans if x[0] == "c" or any(k == x[0] and max(f, x[1]) <= min(last, x[2]) for k, f, last in runs))
    assert sorted(tuple(r) for r in scope_spans(s, c, line="f", last_line="l").collect()) == want
    lines = c.select("path_key", F.explode(F.sequence("f", "l")).alias("line_no"))
    assert sorted(tuple(r) for r in scope_spans(s, lines).collect()) == want
    assert scope_spans(s, c.limit(0), line="f", last_line="l").count() == len(spans)
    points = [(rng.choice("ab"), rng.randrange(6000)) for _ in range(200)]
    got = in_scope(spark.createDataFrame(points, "path_key string, pos int"), s, ["path_key"], start="start_line", end="end_line", width=16)
    assert sorted((r.path_key, r.pos, r.start_line, r.end_line) for r in got.collect()) == sorted(
        (k, p, a, b) for k, p in points for e, a, b in spans if e == k and a < p < b)


def test_enclosing_chains(spark):
    """Long and short spans over many buckets against all pairs; an item keeps its row, and null keys meet nothing."""
    rng = random.Random(3)
    spans = [(k, a, a + n, f"s{i}") for i in range(60) for k in ("a", "b", None)
             for a, n in [(rng.randrange(100), rng.choice([0, 1, 5, 40, 300]))]]
    items = [(k, p) for k in ("a", "b", "c", None) for p in range(0, 400, 3)]
    s = spark.createDataFrame(spans, "doc string, start_pos int, end_pos int, name string")
    got = enclosing_chains(spark.createDataFrame(items, "doc string, pos int"), s, ["doc"], width=16).collect()
    assert len(got) == len(items)
    for r in got:
        want = sorted((a, b, n) for k, a, b, n in spans if k is not None and k == r.doc and a < r.pos < b)
        assert (r.chain and [tuple(x) for x in r.chain]) == (want or None)
