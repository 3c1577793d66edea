"""Blocked running operators against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gatewright.operators.lookups import chain_ends, latest_before, resolve_chain
from gatewright.operators.numbering import numbered
from gatewright.operators.ordered import RowBlocks, last_before, next_after, running_total, seq_block
from gatewright.operators.spans import pair_spans
from gatewright.session import stage, staging


def _rows(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 9)
        value = rnd.choice([None, None, rnd.randrange(100)])
        rows.append((key, i, value))
    rnd.shuffle(rows)
    return rows


def _expect(rows):
    out = {}
    by_key = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(key, []).append((at, value))
    for key, line in by_key.items():
        for i, (at, value) in enumerate(line):
            earlier = [v for _, v in line[:i] if v is not None]
            later = [v for _, v in line[i + 1:] if v is not None]
            out[key, at] = (
                earlier[-1] if earlier else None,
                value if value is not None else (earlier[-1] if earlier else None),
                later[0] if later else None,
                sum(v or 0 for _, v in line[: i + 1]),
                sum(v or 0 for _, v in line[:i]),
            )
    return out


@pytest.mark.parametrize("blocks", [seq_block, lambda _, width: RowBlocks(width)])
@pytest.mark.parametrize("width", [1, 30, 10_000])
def test_against_brute_force(spark, width, blocks, partitions=5):
    rows = _rows(seed=width)
    df = spark.createDataFrame(rows, "key int, at long, value int").repartition(partitions)
    keys, order, block, value = ["key"], ["at"], blocks("at", width), F.col("value")
    df = last_before(df, keys, order, block, value, "before")
    df = last_before(df, keys, order, block, value, "upto", inclusive=True)
    df = next_after(df, keys, order, block, value, "after")
    df = running_total(df, keys, order, block, F.coalesce(value, F.lit(0)), "total")
    df = running_total(df, keys, order, block, F.coalesce(value, F.lit(0)), "total_before", inclusive=False)
    got = {(r.key, r.at): (r.before, r.upto, r.after, r.total, r.total_before) for r in df.collect()}
    assert got == _expect(rows)


def test_plain_window_form_agrees(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "key int, at long, value int")
    got = {(r.key, r.at): r.before for r in last_before(df, ["key"], ["at"], None, F.col("value"), "before").collect()}
    assert got == {k: v[0] for k, v in _expect(rows).items()}


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "key int, at long, value int")
    out = last_before(df, ["key"], ["at"], seq_block("at", 1), F.col("value"), "before").collect()
    assert len(out) == 2 and all(r.before is None for r in out)


def test_as_of_is_strict(spark):
    uses = spark.createDataFrame([(1, 5, "u5"), (1, 9, "u9"), (2, 1, "u1")], "key int, at long, use string")
    assigns = spark.createDataFrame([(1, 5, 50), (1, 4, 40), (1, 4, 41), (2, 3, 30)], "key int, at long, v int")
    out = latest_before(uses, assigns, ["key"], "at", "v", RowBlocks(2), "v")
    assert {r.use: r.v for r in out.collect()} == {"u5": 41, "u9": 50, "u1": None}


def test_chain_ends(spark):
    """Terminal, deep, dangling and circular references, against a walk."""
    refs = {i: i + 1 for i in range(1, 40)}
    refs.update({i: i + 1 for i in range(1000, 1099)} | {1099: 40})
    refs.update({100: 101, 101: 100, 200: 999})
    rows = [(k, r, f"lit{k}") for k, r in refs.items()] + [(40, None, "end"), (50, None, "own")]
    out = {r.key: (r.value, r.depth) for r in resolve_chain(
        spark.createDataFrame(rows, "k int, ref int, lit string"), "k", "ref", "lit").collect()}
    for key in (*refs, 40, 50):
        at, depth = key, 0
        while refs.get(at) is not None and depth <= 300:
            at, depth = refs[at], depth + 1
        known = at in (40, 50) and depth <= 300
        assert out[key] == (({40: "end", 50: "own"}[at], depth) if known else (None, None)), key


@pytest.mark.parametrize("blocked", [False, True])
def test_pairing_of_unbalanced_tokens(spark, blocked):
    rnd = random.Random(3)
    rows, want = [], set()
    for doc in range(12):
        tokens = [rnd.choice([1, 1, -1]) if doc % 2 else rnd.choice([1, -1, -1]) for _ in range(40)]
        rows += [(doc, i, t) for i, t in enumerate(tokens, 1)]
        level, last = 0, {}
        for i, t in enumerate(tokens, 1):
            level += t
            at = level if t == 1 else level + 1
            if t == -1 and last.get(at, (0, 0))[1] == 1:
                want.add((doc, last[at][0], i, at))
            last[at] = (i, t)
    df = spark.createDataFrame(rows, "doc int, tok_no int, d int").repartition(4)
    block = RowBlocks(6) if blocked else None
    out = pair_spans(df, ["doc"], F.col("d"), block=block)
    assert {(r.doc, r.open_no, r.close_no, r.depth) for r in out.collect()} == want


def test_block_cuts(spark):
    """Null positions, bursts and ties give the same rows for every block size, and no block is much too large."""
    rows = [(1, i if i % 21 else None, i) for i in range(1, 400)] + [(1, 10**12, 1000)] + [(2, 5, i) for i in range(50)] + [(None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, at long, tie int")
    for op in (lambda b: running_total(df, ["k"], ["at", "tie"], b, F.lit(1), "v"),
               lambda b: last_before(df, ["k"], ["at", "tie"], b, F.col("tie"), "v"),
               lambda b: next_after(df, ["k"], ["at", "tie"], b, F.col("tie"), "v")):
        want = sorted(map(str, op(RowBlocks(10_000)).collect()))
        for size in (5, 40):
            assert sorted(map(str, op(RowBlocks(size)).collect())) == want
    burst = spark.createDataFrame([(1, i, i) for i in range(1000)] + [(1, 10**9, 0)], "k int, at long, tie int")
    ties = spark.createDataFrame([(1, 7, i) for i in range(1000)], "k int, at long, tie int")
    for rows in (burst, ties):
        sizes = RowBlocks(100).assign(rows, ["k"], ["at"]).groupBy("__block").count().collect()
        assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 100


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_per_run(spark, partitions):
    """Hot, small and null runs, null positions and ties, against a sort."""
    rnd = random.Random(partitions)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 1, 2, 9]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "run int, at int, tie int").repartition(4)
    got = numbered(df, ["run"], ["at", "tie"], partitions=partitions).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        lines.setdefault(r[0], []).append(r)
    assert sorted(map(str, ((r.run, r.at, r.tie, r.row_no) for r in got))) == sorted(
        str((*r, i)) for line in lines.values() for i, r in enumerate(line, 1))
    tied = numbered(df, ["run"], [], partitions=partitions).groupBy("run").agg(F.collect_list("row_no").alias("n"))
    assert all(sorted(r.n) == list(range(1, len(lines[r.run]) + 1)) for r in tied.collect())
    assert numbered(df.limit(0), ["run"], ["at"]).collect() == []


def test_chain_ends_told_apart(spark):
    """Cycles, ways into them, dangling references and repeated keys, against a walk."""
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, rnd.randrange(70), rnd.randrange(70)]), f"l{i}") for i, k in enumerate([*range(60), *range(20), 3, 3])]
    rows += [(k, 900, "hot") for k in range(1000, 1200)] + [(900, None, None), (901, 901, "self")]
    nodes = {}
    for k, ref, lit in rows:
        nodes.setdefault(k, []).append((ref is not None, ref or 0, ref, lit))
    nodes = {k: min(v, key=lambda r: (r[0], r[1], r[3] is not None, r[3] or ""))[2:] for k, v in nodes.items()}
    want = {}
    for k in nodes:
        path = [k]
        while path[-1] in nodes and nodes[path[-1]][0] is not None and nodes[path[-1]][0] not in path:
            path.append(nodes[path[-1]][0])
        if path[-1] not in nodes:
            want[k] = (None, None, "dangling", None)
        elif nodes[path[-1]][0] is None:
            want[k] = (nodes[path[-1]][1], len(path) - 1, "resolved", None)
        else:
            ring = path[path.index(nodes[path[-1]][0]):]
            want[k] = (None, None, "cycle" if k in ring else "to_cycle", min(ring))
    got = chain_ends(spark.createDataFrame(rows, "k int, ref int, lit string").repartition(5), "k", "ref", "lit").collect()
    assert len(got) == len(nodes) and {r.key: (r.value, r.depth, r.status, r.cycle) for r in got} == want
    assert {w[2] for w in want.values()} == {"dangling", "resolved", "cycle", "to_cycle"}


def test_staging(spark):
    """Staged tables go with their block, others stay; blocks may nest."""
    rows = spark.range(5)
    kept = stage(rows)
    with staging(spark) as outer:
        stage(rows)
        with staging(spark) as inner:
            assert stage(rows).count() == 5
        assert len(outer) == len(inner) == 1
        assert spark.read.parquet(outer[0]).count() == 5
        with pytest.raises(AnalysisException):
            spark.read.parquet(inner[0])
    with pytest.raises(AnalysisException):
        spark.read.parquet(outer[0])
    assert kept.count() == 5


def test_large_tables_are_dealt_to_more_tasks(spark):
    """What a task sorts does not grow with the table; small ones keep Spark's plan."""
    rows = [(k, i, i if i % 5 == 0 else None) for i in range(2000) for k in [i % 97]] + [(None, 3, 4)]
    df = spark.createDataFrame(rows, "key long, at long, value long")
    run = lambda block: last_before(df, ["key"], ["at"], block, F.col("value"), "seen", inclusive=True)
    dealt = run(RowBlocks(1000, task_rows=50))
    assert dealt.rdd.getNumPartitions() == 41 and run(RowBlocks(1000)).rdd.getNumPartitions() <= 8
    assert sorted(map(str, dealt.collect())) == sorted(map(str, run(None).collect()))
