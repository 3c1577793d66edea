"""Streams over several micro-batches and several runs, with rows out of order, late and repeated."""

import datetime as dt
from pathlib import Path
from random import Random

from pyspark.sql import functions as F

from gatewright.lifecycle import lifecycle
from gatewright.session import fresh_dir
from gatewright.streaming.feeds import SEAL, arrive, heartbeat, read_events
from gatewright.streaming.gates import GateTable, append_rows, drain_gate, notify_once, sink_latest_stream, stream_gate
from gatewright.streaming.issues import IssueTable, stream_lifecycle
from gatewright.streaming.upsert import create_upserts, read_upserts, upsert_batch

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def _rows(n=400):
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else i % 7
        kind = ["error", "view", "error", "click", None][(i * i + user) % 5]
        # Several rows of one time, and some up to 20 hours before their place in the feed.
        rows.append((i, START + dt.timedelta(minutes=14 * (i - i % 2) - (i % 11 == 5) * 1200), None if user == 6 else user, kind))
    return rows


def _put(spark, base, rows):
    arrive(spark.createDataFrame(rows, SCHEMA).coalesce(1), base)


def _sorted(df, cols):
    return sorted(map(str, df.select(cols).collect()))


COLS = ["user_id", "opened_at", "updated_at", "closed_at", "failures", "state"]


def failed():
    return F.col("event_type") == "error"


def test_issues_equal_batch_over_runs(spark):
    """Four runs from one checkpoint, the first with two micro-batches; then a heartbeat settles what waits."""
    base, rows = fresh_dir(spark, "events-test"), _rows()
    parts = [rows[i * 80: (i + 1) * 80] for i in range(5)]
    _put(spark, base, parts[0])
    _put(spark, base, parts[1])
    stream = read_events(spark, base, files_per_batch=1)
    table = IssueTable(stream, ["user_id"], "ts", "event_id", failed(), "1 day", buckets=3).run()
    first = table.issues().count()
    assert 0 < first
    _put(spark, base, parts[2] + parts[3])
    table.run()
    _put(spark, base, parts[4])
    table.run()
    batch = lifecycle(spark.read.parquet(base), ["user_id"], "ts", "event_id", failed(), target_rows=20)
    assert _sorted(table.issues(), COLS) != _sorted(batch, COLS)  # the last day waits
    arrive(heartbeat(spark.read.parquet(base), SEAL), base)
    assert _sorted(table.run().issues(), COLS) == _sorted(batch, COLS)
    assert table.late_rows() == 0
    again = IssueTable(stream, ["user_id"], "ts", "event_id", failed(), "1 day", folder=table.base, buckets=3)
    assert _sorted(again.run().issues(), COLS) == _sorted(batch, COLS)  # nothing new: nothing changes


def test_late_rows_change_no_issue(spark):
    base, rows = fresh_dir(spark, "events-test"), _rows()
    _put(spark, base, rows)
    _put(spark, base, [(9001, START - dt.timedelta(days=9), 0, "error"), (9002, START, 3, "view"), (9003, None, 3, "view")])
    _put(spark, base, [(None, dt.datetime(2030, 1, 1), None, None)])
    table = IssueTable(read_events(spark, base, files_per_batch=1), ["user_id"], "ts", "event_id", failed()).run()
    batch = lifecycle(spark.createDataFrame(rows, SCHEMA), ["user_id"], "ts", "event_id", failed())
    assert _sorted(table.issues(), COLS) == _sorted(batch, COLS)
    assert table.late_rows() == 2


def test_issues_of_two_keys_and_empty_stream(spark):
    base = fresh_dir(spark, "events-test")
    rows = [(i, START + dt.timedelta(hours=i), i % 2, ["error", "view", "error"][i % 3]) for i in range(30)]
    _put(spark, base, [])
    table = IssueTable(read_events(spark, base, schema=spark.createDataFrame([], SCHEMA).schema), ["user_id", "event_type"], "ts", "event_id", failed()).run()
    assert table.issues().collect() == []
    _put(spark, base, rows)
    arrive(heartbeat(spark.createDataFrame(rows, SCHEMA), SEAL), base)
    got = table.run().issues()
    batch = lifecycle(spark.createDataFrame(rows, SCHEMA), ["user_id", "event_type"], "ts", "event_id", failed())
    assert _sorted(got, ["event_type", *COLS]) == _sorted(batch, ["event_type", *COLS])
    settled = stream_lifecycle(read_events(spark, base), ["user_id"], "ts", "event_id", failed())
    assert settled.columns == COLS


def test_gate_with_late_rows(spark):
    base, rows = fresh_dir(spark, "events-test"), _rows()
    for part in (rows[:200], rows[200:], [(9999, dt.datetime(2023, 12, 1), 1, "error"), (9998, START, 1, "view"), (9997, None, 1, "view")]):
        _put(spark, base, part)
    severity = F.when(F.col("event_type") == "error", "Error").otherwise("Info")
    stream = stream_gate(read_events(spark, base, files_per_batch=1).withColumn("severity", severity), "1 day", "1 day")
    table = GateTable(stream, buckets=2).run()
    want = {}
    for _, ts, _, kind in rows:
        day = dt.datetime(ts.year, ts.month, ts.day)
        want[day] = want.get(day, 0) + (kind == "error")
    assert {r.window_start: r.errors for r in table.windows().collect()} == want
    assert table.late_rows() == 2  # the window of the row at START had not ended one micro-batch before
    assert {r.window_start: r.errors for r in drain_gate(stream).collect()} == want


def test_notify_once(spark):
    """Repeats inside and outside the bound, in the same and in later micro-batches; a hot key; rows without a key."""
    base, out = fresh_dir(spark, "events-test"), fresh_dir(spark, "notified")
    hour = lambda h: START + dt.timedelta(hours=h)
    read = lambda: notify_once(read_events(spark, base, schema=spark.createDataFrame([], SCHEMA).schema), ["user_id"], "1 day", salts=4)
    hot = [(i, hour(0) + dt.timedelta(seconds=i), 1, "error") for i in range(2000)]

    def run(rows):
        _put(spark, base, rows)
        found = append_rows(read(), out).collect()
        return sorted((r.user_id, r.event_id) if r.user_id != 1 else (1, r.event_id // 10_000) for r in found)

    assert run([*hot, (5000, hour(1), 2, "x"), (5001, hour(2), None, "x")]) == [(1, 0), (2, 5000)]
    assert run([(i + 10_000, t, u, k) for i, t, u, k in hot] + [(15_000, hour(20), 2, "x"), (15_001, hour(20), 3, "x")]) == [(1, 0), (2, 5000), (3, 15_001)]
    run([(None, hour(100), None, None)])  # nothing but a heartbeat: all bounds end
    assert run([(30_000, hour(101), 1, "x"), (30_001, hour(101), 3, "x")]) == [(1, 0), (1, 3), (2, 5000), (3, 15_001), (3, 30_001)]
    plan = read().select("user_id")._jdf.queryExecution().toString()
    assert plan.count("DeduplicateWithinWatermark") >= 2


def test_latest_sink_and_upserts(spark):
    base, rows, folder = fresh_dir(spark, "events-test"), _rows(), fresh_dir(spark, "latest")
    for part in (rows[200:], rows[:200], rows[:10]):  # older and repeated rows later
        _put(spark, base, part)
        stream = read_events(spark, base).select("user_id", "event_id", "ts")
        got = {r.user_id: r.event_id for r in sink_latest_stream(stream, ["user_id"], ["ts", "event_id"], folder, buckets=4).collect()}
    want = {}
    for e, ts, u, _ in rows:
        want[u] = max(want.get(u, (ts, e)), (ts, e))
    assert got == {u: e for u, (_, e) in want.items()}


def test_upsert_table_does_not_grow(spark):
    """One row per key after every batch, one file per folder; a repeated batch changes nothing."""
    path, rng, want = fresh_dir(spark, "table"), Random(4), {}
    schema = "k long, part string, at long, v string"
    create_upserts(spark, path, spark.createDataFrame([], schema).schema)
    for batch in range(6):
        rows = [(rng.choice([None, *range(50)]), rng.choice("ab"), rng.randrange(100), f"{batch}-{i}") for i in range(300)]
        df = spark.createDataFrame(rows, schema)
        for _ in range(1 + batch % 2):
            assert upsert_batch(df, path, ["k", "part"], ["at"], 8) <= 8
        for k, part, at, v in rows:
            want[k, part] = max(want.get((k, part), (at, v)), (at, v))
        got = read_upserts(spark, path, df.schema).collect()
        assert len(got) == len(want) and {(r.k, r.part): (r.at, r.v) for r in got} == want
        assert len(list(Path(path).rglob("*.parquet"))) <= 8
    one = spark.createDataFrame([(7, "a", 1000, "new")], schema)
    stamps = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert upsert_batch(one, path, ["k", "part"], ["at"], 8) == 1
    assert len(set(Path(path).rglob("*.parquet")) - set(stamps)) == 1  # only the folder of the key
    assert upsert_batch(one.limit(0), path, ["k", "part"], ["at"], 8) == 0


def test_keys_share_calls(spark):
    """Many keys in a call of the state function, or a call for each key of a type that Python may compare otherwise."""
    base, rows = fresh_dir(spark, "events-test"), _rows()
    for part in (rows[:100], rows[100:250], rows[250:]):
        _put(spark, base, part)
    arrive(heartbeat(spark.read.parquet(base), SEAL), base)
    half = lambda df: df.withColumn("half", F.col("user_id") / 2)
    for key in ("user_id", "half"):
        table = IssueTable(half(read_events(spark, base, files_per_batch=1)), [key], "ts", "event_id", failed(), "40 days", slots=2).run()
        batch = lifecycle(half(spark.createDataFrame(rows, SCHEMA)), [key], "ts", "event_id", failed())
        cols = [key, *[c for c in COLS if c != "user_id"]]
        assert table.late_rows() == 0 and _sorted(table.issues(), cols) == _sorted(batch, cols)
        store = spark.read.format("statestore").load(f"{table.base}/log")
        assert store.select("key").distinct().count() <= (2 if key == "user_id" else 99)
