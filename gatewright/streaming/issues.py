"""Issue state as keyed state of a streaming query.

Spark's state store holds for each slot of keys, a hash of them, the open issues, and the rows that may still be
overtaken: rows come in any order within `delay`, wait until the watermark has passed them, and then
move the issue in order of time. A timer wakes a slot whose rows are due though no row of it came.
A row older than the watermark could belong inside an issue that is settled. Spark drops rows older than the watermark of the
micro-batch before; those between the two are given out as late. Both are counted, and change no issue.

Order matters within a key, so a key's rows of one micro-batch go through one call; they come in Arrow batches, and what
is kept between calls is an issue for each key and the rows of the last `delay`. Keys share calls because a call costs
milliseconds and a row microseconds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatewright.session import fresh_dir
from gatewright.streaming.feeds import all_progress, past_watermark, run_available
from gatewright.streaming.upsert import BUCKETS, create_upserts, read_upserts, upsert_batch

#: Open issues (micros, tie, micros, count) and rows that wait, each behind the keys they are of.
ISSUES = "opened array<bigint>, opened_tie array<bigint>, updated array<bigint>, failures array<bigint>"
ROWS = "ats array<bigint>, ties array<bigint>, fails array<boolean>"
#: Keys meet in so many calls at most; a call and its state cost far more than the rows of a key.
SLOTS = 8192
OUT = "opened bigint, opened_tie bigint, updated bigint, closed bigint, failures bigint, late boolean"


def _settle(issue: list | None, rows: list[tuple[int, int, bool]]) -> tuple[list | None, list[tuple]]:
    """Move an issue through rows in order: the issue after them, and what happened to each issue touched."""
    done, moved = [], False
    for at, tie, failed in rows:
        if failed:
            issue = [*issue[:2], at, issue[3] + 1] if issue else [at, tie, at, 1]
            moved = True
        elif issue:
            done.append((*issue[:3], at, issue[3]))
            issue, moved = None, False
    return issue, done + ([(*issue[:3], None, issue[3])] if issue and moved else [])


def _advance(n_keys: int, slots: bool):
    """The state function, for keys of `n_keys` columns; rows have (at, tie, failed), with `slots` behind those of their key."""
    names = [*[f"k{i}" for i in range(n_keys)], "opened", "opened_tie", "updated", "closed", "failures", "late"]
    n = n_keys if slots else 0

    def keyed(columns: Sequence[list]) -> Iterator[tuple]:
        return zip(*columns, strict=True) if n else repeat(())

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else [[]] * (2 * n + 7)
        issues = {k: list(issue) for k, issue in zip(keyed(kept[:n]), zip(*kept[n:n + 4], strict=True))}
        rows = defaultdict(list)
        for k, row in zip(keyed(kept[n + 4:2 * n + 4]), zip(*kept[2 * n + 4:], strict=True)):
            rows[k].append(row)
        mark = state.getCurrentWatermarkMs()
        late, out, wait = [], [], []
        for batch in batches if not state.hasTimedOut else ():
            found = zip(batch["at"].tolist(), batch["tie"].tolist(), batch["failed"].tolist(), strict=True)
            for k, row in zip(keyed([batch[c].tolist() for c in names[:n]]), found):
                if row[0] // 1000 < mark:
                    late.append((*(k or group), row[0], row[1], None, None, int(row[2]), True))
                else:
                    rows[k].append(row)
        for k, waiting in rows.items():
            issue, moved = _settle(issues.pop(k, None), sorted(r for r in waiting if r[0] // 1000 < mark))
            out += [(*(k or group), *o, False) for o in moved]
            wait += [(*k, *r) for r in waiting if r[0] // 1000 >= mark]
            if issue:
                issues[k] = issue
        if issues or wait:
            opened = [(*k, *issue) for k, issue in issues.items()]
            state.update((*_columns(opened, n + 4), *_columns(wait, n + 3)))
            if wait:
                state.setTimeoutTimestamp(max(min(r[n] for r in wait) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        if out or late:
            # One block of objects: columns of their own dtypes cost more than the work on a key's few rows.
            yield pd.DataFrame(out + late, columns=names, dtype=object)

    return step


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]


class IssueTable:
    """Issues of a stream in an upserted table, and how many rows came too late for them.

    `run` works on the rows present and goes on from the run before. Rows wait for the watermark: the last
    `delay` of a stream is settled once later rows, or a heartbeat, have arrived. Rows without a key, a time or a tie
    move the watermark at most; a row whose `failed` is null passes.
    """

    def __init__(self, stream: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: Column, delay: str = "1 day",
                 folder: str | None = None, buckets: int = BUCKETS, slots: int = SLOTS):
        self.spark, self.keys, self.buckets = stream.sparkSession, list(keys), buckets
        self.base = folder or fresh_dir(self.spark, "issues")
        names = [f"k{i}" for i in range(len(keys))]
        rows = stream.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
            F.col(tie).cast("bigint").alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"),
        ).withWatermark("ts", delay)
        whole = F.col("tie").isNotNull() & F.col("at").isNotNull()
        for n in names:
            whole = whole & F.col(n).isNotNull()
        rows = past_watermark(rows, "ts", whole)
        key_fields = [T.StructField(n, rows.schema[n].dataType) for n in names]
        self.schema = T.StructType([*key_fields, *T._parse_datatype_string(OUT).fields])
        # Other types of keys, which Python may not compare as Spark does, have a call each.
        dealt = all(isinstance(f.dataType, (T.IntegralType, T.StringType)) for f in key_fields)
        key_lists = lambda at: [f"{at}{i} array<{f.dataType.simpleString()}>" for i, f in enumerate(key_fields) if dealt]
        state = T._parse_datatype_string(", ".join([*key_lists("i"), ISSUES, *key_lists("w"), ROWS]))
        if dealt:
            rows = rows.withColumn("slot", F.pmod(F.xxhash64(*names), F.lit(slots)))
        self.events = rows.groupBy(*(["slot"] if dealt else names)).applyInPandasWithState(
            _advance(len(names), dealt), self.schema, state, "append", GroupStateTimeout.EventTimeTimeout)
        self.names, self.dropped = names, 0
        create_upserts(self.spark, f"{self.base}/table", self.schema)

    def run(self) -> IssueTable:
        # An issue is known by its first failure; it only grows, and is closed last.
        query = run_available(self.events.writeStream.outputMode("append"), f"{self.base}/log", lambda batch, _: upsert_batch(
            batch, f"{self.base}/table", [*self.names, "late", "opened", "opened_tie"], ["failures", "closed"], self.buckets))
        self.dropped += sum(o.numRowsDroppedByWatermark for p in all_progress(query) for o in p.stateOperators)
        return self

    def _table(self) -> DataFrame:
        return read_upserts(self.spark, f"{self.base}/table", self.schema)

    def late_rows(self) -> int:
        """Rows that came too late: those given out as late, and those Spark dropped in the runs of this object."""
        return self.dropped + self._table().filter("late").count()

    def issues(self) -> DataFrame:
        """(keys, opened_at, updated_at, closed_at, failures, state)"""
        time = lambda c, name: F.timestamp_micros(c).alias(name)
        state = F.when(F.col("closed").isNull(), "open").otherwise("closed").alias("state")
        return self._table().filter("NOT late").select(
            *[F.col(n).alias(k) for n, k in zip(self.names, self.keys, strict=True)],
            time("opened", "opened_at"), time("updated", "updated_at"), time("closed", "closed_at"), "failures", state)


def stream_lifecycle(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: Column, delay: str = "1 day") -> DataFrame:
    """Run the issue lifecycle over the data present: the issues that are settled by its watermark."""
    return IssueTable(stream, keys, ts, tie, failed, delay).run().issues()
