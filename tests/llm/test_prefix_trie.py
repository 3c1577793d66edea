import hashlib
from random import Random
from zlib import crc32

import numpy as np
import pytest

from gatewright.llm.prefix_trie import Slots, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pid int, first string"


def plain(rows):
    """rows: (conv_id, turn, role, text) -> node rows."""
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()
            said.setdefault(c, []).append((t is not None, t or 0, digest, r or "", x or ""))
    said = {c: [t[3:] for t in sorted(turns)] for c, turns in said.items()}
    rebuilt = {}
    for c, turns in said.items():
        h = crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(said.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n] for n in members}

    def leaves(n):
        return sum(map(leaves, children[n])) or 1

    def saved(n):
        return sum(map(saved, children[n])) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)

    out = []
    for n, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if rebuilt[c] == n)))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(who), len(n), parent, len(who), len(children[n]), leaves(n), saved(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("digest").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = Random(3)
    rows = []
    for c in [*range(-12, 70), 1001, 1002]:
        if c % 7 == 0:  # copies of a whole conversation
            turns = [("user", "a"), ("assistant", "b é"), ("user", None)]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ünd"])) for _ in range(rng.randrange(1, 14))]
        rows += [(c, rng.choice([i, i, 0, None]), r, x) for i, (r, x) in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (3000, 1, "user", "x" * 100_000), (3000, 0, "user", "")] + [(4000, 5, "user", "again")] * 3
    rows += [(5000 + i, 0, "user", "only") for i in range(40)]  # many ends at few nodes
    return rows


@pytest.mark.parametrize(("heavy", "shard_turns"), [(1, 50), (3, 200), (1000, 1 << 17)])
def test_against_plain_version(spark, rows, heavy, shard_turns):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)
    assert result(prefix_trie(table, heavy=heavy, shard_turns=shard_turns)) == plain(rows)


def test_few_rows(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "y")], SCHEMA)).collect() == []
    turnless = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9)
    assert result(prefix_trie(spark.createDataFrame([(turnless, 0, "user", "x", 1, "y")], SCHEMA))) == plain([(turnless, 0, "user", "x")])


def test_many_members_of_one_end(spark):
    """A text of members longer than one batch and one task goes through one hash."""
    from gatewright.llm.prefix_trie import member_hashes

    ids = [i * 3 for i in range(30_000)]
    members = spark.createDataFrame([(b"p" * 16, i) for i in ids] + [(b"q" * 16, 5)], "pid binary, conv_id bigint").repartition(6)
    got = {r.pid: r for r in member_hashes(members).collect()}
    assert got[b"p" * 16].ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[b"p" * 16].n == 30_000 and got[b"p" * 16].first == 0
    assert got[b"q" * 16].ends == hashlib.sha256(b"5").hexdigest()


def test_slots():
    keys = np.random.default_rng(1).integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    keys[:100, 0] = 7  # equal halves
    slots = Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(KeyError):
        slots.of(np.array([[1, 2]], dtype=np.uint64))
    assert len(Slots(keys[:0]).of(keys[:0])) == 0
