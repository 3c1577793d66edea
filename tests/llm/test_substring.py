import random

import numpy as np

from gatewright.llm.substring_countmin import pack, remove_repeats, rolled, unpack
from tests.llm.brute import remove_repeats as brute


def rows():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghijklm") for _ in range(n))
    shared = [text(5), text(9), text(30)]
    out = [(i, text(rng.randrange(0, 30)) + "\t" + rng.choice(shared) + "\n " + text(3)) for i in range(60)]
    out += [(100 + i, out[i % 7][1]) for i in range(20)]  # copies
    out += [(90, None), (91, ""), (92, " \t "), (None, out[3][1]), (5, out[5][1]), (5, shared[2]), (93, "x\x1cy\x85z w é"), (94, "a b")]
    return out + [(95, "a b"), (-4, out[9][1]), (96, "q " * 5000)]


def test_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows()], "doc_id bigint, text string, block int, least int")
    for window in (4, 6):
        got = [tuple(r) for r in remove_repeats(docs, window).collect()]
        assert sorted(got, key=str) == sorted(brute(rows(), window), key=str)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_parts():
    cells = np.array([0, 5, 9, 1 << 23], dtype=np.uint64)
    twice = np.array([True, False, False, True])
    back = unpack(pack(cells, twice))
    assert back[0].tolist() == cells.tolist() and back[1].tolist() == [1, 0, 0, 1]
    words = np.arange(1, 40, dtype=np.uint64) ** np.uint64(9)
    for window in range(1, 20):
        repeat = np.concatenate((words, words))
        h = rolled(repeat, window)
        assert len(h) == len(repeat) - window + 1 and len(set(h.tolist())) == len(words)
