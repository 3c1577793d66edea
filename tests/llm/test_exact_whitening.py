import math
from fractions import Fraction

import numpy as np

import __spark_entry__ as driver
from gatewright.llm.exact_whitening import characteristic, null_vectors, primes_below, roots_above, scatter, top_roots, whiten


def leverrier(a):
    """Characteristic polynomial in integers, lowest coefficient first."""
    n = len(a)
    a = np.array(a, dtype=object)
    m, c = np.zeros((n, n), dtype=object), [1]
    for k in range(1, n + 1):
        m = a @ m + np.eye(n, dtype=int).astype(object) * c[-1]
        c.append(-int(np.trace(a @ m)) // k)
    return c[::-1]


def psd(rng, size, rank, most=1000):
    x = rng.integers(-most, most, (rank, size)).astype(object)
    return (x.T @ x).tolist()


def test_polynomial(spark):
    rng = np.random.default_rng(2)
    for size, rank, most in ((1, 1, 9), (2, 2, 9), (5, 5, 1000), (6, 2, 1000), (12, 12, 10**6), (9, 9, 2**40)):
        a = psd(rng, size, rank, most)
        assert characteristic(spark, a) == leverrier(a)
    blocks = [[0] * 6 for _ in range(6)]  # zero pivots
    blocks[0][5] = blocks[5][0] = 2
    for i in range(6):
        blocks[i][i] = 3
    assert characteristic(spark, blocks) == leverrier(blocks)
    assert characteristic(spark, [[0, 0], [0, 0]]) == [0, 0, 1]


def test_primes():
    got = primes_below(1 << 31, 40)
    assert got[0] == 2**31 - 1 and all(pow(2, p - 1, p) == 1 and all(p % q for q in range(2, 1000)) for p in got)
    assert len(set(got)) == 40 and got == sorted(got, reverse=True)


def test_roots(spark):
    for roots in ([5, 3, 2], [7, 7, 7, 1], [4, 4, 1, 0, 0], [10**30, 10**30 - 1, 3], [1] * 6):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0], strict=True)]
        got, bits = top_roots(c, 8)
        wanted = [r for r in roots if r]
        assert len(got) == len(wanted)
        for g, r in zip(got, wanted, strict=True):
            assert 0 <= Fraction(r) - Fraction(g, 2**bits) <= Fraction(1, 2**bits)
        assert roots_above(c, 2, 0) == sum(r > 2 for r in roots)


def test_near_and_repeated_roots():
    """Roots that differ by a part in 10 ** 12 keep their vectors; equal ones give a basis."""
    a = [[10**15, 0, 0], [0, 10**15 + 1000, 0], [0, 0, 7]]
    v = null_vectors(a, [10**15 + 1000, 10**15, 7], 0)
    assert np.allclose(np.abs(v), [[0, 1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-15)
    d = np.diag([9, 9, 9, 4, 4, 1]).tolist()
    v = null_vectors(d, [9, 9, 9, 4, 4, 1], 0)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-15) and np.allclose(np.array(d) @ v, v * [9, 9, 9, 4, 4, 1], atol=1e-14)


def plain(rows, k=8):
    """rows: vectors that take part; x, n, exact deviations, eigenvalues, projections without a sign."""
    x = [[math.floor(float(c) * 1024) + 100_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    return deviation, e[:k] / e.sum(), centred @ vectors[:, :k] / np.sqrt(e[:k])


def check(got, ids, rows, tolerance=1e-6):
    deviation, explained, white = plain(rows)
    k = len(explained)
    assert len(got) == len(rows) * k
    table = got.sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort(ids, kind="stable")
    assert table.component.tolist() == list(range(1, k + 1)) * len(rows)
    assert set(table.n) == {len(rows)}
    assert table.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == [deviation[i] for i in order]
    assert np.allclose(table.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9)
    w = table.whitened.to_numpy().reshape(-1, k)
    signs = np.sign((w * white[order]).sum(axis=0))
    assert np.allclose(w * signs, white[order], atol=tolerance)
    assert table.identity_error.nunique() == 1 and table.identity_error.iloc[0] < 1e-9


def test_given_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
        check(driver.queries()["op13_exact_whitening"](spark, f"/root/testdata/{sf}").toPandas(), rows.vec_id.to_numpy(), rows.embedding.tolist())


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(size=5) * [5, 3, 2, 1, .5]]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("-inf")] * 5), (105, [1.0] * 4)]
    more = [(41, [0.0] * 5), (42, [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in good + odd + more], "vec_id bigint, embedding array<float>, n int, w string")
    check(whiten(table).toPandas(), np.array([i for i, _ in good + more]), [v for _, v in good + more])
    again = spark.createDataFrame([(i, v) for i, v in good] * 3 + [(None, [1.0] * 5)], "vec_id bigint, embedding array<float>")
    got = whiten(again, 2).collect()
    assert len(got) == 121 * 2 and sum(r.vec_id is None for r in got) == 2


def test_degenerate(spark):
    one = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], one)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], one)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, one)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # rank 1
    got = whiten(spark.createDataFrame(flat, one)).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1) and got.identity_error.max() < 1e-12
    corners = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2)]) for i in range(8)]  # one root, three times
    got = whiten(spark.createDataFrame(corners, one)).toPandas()
    assert len(got) == 24 and np.allclose(got.explained, 1 / 3) and got.identity_error.max() < 1e-12


def test_large_entries(spark):
    """Exact beyond 63 bits, and at the edge of the range."""
    rows = [(i, [1e12 * i, 3.0 * i * i, 1e300 if i == 3 else -1e5]) for i in range(7)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    edge = 2**63 - 1
    x = [[min(math.floor(Fraction(c) * 1024) + 100_000, edge) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = [sum((7 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    n, got_sums, products = scatter(table.selectExpr("embedding as v"), 3)
    assert n == 7 and [s + 700_000 for s in got_sums] == sums
    assert products[0][2] == sum((a - 100_000) * (c - 100_000) for a, _, c in x)
    got = whiten(table).collect()
    assert all(r.deviation is None and r.deviation_text == str(far[r.vec_id]) for r in got)
    assert {r.component for r in got} == {1, 2, 3}
    assert got[0].identity_error < 1e-4
