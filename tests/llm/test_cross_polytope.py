import numpy as np

import __spark_entry__ as driver
from gatewright.llm.cross_polytope import hadamard, search


def brute(rows, k, is_query):
    out = {}
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q in {i for i, _ in good if is_query(i)}:
        vector = min(v for i, v in good if i == q)
        best = {}
        for i, v in good:
            if i != q:
                total = 0.0
                for a, b in zip(vector, v, strict=True):
                    total += a * b
                best[i] = max(best.get(i, -9e99), total)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, n + 1): (i, s) for n, (i, s) in enumerate(ranked)}
    return out


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(hadamard(x), x @ h / 4)


def test_exact_with_all_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=5) * rng.uniform(.1, 3)]) for i in range(70)]
    rows += [(100 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(4, rows[4][1]), (5, rows[9][1]), (201, None), (202, []), (203, [0.0] * 5), (204, [1.0, None, 1.0, 1.0, 1.0]),
             (205, [float("nan")] * 5), (210, [float("inf")] * 5), (None, [1.0] * 5), (220, [1.0] * 4), (-40, [2.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, bucket int, v int")
    for k, group in ((6, 4), (500, 512)):
        got = search(table, lambda i: i % 20 == 0, k, tables=2, probes=64, group_rows=group, query_rows=2).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == brute(rows, k, lambda i: i % 20 == 0)
        assert len(got) == len(set((r.query_id, r["rank"]) for r in got))


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert search(table, lambda i: i % 20 == 0).collect() == []


def test_recall(spark):
    """At least 0.9 of the exact neighbours, on the whole tables."""
    for size in ("0.01", "0.1"):
        folder = f"/root/testdata/sf{size}"
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
        x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
        got = driver.queries()["op7_cross_polytope"](spark, folder).toPandas()
        asked = np.flatnonzero(ids % 20 == 0)
        assert len(got) == 20 * len(asked)
        found = got.groupby("query_id").vec_id.apply(set)
        hits = 0
        for at in asked:
            s = x @ x[at]
            s[at] = -9
            hits += len(found[ids[at]] & set(ids[np.argsort(-s)[:20]].tolist()))
        assert hits / len(got) > .9
