import math

import numpy as np
import pytest

import __spark_entry__ as driver
from gatewright.llm.toxicity_ftrl import Model, Words, feature_places, features, fit, score, train


def test_plain_ftrl():
    """The vector form against FTRL-proximal coordinate by coordinate."""
    from gatewright.llm.toxicity_ftrl import ALPHA, BETA, L1, L2

    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.random() < .3)) for _ in range(900)]
    ones = sum(y for _, y in rows)
    start = math.log((ones + 1) / (len(rows) - ones + 2))
    z, n, bz, bn = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= L1 else -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)
    for _ in range(2):
        for x, y in rows:
            w = {i: weight(i) for i in x.tolist()}
            b = start - bz / ((BETA + math.sqrt(bn)) / ALPHA)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / ALPHA * w[i]
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * (b - start)
            bn += g * g
    got = train(rows, 2)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert got.places.tolist() == list(want) and np.allclose(got.weights, list(want.values()))


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "You IDIOT", 0.0, 7), (1, "You IDIOT", 0.0, 7), (2, None, 0.0, 7), (3, "", 0.0, 7), (None, "idiot " * 9000, 0.0, 7), (4, "fine words", 0.0, 7)],
        "doc_id bigint, text string, score double, toxic int",
    )
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (3, 0), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    got = score(docs, fit(docs, labels))
    assert got.columns == ["doc_id", "toxic", "score"] and got.count() == 6
    assert all(0 < r.score < 1 for r in got.collect())
    none = fit(docs, labels.limit(0))
    assert len(none.places) == 0 and all(abs(r.score - 1 / 3) < 1e-9 for r in score(docs, none).collect())
    assert score(docs.limit(0), none).collect() == []
    place = features(*feature_places("idiot", Words()))
    rude = score(docs, Model(place, np.array([9.0]), -3.0)).collect()
    assert sorted(r.score > .5 for r in rude) == [False, False, False, True, True, True]


@pytest.mark.parametrize("size", ["0.1"])
def test_held_out(spark, size):
    folder = f"/root/testdata/sf{size}"
    got = driver.queries()["op3_toxicity_ftrl"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = rows.score[rows.toxic == 1], rows.score[rows.toxic == 0]
    auc = (pos.values[:, None] > neg.values[None, :]).mean()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert auc > .95 and hit / len(pos) > .8 and hit / max(1, (rows.predicted == 1).sum()) > .8
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
