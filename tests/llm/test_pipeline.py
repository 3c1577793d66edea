"""Each stage on what its predecessor kept, against plain versions, then the whole run."""

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_best_fit import check
from tests.llm.test_line_templates import brute as without_templates


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, work in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = pipeline.stage(work(spark, docs, sf), name)
        kept[name] = docs
        after = docs.collect()
        rows = [(d, r.text) for d, r in before.items()]
        if name != "best_fit_packing":
            assert docs.columns == columns
            now = {r.doc_id: r for r in after}
            assert len(now) == len(after) and set(now) <= set(before)
        if name == "language_id":
            assert len(after) > .97 * len(rows) and all(now[d] == before[d] for d in now)
        elif name == "line_dedup":
            assert {d: r.text for d, r in now.items()} == dict(without_templates(rows, 3))
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            prints = [brute.simhash(t, 3) for _, t in rows]
            group = brute.components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)  # noqa: B023
            least = {}
            for (d, _), g in zip(rows, group, strict=True):
                least[g] = min(d, least.get(g, d))
            assert set(now) == set(least.values()) and all(now[d] == before[d] for d in now)
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(now) == {r[0] for r in brute.decontaminate(rows, items, 10) if not r[2]}
        else:
            check([(d, r.text, r.source) for d, r in before.items()], after, 2048)
    run = pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, kept["best_fit_packing"].collect()))


def test_empty_and_odd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "x " * 50_000, None, "s", None)], docs.schema)
    for source in (docs.limit(0), docs.limit(30).unionByName(odd)):
        rows = source
        for name, work in pipeline.STAGES:
            rows = pipeline.stage(work(spark, rows, sf), name)
        rows.collect()
