import numpy as np

import __spark_entry__ as driver
from gatewright.llm.language_fusion import (
    UND, declared_language, fit_text, host_of, identify, identify_documents, keep_identified, site_of, strip_markup, suffix_of,
)
from pyspark.sql import functions as F

WORDS = {"xx": "bla blo blu blabla", "yy": "kor kir kar korkir", "zz": "müm mäm möm mim"}


def train(spark):
    rows = [(i, WORDS[k] + " " + WORDS[k][::2], k, f"s{i % 2}") for i, k in enumerate(list(WORDS) * 20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_markup():
    assert strip_markup("<p>a</p><SCRIPT>x<y></script ><style>b{}</style>c &eacute;<br>d").split() == ["a", "c", "é", "d"]
    assert strip_markup("a<script>never closed") == "a" and strip_markup("<" * 50_000).count("<") == 50_000


def test_addresses(spark):
    rows = [("http://u@WWW.a.Co.uk:80/x?y", '<!DOCTYPE x><HTML class="k" LANG=\'EN-gb\'>'), ("ftp://h/", "<html>"), ("nope", None), (None, "")]
    got = spark.createDataFrame(rows, "u string, m string").select(
        host_of(F.col("u")).alias("h"), site_of(host_of(F.col("u"))).alias("s"), suffix_of(host_of(F.col("u"))).alias("x"),
        declared_language(F.col("m")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("www.a.co.uk", "co.uk", "uk", "en"), ("h", "h", None, None), (None,) * 4, (None,) * 4]


def test_rows(spark):
    docs = train(spark)
    model = fit_text(docs)
    assert model.languages == ["xx", "yy", "zz", UND]
    odd = spark.createDataFrame(
        [(1, None, "en", None), (1, None, "en", None), (2, "", None, "s"), (3, "12 !!", "xx", "s"), (None, "bla blo", None, None),
         (5, "kor " * 60_000, "xx", "s1"), (6, "qjwx zvqk jjqz vvxq " * 9, "xx", "s1"), (7, "müm", None, "s0")],
        "doc_id bigint, text string, lang string, source string")
    got = {(r.id, r.language, r.accepted) for r in identify_documents(odd, model).collect()}
    assert got == {(1, UND, False), (2, UND, False), (3, UND, False), (-(1 << 63), "xx", True), (5, "yy", True), (6, UND, False), (7, "zz", True)}
    kept = keep_identified(docs.unionByName(odd).withColumn("id", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "lang", "source", "id"] and kept.count() == docs.count() + 4  # row 6 is learned from here
    assert identify_documents(odd.limit(0), model).collect() == [] and fit_text(odd.limit(0)).languages == [UND]
    assert {r.language for r in identify_documents(odd, fit_text(odd.limit(0))).collect()} == {UND}


def test_evidence_moves_short_texts(spark):
    """Against the same sums in numpy; declarations and hosts decide what the text leaves open."""
    model = fit_text(train(spark))
    rows = [(i, WORDS["xx"], "h.a.b", "d1") for i in range(30)] + [(50 + i, WORDS["yy"], "g.a.b", "d2") for i in range(30)]
    rows += [(90, "bla kor", "h.a.b", "d1"), (91, "bla kor", "g.a.b", "d2"), (92, "bla kor", None, None)]
    got = {r.k: r for r in identify(spark.createDataFrame(rows, "k int, text string, host string, declared string"), model, ["k"]).collect()}
    assert got[90].language == "xx" and got[91].language == "yy"
    logs = np.array([model.evidence(t, False) for _, t, _, _ in rows])
    p = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    overall = (p.sum(0) + .5) / (p.sum() + 2)
    of = lambda f: np.array([f(r) for r in rows])
    site = (p[of(lambda r: r[2] is not None)].sum(0) - p[60] + 20 * overall) / (61 + 20)
    host = (p[of(lambda r: r[2] == "h.a.b")].sum(0) - p[60] + 10 * site) / (30 + 10)
    code = lambda m: np.log((p[m].sum(0) + 5 * m.sum() / p.sum()) / (p.sum(0) + 5))
    total = logs[60] + np.log(host) + code(of(lambda r: r[3] == "d1")) + code(of(lambda r: r[2] is not None))
    want = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    assert abs(got[90].chance - want.max()) < 1e-6


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = driver.queries()["op6_language_fusion"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = got.filter("doc_id IS NOT NULL").join(docs, "doc_id")
    assert got.count() == docs.count() + spark.read.parquet(f"{folder}/pages.parquet").count()
    assert rows.filter("language = lang AND accepted").count() > .97 * docs.count()


def test_every_label_has_a_model(spark):
    """More labels than a fixed table would hold, the last of them rare."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": " ".join(letters[i % 26] + letters[(i // 26 + 7 * j) % 26] + letters[(3 * i + j) % 26] for j in range(6)) for i in range(70)}
    rows = [(100 * n + i, text, name, "s") for n, (name, text) in enumerate(words.items()) for i in range(1 if n > 63 else 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = fit_text(docs)
    assert model.languages == [*words, UND]
    for name, text in words.items():
        assert model.languages[int(np.argmax(model.evidence(text, False)))] == name
    assert keep_identified(docs).count() == len(rows)
