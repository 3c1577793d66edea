"""Scope, enclosing spans, mentions, and text functions against brute force."""

import random

from pyspark.sql import functions as F

from gatewright.functions.text import escape_property, fill, html_escape, relative_path, split_outside, truncate_text
from gatewright.operators.columns import camel, magic_numbers, pascal
from gatewright.operators.enclosing import in_scope, in_scope_same_key
from gatewright.operators.mentions import _tested, candidates, mention_pairs, mentions
from gatewright.operators.metrics import nesting_depth
from gatewright.operators.scope import changed_counts, scope_lines, scope_spans
from gatewright.operators.spans import positioned_tokens
from gatewright.session import stage
from gatewright.sources.diffs import diff_files, diff_to_lines
from gatewright.sources.settings import gate_settings, json_settings, resolve_settings
from gatewright.sources.texts import read_text_files, select_sources, to_lines

CHANGED = "path string, path_key string, line_no int"
SPAN = "path_key string, start_line int, end_line int, no int"


def test_span_scope_null_empty_and_filled(spark):
    rnd = random.Random(5)
    spans = [("hot" if i % 3 == 0 else f"k{i % 5}", s, s + rnd.choice([0, 3, 70, 400]), i)
             for i, s in enumerate(rnd.randrange(1, 600) for _ in range(300))]
    spans += spans[:20]  # duplicates stay duplicates
    lines = [(k, k, rnd.randrange(1, 700)) for k in ("hot", "k1", "k2") for _ in range(6)]
    df = spark.createDataFrame(spans, SPAN)
    changed = spark.createDataFrame(lines, CHANGED)
    keys = {k for k, _, _ in lines}
    want = sorted(s for s in spans if s[0] not in keys or any(k == s[0] and s[1] <= n <= s[2] for k, _, n in lines))
    assert sorted(tuple(r) for r in scope_spans(df, changed).collect()) == want
    assert scope_spans(df, None).count() == len(spans)
    assert scope_spans(df, changed.limit(0)).count() == len(spans)


def test_spans_are_read_few_times(spark):
    """Bounds without order, nulls and spans over several rows of masks; one reading for near spans, three for far ones."""
    spans = [("a", 4000, 4200, 1), ("a", 10, 9, 2), ("a", 1, 20_000, 3), ("a", 5000, 8100, 4), ("a", None, 7, 5), ("z", 9, 1, 6),
             (None, 1, 2, 7), ("z", None, 7, 8), ("b", 63, 64, 9), ("b", 0, 62, 10), ("b", 5000, 5001, 11)]
    df = stage(spark.createDataFrame(spans, SPAN), "spans_read")
    changed = spark.createDataFrame([("a", "a", 4100), ("b", "b", 64), ("a", "a", 8192)], CHANGED)
    kept = scope_spans(df, changed)
    assert sorted(r.no for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    leaves = kept._jdf.queryExecution().analyzed().collectLeaves().mkString("|")
    assert leaves.count("start_line") <= 4


def test_line_scope_null_and_empty(spark):
    found = spark.createDataFrame([("SRC/A.cs", 3), ("src/a.cs", 4), ("src/b.cs", 3)], "target string, line_no int")
    changed = spark.createDataFrame([("src/A.cs", "src/a.cs", 3)], CHANGED)
    assert [tuple(r) for r in scope_lines(found, changed).collect()] == [("SRC/A.cs", 3)]
    assert scope_lines(found, None).count() == 3
    assert scope_lines(found, changed.limit(0)).count() == 0


def test_diff_quirks(spark):
    """Deleted files keep the file before, other suffixes reset it, count 0 is one line."""
    text = ["+++ b/src/A.cs", "@@ -1,2 +5,0 @@ x", "@@ -1 +9 @@", "+++ /dev/null", "@@ -3 +20,2 @@", "+++ b/read.md",
            "@@ -1 +1,9 @@", "+++ b/src/B.CS ", "+@@ -1 +7 @@", "@@ broken @@", "+++ b/src/C.cs"]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(text)], "diff_id long, seq long, line string")
    got = sorted((r.path, r.line_no) for r in diff_to_lines(df).collect())
    assert got == [("src/A.cs", 5), ("src/A.cs", 9), ("src/A.cs", 20), ("src/A.cs", 21)]
    files = diff_files(df)
    counts = {r.path: r.changed_lines for r in changed_counts(files.select("path"), diff_to_lines(df)).collect()}
    assert counts == {"src/A.cs": 4, "src/B.CS": 0, "src/C.cs": 0}


def test_items_in_spans(spark):
    rnd = random.Random(7)
    spans = [(d, s, s + rnd.randrange(1, 300), rnd.choice("ab")) for d in (1, 1, 1, 2) for s in rnd.sample(range(500), 25)]
    items = [(d, p, rnd.choice("ab")) for d in (1, 2) for p in rnd.sample(range(800), 120)]
    s = spark.createDataFrame(spans, "doc int, start_pos int, end_pos int, scope_key string")
    i = spark.createDataFrame(items, "doc int, pos int, item_key string")
    want = sorted((d, p, k, a, b, c) for d, p, k in items for e, a, b, c in spans if d == e and a < p < b)
    got = in_scope(i, s, ["doc"], width=64).select("doc", "pos", "item_key", "start_pos", "end_pos", "scope_key")
    assert sorted(tuple(r) for r in got.collect()) == want
    exempt = s.filter("start_pos < 100")
    freed = {(d, p) for d, p, *_ in [(d, p) for d, p, _ in items for e, a, b, _ in spans if a < 100 and d == e and a < p < b]}
    same = in_scope_same_key(i, s, ["doc"], ("item_key", "scope_key"), exempt.select("doc", "start_pos", "end_pos"), width=64)
    assert sorted((r.doc, r.pos, r.start_pos, r.end_pos) for r in same.collect()) == sorted(
        (d, p, a, b) for d, p, k, a, b, c in want if k == c and (d, p) not in freed)


def test_mentions_are_exact_substrings(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "file1.cs", "é"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(120)]
    needles = {" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 8))) for _ in range(40)}
    needles |= {"e1.cs", "a b", "mma delta eps alpha be", "x", "alpha beta gamma delta eps alpha", ""}
    got = mention_pairs(
        spark.createDataFrame(texts, "id int, text string"), "id", "text",
        spark.createDataFrame([(n,) for n in needles] * 2, "needle string"), "needle")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, n) for i, t in texts for n in needles if n and n in t)


def test_positions_of_tokens(spark):
    text = "<p>é<b>x</b> </p> tail"
    df = positioned_tokens(spark.createDataFrame([(1, text), (2, "none")], "id int, text string"), ["id"], "text", "<[^>]*>")
    assert [(r.tok_no, r.token, r.pos) for r in df.orderBy("tok_no").collect()] == [
        (1, "<p>", 1), (2, "<b>", 5), (3, "</b>", 9), (4, "</p>", 14)]
    deep = nesting_depth(spark.createDataFrame([(text,), ("",), (None,)], "text string"), "text", "<[^>]*>", "^</")
    assert [r.depth for r in deep.collect()] == [2, 0, 0]


def test_lines_of_any_ending(spark):
    out = to_lines(spark.createDataFrame([(1, "a\r\nb\rc\nd"), (2, "")], "id int, text string"), "id", "text").collect()
    assert [(r.id, r.line_no, r.line) for r in out] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "")]


def test_sources_by_path(spark, tmp_path):
    for name in ("a.cs", "b.Designer.cs", "c.txt", "obj/d.cs", "sub/e.CS"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("one\ntwo")
    files = read_text_files(spark, str(tmp_path))
    kept = select_sources(files, "path", [".cs"], ["/obj/"], [".designer.cs"]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept) == ["a.cs", "e.CS"] and kept[0].text == "one\ntwo"


def test_text_functions(spark):
    row = spark.range(1).select(
        escape_property(F.lit("50%: a,\r\nb")).alias("prop"),
        html_escape(F.lit("<a href='x'>\"é&𝄞 ő</a>")).alias("html"),
        truncate_text(F.lit("ééé"), 5, 2, "…", "bytes").alias("bytes"),
        truncate_text(F.lit("ééé"), 3, 2, "…").alias("chars"),
        relative_path(F.lit("/base/a%20b+c.cs"), "/base").alias("rel"),
        relative_path(F.lit("/other/a%20b"), "/base").alias("other"),
        relative_path(F.lit("/base/50%"), "/base").alias("odd"),
        F.array(*[relative_path(F.lit(p), "/base/x/") for p in (
            "/base/x/y", "/base/y", "/base/x", "/base/xy/z", "C:/base/x/y", "y", "/")]).alias("paths"),
        F.array(*[split_outside(F.lit(t)) for t in ("a, b", "M<A<B<C, D>, E>, F> a, (int, int) b = (1, 2), D[,] c, x => x", "", "a<b")]).alias("parts"),
        fill(F.lit("{a} {b} {c} {"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("B"))).alias("filled"),
        F.array(*[pascal(F.lit(n)) for n in ("item_count", "__", "already", "Done", "a__b", "")]).alias("pascal"),
        camel(F.lit("Item_Count")).alias("camel"),
    ).first()
    assert row.prop == "50%25%3A a%2C%0D%0Ab"
    assert row.html == "&lt;a href=&#39;x&#39;&gt;&quot;&#233;&amp;&#119070;&#160;ő&lt;/a&gt;"
    assert (row.bytes, row.chars) == ("éé…", "ééé")
    assert (row.rel, row.other, row.odd) == ("a b+c.cs", "../other/a b", "50%")
    assert row.paths == ["y", "../y", "../x", "../xy/z", "C:/base/x/y", "y", "../../"]
    assert row.parts == [["a", " b"], ["M<A<B<C, D>, E>, F> a", " (int, int) b = (1, 2)", " D[,] c", " x => x"], [], ["a<b"]]
    assert row.filled == "{b} B {c} {"
    assert row.pascal == ["ItemCount", "__", "Already", "Done", "AB", ""] and row.camel == "itemCount"


def test_settings(spark):
    raw = '{ // limits\n "maxmethodlines": 80, "URL": "http://x/*y*/,}", "AdditionalRecipients": ["a@x", "b@x",], "failOnErrors": false, /* end */ }'
    df = spark.createDataFrame([(1, raw), (2, None), (3, "oops"), (4, '{"MaxMethodLines": "many", "maxMethodLines": 7}')], "id int, raw string")
    got = {r.id: r.settings for r in gate_settings(df, "raw").collect()}
    assert (got[1].MaxMethodLines, got[1].FailOnErrors, got[1].AdditionalRecipients) == (80, False, ["a@x", "b@x"])
    assert (got[2].MaxMethodLines, got[3].FailOnErrors, got[4].MaxMethodLines) == (50, True, 7)
    url = json_settings(df, "raw", {"url": "string"}, {"url": "none"}).first().settings.url
    assert url == "http://x/*y*/,}"
    layers = spark.createDataFrame(
        [("a", 1, "  "), ("a", 2, ""), ("a", 3, "file"), ("b", 1, " arg "), ("c", 1, None)], "key string, priority int, value string")
    assert {r.key: r.value for r in resolve_settings(layers).collect()} == {"a": "file", "b": "arg", "c": None}
    assert {r.key: r.value for r in resolve_settings(layers, null_only=[2]).collect()} == {"a": "", "b": "arg", "c": None}


def test_magic_numbers_skip_what_is_no_int(spark):
    df = spark.createDataFrame([("a 0 1 2 100 99999999999 2147483647",)], "t string")
    assert sorted(r.literal for r in magic_numbers(df, "t").collect()) == [2, 2147483647]


def test_mentions_go_by_the_rarest_run(spark):
    """Texts that hold only the frequent runs of a needle are never fetched; the others once for all their needles."""
    common = [(i, f"x one two three four y{i}") for i in range(50)]
    texts = spark.createDataFrame([*common, (100, "a one two three four five six b"), (101, "four five six seven one two")], "id int, text string")
    many = [(f"y{i}",) for i in range(50)] + [("one two three four five six",), ("nowhere one two three else at all",), ("",), (None,)]
    needles = spark.createDataFrame(many, "needle string")
    found = candidates(texts, "id", "text", needles, "needle")
    got = {(r.id, r.needle) for r in found.collect()}
    assert {i for i, n in got if n.startswith("one")} == {100} and not any(n.startswith("nowhere") for _, n in got)
    assert _tested(texts, "id", "text", found).count() == len({i for i, _ in got})
    pairs = {(r.id, r.needle) for r in mention_pairs(texts, "id", "text", needles, "needle").collect()}
    assert pairs == {(i, n) for i, t in [(r.id, r.text) for r in texts.collect()] for (n,) in many if n and n in t}
    assert {r.id for r in mentions(texts, "id", "text", needles, "needle").collect()} == {i for i, _ in pairs}
    assert mentions(texts, "id", "text", needles.limit(0), "needle").count() == 0
