import random
import re
from collections import Counter

import __spark_entry__ as driver
from gatewright.llm.line_templates import LEAD, LONG, LONG_CHARS, MIN_DOCS, RARE, SHORT_CHARS, drop_templates


def tokens_of(line):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    fields = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    return tuple(fields if 2 * fields.count("<*>") <= len(tokens) else tokens)


def templates(rows, min_docs):
    """{variant: (documents that keep its template, members of its template)} by the rule of the module."""
    docs = {}
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if t := tokens_of(line):
                docs.setdefault(t, set()).add(row[:2])
    groups = {}
    for t, who in docs.items():
        chars = len(" ".join(t))
        if len(who) >= (2 if len(t) >= LONG or chars >= LONG_CHARS else min_docs if chars >= SHORT_CHARS else RARE):
            groups["exact", t] = {t}
    leaves = {}
    for t in docs:
        if len(t) >= LONG:
            leaves.setdefault((len(t), t[:LEAD]), []).append(t)
    for (n, _), ts in leaves.items():
        support = Counter()
        for t in ts:
            for place in enumerate(t):
                support[place] += len(docs[t])
        forms = {}
        for t in ts:
            form = tuple(w if support[i, w] >= min_docs else None for i, w in enumerate(t))
            if len(docs[t]) < min_docs and form.count(None) <= n // 4:
                forms.setdefault(form, set()).add(t)
        for form, members in forms.items():
            if len(set().union(*(docs[t] for t in members))) >= min_docs:
                groups["form", form] = members
    out = {}
    for kind in ("exact", "form"):
        for (k, _), members in groups.items():
            if k == kind:
                who = set().union(*(docs[t] for t in members))
                first = min((d for d, _ in who if d is not None), default=None)
                out |= dict.fromkeys(members, (first, members))
    return out


def brute(rows, min_docs):
    """Texts without recurring lines."""
    known = templates(rows, min_docs)
    out = []
    for d, text in rows:
        gone = lambda line: (t := tokens_of(line)) in known and d != known[t][0]
        out.append((d, None if text is None else "\n".join(x for x in text.split("\n") if not gone(x))))
    return out


def check_nothing_is_lost(rows, got):
    """Every line that is dropped has a line of its template left; a line nothing is like is never dropped."""
    known = templates(rows, MIN_DOCS)
    left = {tokens_of(line) for _, text in got for line in (text or "").split("\n")}
    before = {tokens_of(line) for _, text in rows for line in (text or "").split("\n")}
    for t in before - left:
        assert known[t][1] & left
        assert len(known[t][1]) > 1  # it is one of several variants of a template


def test_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta".split())
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(9), line(12), line(5), "a b", "Page 1 of this book", "1 2 3 4 5", line(8)]
    rows = []
    for i in range(60):
        lines = [line(rng.randrange(0, 12)) for _ in range(3)] + rng.choices(common, k=3)
        words = rng.choice(common[:2]).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(3, len(words))] = rng.choice("one two three four five".split()) + chr(rng.randrange(97, 123))
        lines.append(" ".join(words))
        lines.append(f"Page {rng.randrange(99)} of this book")
        lines.append(f"{rng.randrange(9)} {rng.randrange(9)} 3 4 {rng.randrange(3)}")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", " \r\n\n"])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, rows[4][1]), (None, "only here once or so x y z"), (7, rows[7][1]), (7, common[0]), (93, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "k", "l", 7) for r in rows], "doc_id bigint, text string, n int, leaf string, __lines string, __id int")
    got = drop_templates(docs, count="lost")
    assert got.columns == [*docs.columns, "lost"]
    assert {(r["__lines"], r["__id"], r.n) for r in got.collect()} == {("l", 7, 1)}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, 3), key=str)
    assert drop_templates(docs).columns == docs.columns
    lost = {r.text is None: r.lost for r in got.collect() if r.doc_id == 90}
    assert lost == {True: 0}


def test_empty(spark):
    assert drop_templates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def result(spark, rows):
    return sorted((r.doc_id, r.text) for r in drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_templates_of_one_leaf_keep_a_copy_each(spark):
    a, b = "this is the page about {} by the author", "this is the list of {} for all members"
    rows = [(i, a.format(w)) for i, w in enumerate("red green blue".split(), 1)] + [(i, b.format(w)) for i, w in enumerate("cats dogs birds".split(), 5)]
    got = dict(result(spark, rows))
    assert got[1] == rows[0][1] and got[2] == got[3] == ""
    assert got[5] == rows[3][1] and got[6] == got[7] == ""


def test_a_line_that_nothing_is_like_stays(spark):
    """Each of its tokens stands at its place in other lines, but never together."""
    rows = [(10 + 3 * k + i, f"this is the {line}{i} x{k}{i}") for k, line in enumerate(["a b c d e", "f b g h i", "a j c k i", "f j g d e"]) for i in range(3)]
    rows = [(d, re.sub(r"(\w)\d( x)", r"\1\2", t).replace("0", "p").replace("1", "q").replace("2", "r").replace("3", "s")) for d, t in rows]
    rows += [(9, "this is the a j g h e xpp")]
    assert dict(result(spark, rows))[9] == rows[-1][1]


def test_lengths(spark):
    """Scripts without blanks, short lines and passages in two documents."""
    chinese, passage, short, tiny = "中文" * 39, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), "All rights reserved.", "end"
    got = dict(result(spark, [(i, f"{chinese}\n{short}\n{tiny}") for i in range(6)] + [(i, f"{passage}\nonly {chr(97 + i)}") for i in (20, 21)]))
    assert got[0] == f"{chinese}\n{short}\n{tiny}" and got[5] == tiny
    assert got[20].startswith(passage) and got[21] == "only v"
    many = dict(result(spark, [(i, tiny) for i in range(RARE)]))
    assert many[0] == tiny and many[1] == ""


def test_query(spark):
    for sf in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{sf}"
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        found = driver.queries()["op4_line_templates"](spark, folder).collect()
        got = sorted((r.doc_id, r.text) for r in found)
        assert got == sorted(brute(rows, MIN_DOCS))
        assert sum(r.n_dropped for r in found) > 0
        check_nothing_is_lost(rows, got)
