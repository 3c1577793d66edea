import pytest
import regex

import __spark_entry__ as driver
from gatewright.llm.pii import BASE_KINDS, CONTEXT, KINDS, NEAR, find_spans, redact
from tests.llm.brute import pii, sha

CARD, IBAN = "4539 1488 0343 6467", "DE89 3704 0044 0532 0130 00"
TEXTS = [
    None, "", "plain words only", "mail a.b@x.example.com_q@y.org now", "@@a@b a@b. a@b.c.", "x%_y@z.co.uk..",
    f"card {CARD} and 4539 1488 0343 6468, {CARD}", "7" * 30, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 9999.1.1.1.1",
    "call +49 (30) 123-456-78 or +1 2 or ++12345678901) +1.2.3.4", f"bank {IBAN} DE88 3704 0044 0532 0130 00",
    "ü€😀 é@é a@b.de 😀 10.0.0.1 😀", "-" * 5000 + "a@" * 3000, "1 " * 20000 + "x@y.zz", "1" * 20000,
    "0" * 12, "a@b.c" * 400, "5.6." * 3000,
]


def test_brute_force(spark):
    rows = [(i % 5 if i else None, t, f"s{i}") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    for row in find_spans(docs).collect():
        base = [(s.kind, s.start, s.end) for s in row.spans if s.place < BASE_KINDS]
        assert base == pii(row.text), row.text
        assert all(row.text[s.start:s.end] == s.match for s in row.spans)


def test_iban_and_context(spark):
    docs = spark.createDataFrame([(f"bank {IBAN}, 10.0.0.1", ), (f"x {IBAN[:-1]}1", )], "text string")
    first, second = (r.spans for r in find_spans(docs).collect())
    assert [s.kind for s in first] == ["iban", "ip"] and first[0].score > first[1].score
    assert not [s for s in second if s.kind == "iban"]
    shown = redact(docs).collect()[0].redacted
    assert shown == "bank <IBAN>, <IP>"


SAMPLES = {"email": "a@b.de", "ip": "10.0.0.1", "card": CARD, "phone": "+49 30 123 456 78", "iban": IBAN,
           "national_phone": "030/1234 567", "social_security": "078-05-1120"}


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: k.name)
def test_context_words_of_each_kind(spark, kind):
    """A word near raises the score by 0.2 and lets kinds without a check in; far away or inside a word it does not."""
    words = [w for line in CONTEXT[kind.name].values() for w in line.split()]
    match, far = SAMPLES[kind.name], " " + "_" * NEAR + " "
    cases = [(f"{w} {match}", True) for w in words] + [(f"{match}; {w.upper()}.", True) for w in words]
    cases += [(f"{w}{far}{match}{far}{w}", False) for w in words] + [(f"x{w} {match} {w}x", False) for w in words]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    for row in find_spans(rows).collect():
        text, near = cases[row.doc_id]
        score = kind.base + 0.2 * near
        want = [(text.index(match), match, round(score, 6))] if score >= kind.least else []
        assert [(s.start, s.match, round(s.score, 6)) for s in row.spans if s.kind == kind.name] == want, text


def test_scored_kinds_against_plain_version(spark):
    """Bounds of the two patterns, neighbours and long runs."""
    texts = [
        "tel 030 1234567, 0301234567890123456, 030-12-34-56-7 and 00 11", "phone 0.1.2.3.4.5.6.7.8.9 a0301234567 +0301234567",
        "ssn 078-05-1120-1 078-05-1120, 1078-05-1120 SSN078-05-1120 000-00-0000", "tel " + "0" * 30000, "mobile " + "01 " * 8000,
        "ssn " + "111-22-3333 " * 900, "030 1234567 without a word", "téléphone: 01.23.45.67.89 😀 SEGURO 111-22-3333",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = 0
    for row in find_spans(rows).collect():
        for kind in KINDS[BASE_KINDS + 1:]:
            want, last = [], 0
            hits = list(regex.finditer(kind.pattern, row.text))
            for i, m in enumerate(hits):
                until = hits[i + 1].start() if i + 1 < len(hits) else len(row.text)
                near = row.text[max(last, m.start() - NEAR):m.start()] + " " + row.text[m.end():min(until, m.end() + NEAR)]
                said = {w.lower() for w in regex.findall(r"\p{L}+", near)}
                if said & {w for line in CONTEXT[kind.name].values() for w in line.split()}:
                    want.append((m.start(), m.end()))
                last = m.end()
            assert [(s.start, s.end) for s in row.spans if s.kind == kind.name] == want, row.text[:80]
            found += len(want)
    assert found > 5


def test_empty(spark):
    assert find_spans(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query(spark, sf):
    got = {r.doc_id: r for r in driver.queries()["op8_pii"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = pii(row.text)
        assert got[row.doc_id].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        assert [got[row.doc_id][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert len(got[row.doc_id].scores.split(",")) == len(got[row.doc_id].spans.split(","))
