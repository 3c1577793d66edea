import itertools
import re
from random import Random

from pyspark.sql import functions as F

from gatewright.llm.chat_format import BETWEEN, CLOSE, CONTROLS, OPEN, escape, format_chat, learned_text, read_chat, unescape


def plain(text):
    """One backslash more after the first character of each control string."""
    rests = "|".join(re.escape(c[1:]) for c in CONTROLS)
    return re.sub(rf"([<\[])(\\*)({rests})", lambda m: m[1] + "\\" + m[2] + m[3], text)


def plain_format(turns):
    """turns: (turn, role, text), in any order."""
    turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    out = ""
    spans = []
    for role, block in itertools.groupby(turns, key=lambda t: t[2]):
        out += OPEN + plain(role).replace("\\", "\\b").replace("\n", "\\n") + "\n"
        for n, (*_, text) in enumerate(block):
            out += BETWEEN if n else ""
            if role == "assistant":
                spans.append((len(out), len(plain(text))))
            out += plain(text)
        out += CLOSE + "\n"
    return out, spans, [t[2:] for t in turns]


PIECES = [*CONTROLS, *(c[0] + "\\" + c[1:] for c in CONTROLS), "\\", "\n", "<", "[", "<|", "|>", "é", "😀", "a b", "", "/s>", "\\n", "\\b", "SYS>>"]


def test_escapes_are_reversible(spark):
    rng = Random(5)
    texts = [("".join(rng.choices(PIECES, k=rng.randrange(9))),) for _ in range(3000)]
    got = spark.createDataFrame(texts, "text string").select("text", escape(F.col("text")).alias("out")).withColumn("back", unescape(F.col("out"))).collect()
    for r in got:
        assert r.out == plain(r.text) and r.back == r.text
        assert not any(c in r.out for c in CONTROLS)


def test_against_plain_version(spark):
    rng = Random(8)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(1, 9)):
            text = None if rng.random() < .1 else "".join(rng.choices(PIECES, k=rng.randrange(6)))
            rows.append((conv, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "assistant", "a\\n<|im_end|>\n"]), text))
    rows += [(70, 1, "assistant", "word " * 200_000), (70, 0, "user", None), (71, 0, None, None)] + [(72, 1, "assistant", "again")] * 3
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int, said string")
    found = format_chat(table).withColumn("turns", read_chat(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        text, spans, turns = plain_format([x[1:] for x in rows if x[0] == conv])
        assert r.formatted == text
        assert [tuple(s) for s in r.loss] == spans
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
