"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds in order: email, ip, card (Luhn), phone, iban (mod-97), national_phone and social_security.
Matches are leftmost and do not overlap within a kind; a match whose check fails is dropped, without
a second try inside it. The last two kinds have no checksum and start below the score they need, so they
are only found with a context word of some language within NEAR characters. Spans of different kinds may overlap.
Only built-in functions are used. A text is split at its matches, and the lengths of pieces
and matches give the places, so texts are read where they are and nothing is shuffled.

Patterns never go back over a run of characters twice: loops are possessive and a match starts
at the start of a run or where the last match ended, so a very long token costs its length.

Rows: a null or empty text has no spans. Repeated rows each get theirs. Other columns are kept
as they are by `find_spans`; the columns that it adds are named in its parameters, and an
existing column of such a name is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap pattern without which there is no match.
    hint: str
    #: Score of a confirmed span, and the score it needs: a kind whose base is below needs a context word.
    base: float
    least: float = 0.0


#: Patterns as agreed, with possessive loops.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.5),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.5),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", 0.7),
    Kind("national_phone", r"(?<![A-Za-z0-9+])0[0-9]{1,4}(?:[\x20/.-]?[0-9]){5,10}(?![A-Za-z0-9])", "0[0-9]", 0.3, 0.5),
    Kind("social_security", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "[0-9]-[0-9]{2}-", 0.3, 0.5),
)
BASE_KINDS = 4

#: Words that make a kind likelier when they stand near, by language.
CONTEXT = {
    "email": {"en": "email mail contact write reply", "de": "kontakt schreiben", "fr": "courriel contacter", "es": "correo contacto"},
    "ip": {"en": "ip host server address login client", "de": "adresse rechner", "fr": "serveur adresse", "es": "servidor"},
    "card": {"en": "card visa mastercard amex credit debit", "de": "karte kreditkarte", "fr": "carte", "es": "tarjeta"},
    "phone": {"en": "phone telephone tel call mobile cell fax", "de": "telefon handy rufnummer", "fr": "téléphone portable", "es": "teléfono móvil"},
    "iban": {"en": "iban account bank transfer", "de": "konto überweisung", "fr": "compte virement", "es": "cuenta transferencia"},
    "social_security": {"en": "ssn social security taxpayer", "de": "sozialversicherung", "fr": "sécurité sociale", "es": "seguro social"},
}
CONTEXT["national_phone"] = CONTEXT["phone"]


def context_pattern(kind: str) -> str:
    """Any context word of a kind, in any language, as a whole word and in any case."""
    words = sorted({w for line in CONTEXT[kind].values() for w in line.split()}, key=len, reverse=True)
    return rf"(?iu)(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})"


#: Characters on either side that are searched for context words, and what such a word adds.
NEAR, BONUS = 40, 0.2

#: `start` and `end` are code points, the end exclusive; `place` is the number of the kind.
SPAN = "struct<start:bigint,place:int,kind:string,end:bigint,match:string,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end and letters as 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda rest, c: F.when(c == "", rest).when(
            c.between("0", "9"), (rest * 10 + c.cast("int")) % 97
        ).otherwise((rest * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match passes the check of its kind."""
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}")
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _spans(text: Column, place: int) -> Column:
    """Confirmed spans of one kind in a text, in order."""
    kind = KINDS[place]
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    # Match i stands between pieces i and i + 1; all three go through the fold together.
    parts = F.arrays_zip(
        matches.alias("match"), pieces.alias("left"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("right")
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, part: Column) -> Column:
        match = part["match"]
        begin = state["at"] + F.length(part["left"])
        end = begin + F.length(match)
        near = F.concat_ws(" ", F.right(part["left"], F.lit(NEAR)), F.left(part["right"], F.lit(NEAR)))
        score = F.lit(kind.base) + F.when(near.rlike(context_pattern(kind.name)), F.lit(BONUS)).otherwise(F.lit(0.0))
        span = F.struct(
            begin.cast("bigint").alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"),
            end.cast("bigint").alias("end"), match.alias("match"), score.alias("score"),
        )
        accepted = match.isNotNull() & confirmed(kind.name, match)
        if kind.base < kind.least:
            accepted = accepted & (score >= kind.least)
        found = F.when(accepted, F.concat(state["found"], F.array(span)))
        return F.struct(
            F.coalesce(end, state["at"]).cast("bigint").alias("at"), F.coalesce(found, state["found"]).alias("found")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    folded = F.aggregate(parts, start, step, lambda state: state["found"])
    return F.when(text.rlike(kind.hint), folded).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with the array `out` of all spans, by start and then kind; null texts have none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(whole, place) for place in range(len(KINDS))])
    return docs.withColumn(out, F.array_sort(found))


def redact(docs: DataFrame, text: str = "text", out: str = "redacted", at_least: float = 0.0) -> DataFrame:
    """`docs` with `out`: the text whose spans of enough score are replaced by <KIND>; null stays null.

    Of spans that overlap the one that starts first stands for both.
    """
    def step(state: Column, span: Column) -> Column:
        use = (span["start"] >= state["at"]) & (span["score"] >= F.lit(at_least))
        before = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        written = F.concat(state["text"], before, F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        return F.struct(
            F.when(use, span["end"]).otherwise(state["at"]).alias("at"),
            F.when(use, written).otherwise(state["text"]).alias("text"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))
    whole = F.aggregate(
        F.col("__spans"), start, step,
        lambda state: F.concat(state["text"], F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(F.col(text)))),
    )
    return find_spans(docs, text, "__spans").withColumn(out, whole).drop("__spans")


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the score of each of `spans` in the same order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["place"] < BASE_KINDS)
    return find_spans(docs).select("doc_id", "spans").select(
        "doc_id", *[count(k.name) for k in KINDS[:BASE_KINDS]],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )
