"""Facts about source-code texts: statements, scopes and which scopes hold a statement.

No syntax tree is built. A text is cut at `{`, `}` and `;`, braces are paired by
`pair_spans`, and the text before a brace says what the scope is. String contents
and comments are blanked first, keeping line ends, so they cannot look like code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewright.functions.text import split_outside, sql_str
from gatewright.operators.enclosing import enclosing_chains
from gatewright.operators.spans import pair_spans
from gatewright.session import stage

# Forms of literals, comments and scope headers.
_PIECES = r"""[$@]*"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|//[^\n]*|/\*(?s:.*?)\*/|[^"'/$@]+|(?s:.)"""
_FOR_HEAD = r"(\bfor\s*\([^;{}]*);([^;{}]*);"
_LABEL = r"^(?:(?:case\s[^:]*|default)\s*:\s*)+"
_ATTRIBUTE = r"^(?:\[[^\]]*\]\s*)+"
KINDS = [
    ("namespace", r"^namespace\s"),
    ("if", r"^(?:else\s+)?if\s*\("),
    ("else", r"^else$"),
    ("for", r"^for\s*\("),
    ("foreach", r"^(?:await\s+)?foreach\s*\("),
    ("while", r"^while\s*\("),
    ("do", r"^do$"),
    ("switch", r"^switch\s*\("),
    ("try", r"^try$"),
    ("catch", r"^catch(?:\W|$)"),
    ("finally", r"^finally$"),
    ("lock", r"^lock\s*\("),
    ("using", r"^(?:await\s+)?using\s*\("),
    ("lambda", r"=>$|(?:^|\W)delegate\s*(?:\(.*\))?$"),
    ("type", r"^(?:[a-z]+\s+)*(?:class|struct|interface|record|enum)\s+\w"),
    ("accessor", r"^(?:[a-z]+\s+)*(?:get|set|init|add|remove)$"),
    ("init", r"(?:^|\W)new(?:\W|$)|=$|=[^=>]"),
    ("method", r"^[\w<>\[\],.?\s~]*\w\s*(?:<[^()]*>)?\s*\(.*\)\s*(?::\s*(?:base|this)\s*\(.*\))?(?:\s*where\s.*)?$"),
    ("property", r"^[\w<>\[\],.?\s]+\s\w+$"),
]
BRANCH_KINDS = ["if", "else", "while", "for", "foreach", "catch"]
LOOP_KINDS = ["for", "foreach", "while", "do"]


# What the text of a statement must hold for a rule to ask for it; a rule that asks for more needs its texts here.
BRANCH = r"(?:^|\W)(?:if|while|for|foreach|do|case|catch)(?:\W|$)|\?\?=?|&&|\|\||\s\?\s"
DECLARATION = r"^(?:(?:const|static|readonly|public|private|protected|internal|volatile|using)\s+)*([A-Za-z_][\w<>\[\],.?]*)\s+([A-Za-z_]\w*)\s*(?:=[^=>].*)?$"
TERMINAL = r"^(?:return|throw|break|continue)(?:\W|$)"
_ASKED = "|".join([
    r"[.%/]|\+=|=>|\([A-Z]|[=<>] ?\d|^lock|^using|^\w+\s*(?:[-+*&|^]|<<|>>)?=[^=>]",
    r"new|break|return|throw|continue|Async|ThrowIfNull\(| == null| is null",
    r"Query|Execute|Sql|MD5|SHA1|DES|RC2|HtmlString|Redirect|IsLocalUrl|XmlResolver = null|HttpOnly = true", BRANCH,
])
_ASKED_ENDED = r"static|public|async|[\w<>\[\],.?] \w+ ?(?:<[^()]*>)? ?\("  # of statements that end with `;`
_ODD_NAME = r"_|\s[A-Z]\w*\s*(?:=|$)"
NO_LOCALS = ["type", "namespace", "init", "property"]  # scopes that hold no variables directly
OF_SCOPE = ["open_no", "close_no", "depth", "header", "open_line", "kind", "name"]


@dataclass
class CodeFacts:
    """Tables the rules read.

    files: file_id, path, text; code: file_id, path, text with literals blanked;
    segments: the texts cut up; spans: brace pairs with kind and name; scopes: spans with the scope around them;
    asked: statements whose text a rule may ask for (`_ASKED`), with their innermost scope, the scopes that hold their
    variables and fields, and whether they are in a using, lock or if; held: those x enclosing scope, written flat;
    openings: method x scope in it, their depths; params: parameters of methods.
    stmts and inside are `asked` and `held` of all statements, for rules of other texts; written when first read.
    """

    files: DataFrame
    code: DataFrame
    segments: DataFrame
    spans: DataFrame
    scopes: DataFrame
    asked: DataFrame
    held: DataFrame
    openings: DataFrame
    params: DataFrame

    @cached_property
    def _chained(self) -> DataFrame:
        return stage(_chain(self.segments, self.spans, self.files), "chained")

    @property
    def stmts(self) -> DataFrame:
        return self._chained.drop("chain")

    @cached_property
    def inside(self) -> DataFrame:
        return stage(_hold(self._chained), "inside")


def blank_literals(text: str) -> str:
    """SQL: code with comments and the contents of literals taken out, lines kept."""
    return f"""array_join(transform(regexp_extract_all({text}, {sql_str(_PIECES)}, 0), p -> CASE
        WHEN startswith(p, '//') THEN ''
        WHEN startswith(p, '/*') THEN regexp_replace(p, '[^\\\\n]', '')
        WHEN rlike(p, '^@?[$]@?"') THEN '$""'
        WHEN rlike(p, '^@?"') THEN '""'
        WHEN startswith(p, '\\'') AND length(p) > 1 THEN '\\' \\''
        ELSE p END), '')"""


def _segments(code: DataFrame) -> DataFrame:
    """(file_id, seq, line_no, end_line, text, delim, ...): a text cut after each `{`, `}` and `;`.

    The `;` inside a `for (...)` head do not cut. A file is one row, so a window per
    file holds no more than the segments of one text. `copies` counts the segments of one number, more than 1
    where a file_id repeats. `filled_upto` and `filled_before` count segments that are more than a closing brace, with and
    without those of this number. `marked` says that a rule may ask for the text, `odd_name` that it may for a name declared
    before a `;`, `opens` that a scope opens here.
    """
    text = F.regexp_replace("text", _FOR_HEAD, "$1¦$2¦")
    cut = code.select("file_id", F.posexplode(F.regexp_extract_all(text, F.lit(r"[^{};]*[{};]"), F.lit(0))))
    breaks = F.length("col") - F.length(F.replace("col", F.lit("\n"), F.lit("")))
    lead = F.regexp_extract("col", r"^\s*", 0)
    lead_breaks = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    text = F.trim(F.regexp_replace(F.expr("substr(col, 1, length(col) - 1)"), r"\s+", " "))
    has_label = F.col("col").contains("case") | F.col("col").contains("default")
    bare = F.when(has_label, F.regexp_replace(text, _LABEL, "")).otherwise(text)
    text = F.when(F.col("col").contains("["), F.regexp_replace(bare, _ATTRIBUTE, "")).otherwise(bare)
    parts = cut.select(
        "file_id", "pos", breaks.alias("__n"), lead_breaks.alias("__lead"), text.alias("text"), F.right("col", F.lit(1)).alias("delim"),
        (has_label & F.col("col").rlike(r"(?:^|\W)(?:case\s|default\s*:)")).alias("labelled"),
        (has_label & F.col("col").rlike(r"(?:^|\W)default\s*:")).alias("default_label"),
    )
    text, ends = F.col("text"), F.col("delim") == ";"
    full = text != ""
    asked = F.col("labelled") | (full & (text.rlike(_ASKED) | (ends & text.rlike(_ASKED_ENDED))))
    place = W.partitionBy("file_id").orderBy("pos")
    upto, whole = place.rowsBetween(W.unboundedPreceding, 0), place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, same = place.rangeBetween(W.unboundedPreceding, -1), place.rangeBetween(0, 0)
    any_here = lambda c: F.bool_or(c).over(same)
    # Values of names are asked for where a file divides, their types where it has `+=`, what follows where control has left.
    marked = any_here(F.col("__asked")) | (any_here(full) & (
        F.coalesce(F.bool_or("__leaves").over(before), F.lit(False))
        | (F.bool_or("__divides").over(whole) & any_here(text.contains("=")))
        | (F.bool_or("__grows").over(whole) & any_here(text.contains(" ")))))
    filled = full | (F.col("delim") == "{")
    return (
        parts.withColumns({
            "__asked": asked, "__leaves": full & ends & text.rlike(TERMINAL), "__divides": text.contains("/") | text.contains("%"),
            "__grows": text.contains("+="),
        })
        .withColumns({
            "__end": F.sum("__n").over(upto) + 1, "filled_upto": F.count_if(filled).over(place.rangeBetween(W.unboundedPreceding, 0)),
            "filled_before": F.count_if(filled).over(before), "copies": F.count("*").over(same), "marked": marked,
            "opens": any_here(F.col("delim") == "{"),
        })
        .select(
            "file_id", (F.col("pos") + 1).alias("seq"),
            (F.col("__end") - F.col("__n") + F.col("__lead")).cast("int").alias("line_no"),
            F.col("__end").cast("int").alias("end_line"),
            "text", "delim", "labelled", "default_label", "copies", "filled_upto", "filled_before", "marked", "opens",
            (ends & text.rlike(_ODD_NAME)).alias("odd_name"),
        )
    )


def _describe(scopes: DataFrame) -> DataFrame:
    header = F.col("header")
    kind = F.lit("block")
    for name, pattern in reversed(KINDS):
        kind = F.when(header.rlike(pattern), name).otherwise(kind)
    type_name = F.regexp_extract(header, r"(?:class|struct|interface|record|enum)\s+(\w+)", 1)
    method_name = F.regexp_extract(header, r"(~?\w+)\s*(?:<[^()]*>)?\s*\(", 1)
    last_word = F.regexp_extract(header, r"(\w+)$", 1)
    own = F.regexp_replace(header, r"\)\s*(?::\s*(?:base|this)\s*\(|where\s).*$", ")")
    return (
        scopes.withColumn("kind", kind)
        .withColumn(
            "name",
            F.when(F.col("kind") == "type", type_name).when(F.col("kind") == "method", method_name)
            .when(F.col("kind") == "property", last_word).otherwise(""),
        )
        .withColumn("head_args", F.when(F.col("kind") == "method", F.regexp_extract(own, r"\((.*)\)", 1)).otherwise(""))
        .withColumn("scope_id", F.concat_ws(":", "file_id", "open_no"))
    )


def _params(scopes: DataFrame) -> DataFrame:
    """(scope_id, file_id, open_no, line, method, header, idx, modifier, type, name): parameters of methods."""
    rows = scopes.filter((F.col("kind") == "method") & (F.trim("head_args") != "")).select(
        "scope_id", "file_id", "path", "open_no", "open_line", "close_line", "p_kind", "p_name",
        F.col("name").alias("method"), "header", F.posexplode(split_outside(F.col("head_args"))).alias("idx", "raw"),
    )
    raw = F.trim(F.regexp_replace("raw", r"(?s)(?<![=!<>])=(?![=>]).*$", ""))  # without a default value
    form = r"^(?:(in|ref|out|params|this)\s+)?(.+?)\s+(\w+)$"
    return rows.select(
        *[c for c in rows.columns if c != "raw"],
        F.regexp_extract(raw, form, 1).alias("modifier"),
        F.regexp_extract(raw, form, 2).alias("type"),
        F.regexp_extract(raw, form, 3).alias("param"),
    )


def _scope_id(open_no: str) -> Column:
    return F.when(F.col(open_no).isNotNull(), F.concat_ws(":", "file_id", open_no))


def _chain(segs: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with their enclosing scopes, outermost first, found once and kept in their row; once for each copy of a repeated file_id."""
    laid = enclosing_chains(segs, spans.select("file_id", *OF_SCOPE), ["file_id"], pos="seq", start="open_no", end="close_no")
    repeated = F.when(F.col("copies") > 1, F.sort_array(F.flatten(F.array_repeat("chain", F.col("copies").cast("int"))))).otherwise(F.col("chain"))
    held_by = lambda *kinds: F.try_element_at(F.filter("chain", lambda c: c["kind"].isin(*kinds)), F.lit(-1))["open_no"]
    in_kind = lambda kind: F.coalesce(F.exists("chain", lambda c: c["kind"] == kind), F.lit(False))
    return (
        laid.withColumn("chain", repeated)
        .join(files.select("file_id", "path"), "file_id")
        .withColumns({"p": F.element_at("chain", -1), "var_open": held_by("method", "accessor"), "type_open": held_by("type")})
        .select(
            "file_id", "seq", "line_no", "end_line", "text", "delim", "labelled", "default_label", "marked", "odd_name", "opens", "path",
            F.col("p.open_no").alias("p_open"), F.col("p.kind").alias("p_kind"),
            F.col("p.name").alias("p_name"), F.col("p.header").alias("p_header"), _scope_id("p.open_no").alias("p_scope"),
            # The nearest method or accessor holds a statement's variables, the nearest type its fields.
            _scope_id("var_open").alias("var_scope"), _scope_id("type_open").alias("type_scope"),
            in_kind("using").alias("in_using"), in_kind("lock").alias("in_lock"), in_kind("if").alias("in_if"), "chain",
        )
    )


def _hold(chained: DataFrame) -> DataFrame:
    """Statement x enclosing scope, flat, so that a rule reads the columns it asks for."""
    own = ["file_id", "path", "seq", "line_no", "text", "delim", "labelled", "default_label", "p_kind", "in_lock"]
    held = chained.select(*own, F.explode("chain").alias("s"))
    return held.select(*own, *[F.col(f"s.{c}").alias(c) for c in OF_SCOPE if c != "close_no"], _scope_id("s.open_no").alias("scope_id"))


def code_facts(files: DataFrame) -> CodeFacts:
    """Work out the facts of (file_id, path, text) once and store them for the rules."""
    code = stage(files.select("file_id", "path", F.expr(blank_literals("text")).alias("text")), "code")
    segs = stage(_segments(code), "segments")
    braces = segs.filter(F.col("delim") != ";")
    delta = F.when(F.col("delim") == "{", 1).otherwise(-1)
    paired = pair_spans(
        braces, ["file_id"], delta, order="seq", keep=["text", "line_no", "end_line", "filled_upto", "filled_before"]
    ).select(
        "file_id", F.col("open_no").cast("bigint").alias("open_no"), F.col("close_no").cast("bigint").alias("close_no"),
        "depth", F.col("open_text").alias("header"), F.col("open_line_no").alias("open_line"),
        F.col("close_end_line").alias("close_line"), (F.col("close_filled_before") > F.col("open_filled_upto")).alias("filled"),
    )
    described = _describe(paired.join(files.select("file_id", "path"), "file_id"))
    spans = stage(described, "spans")
    chained = stage(_chain(segs.filter(F.col("opens") | F.col("marked") | F.col("odd_name")), spans, files), "chained")
    declares = ((F.col("p_kind") == "type") & (F.col("delim") == ";")) | ~F.col("p_kind").isin(NO_LOCALS)
    asked = stage(chained.filter(F.col("marked") | (declares & F.col("text").rlike(_ODD_NAME))), "stmts")
    scopes = stage(
        spans.join(
            chained.filter("opens").select("file_id", F.col("seq").alias("open_no"), "p_open", "p_kind", "p_name", "p_scope"),
            ["file_id", "open_no"],
        ),
        "scopes",
    )
    methods = F.filter("chain", lambda c: c["kind"] == "method")
    openings = chained.filter("opens").select("file_id", "seq", F.explode(methods).alias("s")).select(
        "file_id", "seq", _scope_id("s.open_no").alias("scope_id"), F.col("s.depth").alias("depth"))
    return CodeFacts(files, code, segs, spans, scopes, asked.drop("chain"), stage(_hold(asked), "held"), openings, stage(_params(scopes), "params"))
