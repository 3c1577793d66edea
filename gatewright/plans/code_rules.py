"""The 72 rules over source-code texts, each built from facts and one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.catalogue.rules import OFF_BY_ONE, OFF_BY_ONE_LINE, RULE_NAME, RULE_SEVERITY, RULES, SCAN_RULES
from gatewright.functions.text import split_outside, sql_lookup
from gatewright.operators.columns import camel, chain_depth, identical, magic_numbers, pascal
from gatewright.operators.groups import (
    after_terminal, extras, layer_boundary, missing_member, presence_xor, repeat_use,
    token_not_passed, unguarded,
)
from gatewright.operators.lookups import classify, latest_before, resolve_chain
from gatewright.operators.metrics import child_count, grade, policy
from gatewright.operators.scan import has_any, one_pass, per_match, scan_texts
from gatewright.operators.scope import scope_lines, scope_spans
from gatewright.plans.code_facts import BRANCH, BRANCH_KINDS, DECLARATION, LOOP_KINDS, NO_LOCALS, TERMINAL, CodeFacts
from gatewright.reporting.findings import categorise
from gatewright.schema import as_findings, seq_of
from gatewright.session import stage

C = F.col
_ORDER = {rule[0]: i for i, rule in enumerate(RULES)}
# Rules whose line test is replaced by a test on statements and scopes.
_BY_FACTS = {"SAF015", "ARCH009", "ARCH010"}
_ON_LITERALS = {"SEC002"}

# Names and types the rules look for.
DISPOSABLE = ["SqlConnection", "HttpClient", "FileStream", "MemoryStream", "StreamReader", "StreamWriter",
              "DbContext", "Socket", "TcpClient", "SqlCommand"]
SQL_CALLS = ["ExecuteNonQuery", "ExecuteReader", "ExecuteScalar", "FromSqlRaw", "SqlCommand", "Query",
             "QueryAsync", "Execute", "ExecuteAsync", "SqlDataAdapter"]
WEAK_CRYPTO = ["MD5", "SHA1", "DES", "RC2", "TripleDES"]
HTML_SINKS = ["Response.Write", "Response.WriteAsync", "HtmlString", "Html.Raw"]
FILE_CALLS = r"(?:File\.(?:Open|ReadAllText|WriteAllText|ReadAllBytes|Delete)|Directory\.Delete)"
SENSITIVE = "token|password|key|auth|salt|otp"
VALUE_TYPES = ["int", "long", "short", "byte", "float", "double", "decimal", "bool", "char", "Guid", "DateTime", "TimeSpan"]
NUMERIC_TYPES = ["int", "long", "double", "float", "decimal", "byte", "short", "uint", "ulong", "ushort", "sbyte",
                 "nint", "nuint", "Int32", "Int64", "Double", "Single", "Decimal"]
NUMERIC_NAMES = ["total", "sum", "count", "i", "j", "k", "idx", "index", "amount", "balance", "score", "result",
                 "val", "value", "num", "number"]
TEXT_NAMES = ["str", "text", "msg", "message", "output", "content", "body", "html", "xml", "json", "csv", "sql", "query"]
ZEROS = ["0", "0.0", "0f", "0m", "0d", "0L", "0D"]
PRESENTATION = r"Microsoft\.AspNetCore|System\.Web|Controllers|Views"
INNER_LAYER = r"/(?:Domain|Entities|Core)/"
COGNITIVE = r"(?:^|\W)(?:if|while|for|foreach|catch)(?:\W|$)|\s\?\s"
LOGICAL = r"&&|\|\|"
PARALLEL = r"Parallel\.For(?:Each)?\s*\("
CHAIN = r"[A-Za-z_]\w*(?:\([^()]*\))?(?:\??\.[A-Za-z_]\w*(?:\([^()]*\))?)+"
NOT_TYPES = ["return", "throw", "new", "await", "else", "goto", "using", "namespace", "case", "break", "continue", "in", "yield"]


SLIM = ["file_id", "path", "line_no", "rule_id", "member", "end_line_no", "actual", "threshold", "severity", "vars"]
PLACE = ["file_id", "path", "line_no"]


def hit(df: DataFrame, rule_id: str | None, member: Column | None = None, actual: Column | None = None,
        vars: Column | None = None) -> DataFrame:
    """Hits of one rule, still without the texts every finding gets at the end.

    `df` has file_id, path and line_no, and for `rule_id` None also rule_id and member.
    """
    none = "cast(null as {}) as {}"
    return df.select(
        *PLACE,
        C("rule_id") if rule_id is None else F.lit(rule_id).alias("rule_id"),
        C("member") if member is None else member.cast("string").alias("member"),
        F.expr(none.format("int", "end_line_no")),
        F.expr(none.format("int", "actual")) if actual is None else actual.cast("int").alias("actual"),
        F.expr(none.format("int", "threshold")), F.expr(none.format("string", "severity")),
        F.expr(none.format("map<string,string>", "vars")) if vars is None else vars.alias("vars"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by halves, so that a long list stays a shallow plan."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return union_all(frames[:half]).union(union_all(frames[half:]))


def _is(pattern: str, col: str = "text") -> Column:
    return C(col).rlike(pattern)


def _within(facts: CodeFacts, *kinds: str) -> DataFrame:
    return facts.held.filter(C("kind").isin(*kinds))


def _methods(facts: CodeFacts) -> DataFrame:
    return facts.scopes.filter(C("kind") == "method").withColumn("line_no", C("open_line"))


def _types(facts: CodeFacts) -> DataFrame:
    return facts.scopes.filter(C("kind") == "type").withColumn("line_no", C("open_line"))


def _fields(facts: CodeFacts) -> DataFrame:
    """(…, type, name) of statements directly in a type that declare a field."""
    return facts.asked.filter(
        (C("p_kind") == "type") & (C("delim") == ";") & _is(DECLARATION) & ~C("p_header").rlike(r"(?:^|\s)enum\s")
    ).withColumns({"type": F.regexp_extract("text", DECLARATION, 1), "name": F.regexp_extract("text", DECLARATION, 2)})


def _locals(stmts: DataFrame) -> DataFrame:
    return stmts.filter(
        C("p_kind").isNotNull() & ~C("p_kind").isin(NO_LOCALS) & _is(DECLARATION)
        & (C("delim") != "}")
    ).withColumns(
        {"type": F.regexp_extract("text", DECLARATION, 1), "name": F.regexp_extract("text", DECLARATION, 2)}
    ).filter(~C("type").isin(NOT_TYPES))


def structure_rules(facts: CodeFacts, limits: DataFrame | None = None) -> list[DataFrame]:
    methods, types = _methods(facts), _types(facts)
    in_method = _within(facts, "method")
    is_ctor = C("name") == C("p_name")
    is_class = C("header").rlike(r"(?:^|\s)class\s")

    # Branches and reading effort of a method come from one aggregate over its statements that branch, depth from the scopes in it.
    around = _within(facts, *BRANCH_KINDS).groupBy("file_id", "seq").agg(F.count("*").alias("around"))
    inner = facts.scopes.select("file_id", C("open_no").alias("seq"), C("depth").alias("inner_depth"))
    weight = F.coalesce("around", F.lit(0)) + 1
    counted = in_method.filter(_is(BRANCH)).select(
        "file_id", "seq", "scope_id", F.regexp_count("text", F.lit(BRANCH)).alias("branches"),
        F.regexp_count("text", F.lit(COGNITIVE)).alias("hard"), F.regexp_count("text", F.lit(LOGICAL)).alias("logical"))
    body = (
        counted.join(around, ["file_id", "seq"], "left").join(inner.drop("inner_depth"), ["file_id", "seq"], "left")
        .groupBy("scope_id")
        .agg(F.sum("branches").alias("branches"), F.sum(C("hard") * weight + C("logical")).alias("effort"))
    )
    depths = facts.openings.join(inner, ["file_id", "seq"]).groupBy("scope_id").agg(
        F.max(C("inner_depth") - C("depth")).cast("int").alias("nested"))
    of_body = lambda value: F.when(C("close_no") - C("open_no") > 1, F.coalesce(value, F.lit(0)))  # noqa: E731  null without statements
    takes = facts.params.groupBy("scope_id").agg(F.count("*").cast("int").alias("takes"))
    lines = C("close_line") - C("open_line") + 1

    def row(rule_id: str, actual: Column) -> Column:
        return F.struct(F.lit(rule_id).alias("rule_id"), actual.cast("int").alias("actual"))

    keep = [*PLACE, "close_line", "name"]
    of_methods = methods.join(body, "scope_id", "left").join(depths, "scope_id", "left").join(takes, "scope_id", "left").select(
        *keep, F.inline(F.array_compact(F.array(
            row("CQ001", lines), row("CQ002", of_body(C("branches")) + 1), row("CQ004", C("nested")), row("CQ007", of_body(C("effort"))),
            row("CQ003", C("takes")), F.when(is_ctor, row("CQ006", C("takes"))),
        ))),
    )
    bases = F.regexp_extract("header", r":\s*(.*?)(?:\s+where\s.*)?$", 1)
    of_types = types.filter(is_class).select(
        *keep, F.inline(F.array(
            row("CQ005", lines), row("CQ008", F.when(bases != "", F.size(split_outside(bases)))),
        )),
    )
    plain = methods.filter((C("p_kind") == "type") & ~is_ctor & ~C("name").startswith("~"))
    bloated = child_count(types.filter(is_class), plain, "scope_id", "p_scope", 20, None).select(
        *keep, F.lit("CQ009").alias("rule_id"), "actual")
    limits = policy(facts.files.sparkSession) if limits is None else limits
    graded = grade(of_methods.unionByName(of_types).unionByName(bloated), limits)
    structure = graded.select(
        *PLACE, "rule_id", C("name").alias("member"), C("close_line").alias("end_line_no"), "actual", "threshold", "severity",
        F.expr("cast(null as map<string,string>) as vars"),
    )
    labels = _within(facts, "switch").filter("labelled")
    no_default = missing_member(labels, ["scope_id"], C("default_label"))
    switches = facts.scopes.filter(C("kind") == "switch").withColumn("line_no", C("open_line"))
    return [structure, hit(switches.join(no_default, "scope_id", "left_semi"), "CQ010", F.lit("switch"))]


def safety_rules(facts: CodeFacts) -> list[DataFrame]:
    stmts = facts.asked
    in_method = _within(facts, "method")
    out = []

    dots = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))  # a chain has three
    chains = stmts.filter((dots >= 3) & ~_is(r"^(?:using|namespace)\s")).withColumn(
        "chain", F.explode(F.regexp_extract_all("text", F.lit(CHAIN), F.lit(0)))
    )
    out.append(hit(chain_depth(chains, "chain", 3, ["System.", "Microsoft."]), "SAF001", C("chain")))
    out.append(_zero_division(facts))

    made = stmts.filter(~C("in_using") & has_any("text", DISPOSABLE, rf"new\s+[\w.]*(?:{'|'.join(DISPOSABLE)})") & ~_is(r"^(?:await\s+)?using\W"))
    out.append(hit(made, "SAF003", F.regexp_extract("text", r"new\s+([\w.]+)", 1)))
    catches = facts.scopes.filter(C("kind") == "catch").withColumn("line_no", C("open_line"))
    out.append(hit(catches.filter(~C("filled")), "SAF005", C("header")))

    plain = stmts.filter((C("text") != "") & C("p_kind").isNotNull() & ~C("p_kind").isin("switch", "type", "namespace", "init")).select(
        *PLACE, "p_scope", "seq", "text", "delim")
    dead = after_terminal(
        plain, ["p_scope"], ["seq"], _is(TERMINAL) & (C("delim") == ";")
    )
    out.append(hit(dead, "SAF006", C("text")))

    # Reference parameters of public methods that are used without a null test.
    watched = facts.params.filter(
        C("header").rlike(r"(?:^|\s)public\s") & ~C("type").isin([*VALUE_TYPES, "string"]) & ~C("type").endswith("?")
    ).select("scope_id", "param", C("open_line").alias("line_no"), "path", "file_id", "method")
    body = in_method.filter(has_any("text", [".", "ThrowIfNull(", " == null", " is null"])).select("scope_id", "text")
    named = watched.join(body, "scope_id").filter(F.contains("text", "param"))
    uses = named.filter(F.expr(r"rlike(text, concat('(?:^|[^\\w.])', param, '[.]'))"))
    tested = named.filter(
        F.expr("contains(text, concat('ThrowIfNull(', param, ')')) OR contains(text, concat(param, ' == null')) "
               "OR contains(text, concat(param, ' is null'))")
    )
    bare = unguarded(uses.drop("text").distinct(), tested, ["scope_id", "param"])
    out.append(hit(bare, "SAF008", F.concat("method", F.lit("("), "param", F.lit(")"))))

    endless = facts.scopes.filter((C("kind") == "while") & C("header").rlike(r"^while\s*\(\s*true\s*\)$")).withColumn(
        "line_no", C("open_line"))
    exits = _within(facts, "while").filter(_is(r"(?:^|\W)(?:break|return|throw)(?:\W|$)"))
    out.append(hit(unguarded(endless, exits, ["scope_id"]), "SAF009", F.lit("while(true)")))

    sides = stmts.filter(C("text").contains("??")).withColumns({
        "left_side": F.regexp_extract("text", r"([\w.]+)\s*\?\?\s*[\w.]+", 1),
        "right_side": F.regexp_extract("text", r"[\w.]+\s*\?\?\s*([\w.]+)", 1),
    }).filter(C("left_side") != "")
    out.append(hit(identical(sides, "left_side", "right_side"), "SAF011", C("left_side")))

    members = _methods(facts).filter((C("p_kind") == "type") & C("header").rlike(r"(?:^|\s)override\s"))
    lopsided = presence_xor(
        members, ["p_scope"], C("name") == "Equals", C("name") == "GetHashCode", "Equals(object)", "GetHashCode()"
    )
    out.append(hit(
        _types(facts).join(lopsided.withColumnRenamed("p_scope", "scope_id"), "scope_id"), "SAF014", C("name"),
        vars=F.create_map(F.lit("missing"), C("missing")),
    ))
    cast_rule = next(r for r in SCAN_RULES if r["rule_id"] == "SAF015")
    casts = stmts.filter(~C("in_if") & F.concat("text", F.lit(";")).rlike(cast_rule["pattern"]) & ~F.concat("text", F.lit(";")).rlike(cast_rule["unless"]))
    out.append(hit(casts, "SAF015", C("text")))
    return out


def _zero_division(facts: CodeFacts) -> DataFrame:
    """Divisors that are 0, or name a variable whose value leads to 0.

    An assignment of a name refers to the latest earlier assignment of that name in its
    method, so assignments form chains; a name without one takes its field's initial
    value. A divisor takes the end of the chain of its latest earlier assignment.
    """
    assign = r"(?:^|[\s(])(\w+)\s*=\s*([^=].*)$"
    is_name = r"^[A-Za-z_]\w*$"
    # Without a method or accessor around a statement only fields count.
    placed = facts.asked.select(*PLACE, "seq", "text", C("var_scope").alias("scope_id"), "type_scope")
    divides = placed.filter(_is(r"[/%]"))
    # Chains stay in a scope, so only scopes that divide need theirs.
    dividing = divides.filter(C("scope_id").isNotNull()).select("scope_id").distinct()
    # Signs and brackets around a whole value say nothing about it being 0; inside they do.
    value = F.trim(F.regexp_replace(F.regexp_extract("text", assign, 2), r"^[\s(+\-]+(?=[\w.]+[\s)]*$)|[\s)]+$", ""))
    assigns = stage(placed.filter(C("scope_id").isNotNull() & _is(assign)).join(dividing, "scope_id", "left_semi").select(
        "scope_id", "type_scope", F.regexp_extract("text", assign, 1).alias("var"), "seq", value.alias("assigned"),
    ).withColumn("node", F.concat_ws("#", "scope_id", "seq", "var")), "assigns")
    first = F.trim(F.regexp_replace(F.regexp_extract("text", r"=\s*(.*)$", 1), r"^[\s(+\-]+(?=[\w.]+[\s)]*$)|[\s)]+$", ""))
    initial = _fields(facts).filter(_is("=")).groupBy(C("p_scope").alias("type_scope"), C("name").alias("var")).agg(
        F.min_by(first, "seq").alias("initial"))
    nodes = assigns.select("scope_id", "var", "seq", "node")
    by_name = assigns.filter(_is(is_name, "assigned")).select(
        "scope_id", "type_scope", C("assigned").alias("var"), "seq", C("node").alias("origin"))
    linked = latest_before(by_name, nodes, ["scope_id", "var"], "seq", "node", None, "ref").join(
        initial, ["type_scope", "var"], "left").select("origin", "ref", "initial")
    chain = assigns.join(linked, C("node") == C("origin"), "left").select(
        "node", "ref", F.coalesce("initial", "assigned").alias("literal"))
    values = resolve_chain(chain, "node", "ref", "literal").select(C("key").alias("node"), "value")

    uses = divides.withColumn(
        "var", F.explode(F.regexp_extract_all("text", F.lit(r"[/%]=?\s*[(\-]*(\w+(?:\.\d+)?)"), F.lit(1)))
    ).drop("text")
    found = (
        latest_before(uses, nodes, ["scope_id", "var"], "seq", "node", None, "node")
        .join(values, "node", "left").join(initial, ["type_scope", "var"], "left")
    )
    divisor = F.when(C("var").rlike(r"^\d"), C("var")).otherwise(F.coalesce("value", "initial"))
    return hit(found.filter(divisor.isin(ZEROS)), "SAF002", C("var"))


def concurrency_rules(facts: CodeFacts) -> list[DataFrame]:
    out = []
    in_method = _within(facts, "method")
    lock_on = r"^lock\s*\((.*)\)$"
    # An outer lock with its first inner one, and the method they are in; pairs meet within a file only.
    holder = in_method.filter(C("text").startswith("lock")).groupBy("file_id", C("seq").alias("open_no")).agg(F.max_by("name", C("depth")).alias("method"))
    nested = _within(facts, "lock").filter(_is(lock_on)).groupBy("file_id", "path", "open_no", "header", "open_line").agg(
        F.min_by("text", "seq").alias("inner")
    ).join(holder, ["file_id", "open_no"], "left").select(
        "file_id", "path", "open_no", C("open_line").alias("line_no"), "method",
        F.regexp_extract("header", lock_on, 1).alias("outer_lock"), F.regexp_extract("inner", lock_on, 1).alias("inner_lock"))
    before = nested.select("file_id", C("open_no").alias("first_no"), C("method").alias("first_method"),
                           C("outer_lock").alias("inner_lock"), C("inner_lock").alias("outer_lock"))
    crossed = nested.join(before, ["file_id", "outer_lock", "inner_lock"]).filter(C("first_no") < C("open_no"))
    out.append(hit(crossed, "CON001", F.coalesce("method", F.lit("Method")), vars=F.create_map(
        F.lit("other"), F.coalesce("first_method", F.lit("Method")),
        F.lit("order"), F.concat("outer_lock", F.lit(" -> "), "inner_lock"))))
    shared = _fields(facts).filter(_is(r"(?:^|\s)static\s") & ~_is(r"(?:^|\s)(?:readonly|const)\s")).select(
        "file_id", C("name").alias("changed"), C("p_scope").alias("type_scope")).distinct()
    owner = facts.scopes.select("scope_id", C("p_scope").alias("type_scope"))
    writes = in_method.filter(~C("in_lock") & C("text").contains("=") & ~C("header").rlike(r"(?:^|\s)static\s")).withColumn(
        "changed", F.regexp_extract("text", r"^([\w.]+)\s*(?:[-+*/%&|^]|\?\?|<<|>>)?=[^=>]", 1)
    ).filter(C("changed") != "").join(owner, "scope_id").join(shared, ["file_id", "changed", "type_scope"], "left_semi")
    out.append(hit(writes, "CON007", C("changed")))

    owners = facts.params.filter(C("type") == "CancellationToken").groupBy("scope_id").agg(
        F.min_by("param", "idx").alias("token"))
    call = r"([\w.]*Async)\s*\(([^()]*)\)"
    calls = in_method.filter(has_any("text", ["Async"], call) & ~_is(r"Task\.(?:Delay|Yield)")).withColumns({
        "called": F.regexp_extract("text", call, 1),
        "args": F.transform(F.split(F.regexp_extract("text", call, 2), ","), lambda a: F.trim(a)),
    })
    out.append(hit(token_not_passed(owners, calls, ["scope_id"]), "CON010", C("called")))

    return out


def enclosed_rules(facts: CodeFacts) -> list[DataFrame]:
    """All rules that only ask which scope a statement is in, in one reading of `inside`.

    A statement in k matching scopes is k hits, since each scope reports what it holds.
    """
    kind, header = C("kind"), C("header")
    in_loop = kind.isin(LOOP_KINDS)
    source = F.regexp_extract("header", r"\sin\s+(.+?)\s*\)$", 1)
    changed = F.regexp_extract("text", r"([\w.]+)\.(?:Add|Remove|Clear|Insert)\s*\(", 1)
    caught = F.regexp_extract("header", r"catch\s*\(\s*[\w.<>]+\s+(\w+)\s*\)", 1)
    thrown = F.regexp_extract("text", r"^throw\s+(\w+)$", 1)
    for_var = F.regexp_extract("header", r"^for\s*\(\s*[\w<>\[\],.?]+\s+(\w+)\s*=", 1)
    each_var = F.regexp_extract("header", r"foreach\s*\(\s*[\w<>\[\],.?]+\s+(\w+)\s+in\s", 1)
    loop_var = F.when(kind == "for", for_var).otherwise(each_var)
    started = F.regexp_extract("text", r"(?:Task\.Run|ThreadPool\.QueueUserWorkItem)\s*\((.*)$", 1)
    tests = [
        ("SAF012", (kind == "foreach") & (changed != "") & (changed == source), C("text")),
        ("SAF013", (kind == "catch") & (thrown != "") & (thrown == caught), C("text")),
        ("CON006", (kind == "method") & has_any("text", ["Thread.Sleep"], r"Thread\.Sleep\s*\(") & header.rlike(r"(?:^|\s)async\s"), C("name")),
        ("CON009", kind.isin("for", "foreach") & (started != "") & (loop_var != "") & F.contains(started, loop_var), loop_var),
        ("CON011", header.contains("Parallel.For") & header.rlike(PARALLEL) & _is(r"\.(?:Add|Remove|Clear)\s*\("), C("text")),
        ("SEC005", (kind == "method") & has_any("text", ["Random"], r"new\s+(?:System\.)?Random\s*\(") & F.lower("name").rlike(SENSITIVE), C("name")),
        ("PERF006", in_loop & has_any("text", [".Substring"], r"\.Substring\s*\("), C("text"), F.regexp_count("text", F.lit(r"\.Substring\s*\("))),
        ("PERF008", (kind == "method") & has_any("text", ["Regex"], r"new\s+(?:System\.Text\.RegularExpressions\.)?Regex\s*\("), F.lit("new Regex()")),
    ]
    # Every arrow inside a loop is a hit, so this rule may hit a statement more than once.
    arrows = facts.held.filter(in_loop & C("text").contains("=>")).withColumn("arrow", F.explode(per_match(C("text"), "=>")))
    tested = facts.held.filter(kind.isin("method", "catch", *LOOP_KINDS) | header.contains("Parallel.For"))
    return [hit(one_pass(tested, PLACE, tests), None), hit(arrows, "PERF007", F.lit("lambda in loop"))]


def statement_rules(facts: CodeFacts) -> list[DataFrame]:
    """All rules that only look at a statement, in one reading of them."""
    built = r'\$""|""\s*\+|\+\s*""|\w\s*\+\s*\w'
    tests = [
        ("SEC001", has_any("text", SQL_CALLS, rf"\w\s*\(.*(?:{built})"), C("text")),
        ("SEC003", has_any("text", WEAK_CRYPTO, rf"(?:{'|'.join(WEAK_CRYPTO)})[\w.]*\s*\("), C("text")),
        ("SEC004", has_any("text", HTML_SINKS,
                           r'(?:Response\.Write(?:Async)?|HtmlString|Html\.Raw)\s*\(\s*(?:\$"|[^,]*\+|[^,]*Request\.)'), C("text")),
        ("CON011", has_any("text", ["Parallel.For"], PARALLEL + r".*\.(?:Add|Remove|Clear)\s*\("), C("text")),
    ]
    return [hit(one_pass(facts.asked, PLACE, tests), None)]


def security_rules(facts: CodeFacts) -> list[DataFrame]:
    """Rules about an action without its guard in the same method, all in one anti join."""
    new_type = F.regexp_extract("text", r"new\s+([\w.]+)", 1)
    actions = [
        ("SEC006", _is(FILE_CALLS + r'\s*\(\s*(?:[A-Za-z_]\w*\s*[,)]|\$")'), F.regexp_extract("text", FILE_CALLS, 0)),
        ("SEC009", _is(r"new\s+(?:XmlDocument|XmlReaderSettings)(?:\W|$)"), new_type),
        ("SEC010", _is(r"(?:^|[^\w.])(?:Response\.)?Redirect\s*\(\s*[A-Za-z_]\w*\s*[,)]"), F.lit("Redirect")),
        ("SEC011", _is(r"new\s+[\w.]*(?:HttpCookie|CookieOptions)"), new_type),
    ]
    guards = [
        ("SEC006", _is(r"Path\.Get(?:FileName|FullPath)"), F.lit("")),
        ("SEC009", _is(r"DtdProcessing\.Prohibit|XmlResolver = null"), F.lit("")),
        ("SEC010", _is("IsLocalUrl"), F.lit("")),
        ("SEC011", _is("HttpOnly = true"), F.lit("")),
    ]
    in_method = _within(facts, "method")
    return [hit(unguarded(
        one_pass(in_method, ["scope_id", *PLACE], actions), one_pass(in_method, ["scope_id"], guards), ["scope_id", "rule_id"]
    ), None)]


def performance_rules(facts: CodeFacts) -> list[DataFrame]:
    in_method = _within(facts, "method")
    out = [_string_growth(facts)]

    lazy = facts.params.filter(C("type").startswith("IEnumerable")).select("scope_id", "param", "method", "path", "file_id", C("open_line").alias("line_no"))
    chains = in_method.filter(has_any("text", [".Where", ".Select", ".Count", ".Any", ".ToList", ".ToArray"])).select("scope_id", F.explode(F.regexp_extract_all("text", F.lit(CHAIN), F.lit(0))).alias("chain"))
    calls = chains.select(
        "scope_id", F.regexp_extract("chain", r"^(\w+)\.", 1).alias("param"),
        F.explode(F.regexp_extract_all("chain", F.lit(r"\.(?:Where|Select|Count|Any|ToList|ToArray)\w*\("), F.lit(0))),
    )
    repeated = repeat_use(calls, ["scope_id", "param"], 2)
    out.append(hit(lazy.join(repeated, ["scope_id", "param"]), "PERF004", F.concat("method", F.lit("("), "param", F.lit(")")), actual=C("uses")))
    return out


def _kind_of(type_name: Column) -> Column:
    return F.when(type_name.isin("string", "String"), "string").when(type_name.isin(NUMERIC_TYPES), "number")


def _string_growth(facts: CodeFacts) -> DataFrame:
    """`+=` in loops whose target is a text: by its value, else by its nearest declaration, else by its name."""
    grow = r"^([\w.]+)\s*\+=\s*(.+)$"
    owner = _within(facts, "method").select("file_id", "seq", C("scope_id").alias("method_scope"))
    grown = stage(
        _within(facts, *LOOP_KINDS).filter(has_any("text", ["+="], grow))
        .select("file_id", "path", "seq", "line_no", "scope_id", "text",
                F.regexp_extract("text", grow, 1).alias("var"), F.regexp_extract("text", grow, 2).alias("value"))
        .join(owner, ["file_id", "seq"]), "grown",
    )
    local_decl = _locals(_within(facts, "method")).select(
        C("scope_id").alias("method_scope"), C("name").alias("var"), F.lit(1).alias("priority"), _kind_of(C("type")).alias("kind"))
    params = facts.params.select(
        C("scope_id").alias("method_scope"), C("param").alias("var"), F.lit(2).alias("priority"), _kind_of(C("type")).alias("kind"))
    fields = _fields(facts).select(C("p_scope").alias("type_scope"), C("name").alias("var"), C("type"))
    around = facts.scopes.select(C("scope_id").alias("method_scope"), C("p_scope").alias("type_scope"))
    field_decl = grown.select("method_scope", "var").distinct().join(around, "method_scope").join(fields, ["type_scope", "var"]).select(
        "method_scope", "var", F.lit(3).alias("priority"), _kind_of(C("type")).alias("kind"))
    asked = grown.select("method_scope", "var").distinct()
    decls = local_decl.unionByName(params).join(asked, ["method_scope", "var"], "left_semi").unionByName(field_decl)
    typed = classify(grown, decls, ["method_scope", "var"], [("number", NUMERIC_NAMES), ("string", TEXT_NAMES)], "var", "unknown")
    as_text = C("value").rlike(r'^\$?""$') | C("value").endswith(".ToString()")
    return hit(typed.filter(as_text | (C("kind") == "string")), "PERF001", C("text"))


def architecture_rules(facts: CodeFacts) -> list[DataFrame]:
    methods, types, stmts = _methods(facts), _types(facts), facts.asked
    expected = lambda form: F.create_map(F.lit("expected"), form)
    first_lower = C("name").rlike(r"^[a-z]")
    snake = C("name").contains("_")
    is_interface = C("header").rlike(r"(?:^|\s)interface\s")
    is_enum = C("header").rlike(r"(?:^|\s)enum\s")
    out = []

    faces = types.filter(is_interface)
    out.append(hit(
        faces.filter(~C("name").startswith("I") | C("name").rlike(r"^.[a-z]")), "ARCH001", C("name"),
        vars=expected(F.when(C("name").startswith("I"), C("name")).otherwise(F.concat(F.lit("I"), pascal(C("name"))))),
    ))
    real = methods.filter((C("p_kind") == "type") & (C("name") != C("p_name")) & ~C("name").startswith("~"))
    # Methods without a body end with `;` or hold `=>`.
    short_form = r"^((?:[a-z]+\s+)*[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^()]*>)?\s*\([^=]*\))\s*(?:=>.*)?$"
    bodiless = stmts.filter((C("p_kind") == "type") & (C("delim") == ";") & _is(short_form)).select(
        "file_id", "path", "line_no", F.regexp_extract("text", short_form, 2).alias("name"),
        F.regexp_extract("text", short_form, 1).alias("header"))
    named = real.select("file_id", "path", "line_no", "name", "header").unionByName(bodiless)
    out.append(hit(
        named.filter(C("header").rlike(r"(?:^|\s)async\s") & ~C("name").endswith("Async") & (C("name") != "Main")),
        "ARCH002", C("name"), vars=expected(F.concat("name", F.lit("Async"))),
    ))
    out.append(hit(types.filter(~is_interface & ~is_enum & (first_lower | snake)), "ARCH003", C("name"), vars=expected(pascal(C("name")))))
    props = facts.scopes.filter((C("kind") == "property") & (C("p_kind") == "type")).withColumn("line_no", C("open_line"))
    out.append(hit(props.filter(first_lower | snake), "ARCH004", C("name"), vars=expected(pascal(C("name")))))
    variables = _fields(facts).withColumn("local", F.lit(False)).unionByName(_locals(stmts).withColumn("local", F.lit(True)))
    out.append(hit(
        variables.filter((F.length("name") >= 2) & (snake | (C("local") & C("name").rlike(r"^[A-Z]")))), "ARCH005", C("name"),
        vars=expected(camel(C("name"))),
    ))
    out.append(hit(named.filter(first_lower | snake), "ARCH007", C("name"), vars=expected(pascal(C("name")))))
    fields = _fields(facts)
    fixed = _is(r"(?:^|\s)const\s") | (_is(r"(?:^|\s)static\s") & _is(r"(?:^|\s)readonly\s"))
    public = _is(r"(?:^|\s)public\s")
    out.append(hit(
        fields.filter(~public & ~fixed & (F.length("name") >= 2) & C("name").rlike(r"^[A-Z]")), "ARCH008", C("name"),
        vars=expected(F.concat(F.lit("_"), camel(C("name")))),
    ))
    out.append(hit(fields.filter(public & ~fixed), "ARCH010", C("name")))

    in_class = facts.held.filter((C("kind") == "type") & C("header").rlike(r"(?:^|\s)class\s"))
    console = in_class.filter(has_any("text", ["Console.Write"], r"Console\.Write(?:Line)?\s*\(")).groupBy("file_id", "path", "seq", "line_no").agg(
        F.max_by("name", "open_no").alias("class_name"))
    out.append(hit(console.filter(~C("class_name").rlike(r"^Program$|(?:Console|Cli|Demo)$")), "ARCH009", C("class_name")))
    out.append(hit(faces.filter(~C("header").contains(":") & ~C("filled")), "ARCH011", C("name")))

    imports = stmts.filter(_is(r"^using\s+(?:static\s+)?[\w.]+$")).select(
        "file_id", "line_no", F.regexp_extract("text", r"([\w.]+)$", 1).alias("imported"))
    slashed = facts.files.select("file_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))
    out.append(hit(layer_boundary(slashed, "path", imports, "file_id", "imported", [(INNER_LAYER, PRESENTATION)]), "ARCH012", C("imported")))
    contexts = in_class.filter(has_any("text", ["Context"], r"new\s+[\w.]*Context(?:\W|$)")).groupBy("file_id", "path", "seq", "line_no").agg(
        F.max_by("name", "open_no").alias("class_name"))
    out.append(hit(contexts.filter(C("class_name").endswith("Controller")), "ARCH013", C("class_name")))

    tested = stmts.filter(_is(r"[=<>]\s*\d") & (C("in_if") | _is(r"^(?:else\s+)?if\s*\("))).select(
        "file_id", "path", "seq", "line_no", "text").distinct()
    literals = tested.withColumn("literals", F.array_join(
        F.regexp_extract_all("text", F.lit(r"(?:[=!]=|[^=<>-]>|[^=<>]<)\s*(\d+)(?![\w.])"), F.lit(1)), " "))
    out.append(hit(magic_numbers(literals, "literals"), "ARCH014", C("literal").cast("string")))

    top = types.filter(~is_enum & F.coalesce(C("p_kind") == "namespace", F.lit(True))).select(
        "file_id", "path", "line_no", "open_no", "name")
    out.append(hit(extras(top, ["file_id"], ["open_no"], "name"), "ARCH015", C("name")))
    return out


def line_rules(facts: CodeFacts) -> list[DataFrame]:
    """Line rules on code with literals blanked; the secret rule needs the literals."""
    keep = ["file_id", "path"]
    raw = [r for r in SCAN_RULES if r["rule_id"] in _ON_LITERALS]
    code = [r for r in SCAN_RULES if r["rule_id"] not in _BY_FACTS | _ON_LITERALS]
    found = [
        scan_texts(facts.code.select(*keep, "text"), keep, "text", code, every=True),
        scan_texts(facts.files.select(*keep, "text"), keep, "text", raw),
    ]
    return [hit(frame.withColumn("member", F.trim("line")), None) for frame in found]


FAMILIES = [safety_rules, concurrency_rules, enclosed_rules, statement_rules, security_rules,
            performance_rules, architecture_rules, line_rules]


#: Settings that replace the limit of a measuring rule.
LIMIT_SETTINGS = {
    "CQ001": "MaxMethodLines", "CQ002": "MaxCyclomaticComplexity", "CQ003": "MaxParameterCount", "CQ004": "MaxNestingDepth",
}
#: Rules that look at a whole file, however little of it changed.
UNSCOPED = ["CON001"]


def limits_from(settings: DataFrame, column: str = "settings") -> DataFrame:
    """The policy with the limits of one row of settings, as `gate_settings` gives them."""
    limit = C("threshold")
    for rule_id, name in LIMIT_SETTINGS.items():
        limit = F.when(C("rule_id") == rule_id, settings.select(f"{column}.{name}").scalar()).otherwise(limit)
    return policy(settings.sparkSession).withColumn("threshold", limit.cast("int"))


def scope_findings(found: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Findings that a change (path, line_no) touches; None keeps all.

    A measured span stays if it holds a changed line or its file has none; a finding in a line
    stays if that line changed, so an empty change keeps spans and no lines. Findings and changed
    lines are read by several joins, so both are written first: the plan of all rules is there once.
    """
    if changed is None:
        return found
    found = stage(found, "findings")
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    lines = stage(changed.select(path.alias("path_key"), "line_no").distinct(), "lines")
    keyed = found.withColumn("path_key", F.lower(F.replace("target", F.lit("\\"), F.lit("/"))))
    span, whole = C("end_line_no") > 0, C("rule_id").isin(UNSCOPED)
    kept = scope_spans(keyed.filter(span & ~whole), lines, start="line_no", end="end_line_no")
    touched = scope_lines(keyed.filter(~span & ~whole), lines.withColumnRenamed("path_key", "path"), path="path_key")
    return kept.unionByName(touched).unionByName(keyed.filter(whole)).drop("path_key")


def code_findings(facts: CodeFacts, changed: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """Findings of all 72 rules; `run_id` is left blank for the caller.

    `changed` limits them to what changed, `settings` is one row of `gate_settings`.
    """
    limits = None if settings is None else limits_from(settings)
    hits = union_all([*structure_rules(facts, limits), *(frame for family in FAMILIES for frame in family(facts))])
    order = sql_lookup("rule_id", {r: str(i) for r, i in _ORDER.items()}).cast("bigint")
    too_far = (C("rule_id") == "SAF004") & _is(OFF_BY_ONE_LINE, "member")
    named = hits.withColumn("rule_name", F.when(too_far, OFF_BY_ONE).otherwise(sql_lookup("rule_id", RULE_NAME)))
    found = categorise(as_findings(
        named, target=C("path"), severity=F.coalesce("severity", sql_lookup("rule_id", RULE_SEVERITY)),
        description=F.concat("rule_name", F.lit(": "), "member"),
        seq=seq_of(C("file_id"), order * 1_000_000 + C("line_no"), 80_000_000),
    ))
    return scope_findings(found, changed)
