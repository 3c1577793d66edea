"""The rule catalogue: 72 rules as data, each carried by an operator.

`carrier` names the operator. A rule with patterns is tested line by line by
`operators.scan`; the others are built from code facts in `plans.code_rules`. The
tests are text forms: no syntax tree is built, so a rule sees tokens, not meaning.
"""

from __future__ import annotations

from gatewright.schema import ERROR, WARNING
from gatewright.session import inline_table

# Rule id, name, severity and limit of every rule. "graded" severity is
# decided by the policy of `operators.metrics`.
GRADED = "graded"
RULES = [
    # (rule_id, name, severity, limit, carrier)
    ("CQ001", "Method Length Exceeded", GRADED, 50, "span_length"),
    ("CQ002", "High Cyclomatic Complexity", GRADED, 10, "branch_score"),
    ("CQ003", "Excessive Parameter Count", GRADED, 4, "child_count"),
    ("CQ004", "Deep Nesting Depth", GRADED, 3, "nesting_depth"),
    ("CQ005", "God Class Length Exceeded", WARNING, 300, "span_length"),
    ("CQ006", "Constructor Parameter Clump", WARNING, 5, "child_count"),
    ("CQ007", "High Cognitive Complexity", GRADED, 15, "weighted_depth"),
    ("CQ008", "Excessive Inheritance Hierarchy", WARNING, 3, "child_count"),
    ("CQ009", "Method Bloat in Class", WARNING, 20, "child_count"),
    ("CQ010", "Non-Exhaustive Switch Statement", WARNING, 0, "missing_member"),
    ("SAF001", "Deep Member Dereferencing", WARNING, 0, "chain_depth"),
    ("SAF002", "Division by Zero Defect", ERROR, 0, "latest_before"),
    ("SAF003", "Resource Leak (Missing 'using' Statement)", ERROR, 0, "unguarded"),
    ("SAF004", "Array Bounds Violation (Negative Index)", ERROR, 0, "scan"),
    ("SAF005", "Empty Catch Block (Swallowed Exception)", WARNING, 0, "empty_groups"),
    ("SAF006", "Unreachable Dead Code", WARNING, 0, "after_terminal"),
    ("SAF007", "Generic Exception Throw", WARNING, 0, "scan"),
    ("SAF008", "Missing Null Argument Guard", WARNING, 0, "unguarded"),
    ("SAF009", "Infinite Loop Defect", ERROR, 0, "missing_member"),
    ("SAF010", "Inexact Floating Point Equality", WARNING, 0, "scan"),
    ("SAF011", "Redundant Null Coalescing Expression", WARNING, 0, "identical"),
    ("SAF012", "Collection Mutation During Iteration", ERROR, 0, "in_scope_same_key"),
    ("SAF013", "Stack Trace Truncation (throw ex)", WARNING, 0, "in_scope_same_key"),
    ("SAF014", "Equals & GetHashCode Inconsistency", WARNING, 0, "presence_xor"),
    ("SAF015", "Dangerous Explicit Cast", WARNING, 0, "scan"),
    ("CON001", "Lock Order Inversion (Deadlock Risk)", ERROR, 0, "inverted_pairs"),
    ("CON002", "async void Method Anti-Pattern", ERROR, 0, "scan"),
    ("CON003", "Sync-Over-Async Blocking Call", ERROR, 0, "scan"),
    ("CON004", "Unsafe Lock Target", WARNING, 0, "scan"),
    ("CON005", "Unawaited Async Task Call", WARNING, 0, "scan"),
    ("CON006", "Thread.Sleep in Async Method", ERROR, 0, "in_scope"),
    ("CON007", "Shared Static State Mutation", WARNING, 0, "in_scope_same_key"),
    ("CON008", "Missing ConfigureAwait(false)", WARNING, 0, "scan"),
    ("CON009", "Loop Variable Closure in Async Task", ERROR, 0, "in_scope_same_key"),
    ("CON010", "Discarded CancellationToken", WARNING, 0, "token_not_passed"),
    ("CON011", "Thread-Unsafe Collection Mutation in Parallel", ERROR, 0, "in_scope"),
    ("SEC001", "SQL Injection Vulnerability", ERROR, 0, "contains_any"),
    ("SEC002", "Hardcoded Secret / Credential", ERROR, 0, "scan"),
    ("SEC003", "Weak Cryptographic Algorithm", ERROR, 0, "contains_any"),
    ("SEC004", "Cross-Site Scripting (XSS) Risk", ERROR, 0, "contains_any"),
    ("SEC005", "Insecure Random Number Generator", ERROR, 0, "in_scope"),
    ("SEC006", "Path Traversal Vulnerability", ERROR, 0, "unguarded"),
    ("SEC007", "Insecure Deserialization Provider", ERROR, 0, "scan"),
    ("SEC008", "Command Injection Vulnerability", ERROR, 0, "scan"),
    ("SEC009", "XML External Entity (XXE) Vulnerability", ERROR, 0, "unguarded"),
    ("SEC010", "Open Redirect Vulnerability", ERROR, 0, "unguarded"),
    ("SEC011", "Insecure Cookie Configuration", WARNING, 0, "unguarded"),
    ("PERF001", "String Concatenation in Loop", WARNING, 0, "in_scope"),
    ("PERF002", "Boxing Allocation (Non-Generic Collection)", WARNING, 0, "scan"),
    ("PERF003", "LINQ Count() Efficiency Anti-Pattern", WARNING, 0, "scan"),
    ("PERF004", "Multiple Enumeration of IEnumerable", WARNING, 0, "repeat_use"),
    ("PERF005", "Inefficient Case-Insensitive String Comparison", WARNING, 0, "scan"),
    ("PERF006", "Span / Memory Allocation Optimization", WARNING, 0, "in_scope"),
    ("PERF007", "Closure Allocation in Loop", WARNING, 0, "in_scope"),
    ("PERF008", "Uncached Regex Instantiation in Method", WARNING, 0, "in_scope"),
    ("PERF009", "Unnecessary Finalizer / Destructor", WARNING, 0, "scan"),
    ("PERF010", "Large Struct Passed By Value", WARNING, 0, "scan"),
    ("ARCH001", "Interface Naming Violation", WARNING, 0, "name_case"),
    ("ARCH002", "Async Naming Suffix Missing", WARNING, 0, "name_case"),
    ("ARCH003", "Type Naming Violation (Must be PascalCase)", WARNING, 0, "name_case"),
    ("ARCH004", "Property Naming Violation (Must be PascalCase)", WARNING, 0, "name_case"),
    ("ARCH005", "Variable Naming Violation (Must be camelCase)", WARNING, 0, "name_case"),
    ("ARCH006", "Obsolete API Usage", WARNING, 0, "scan"),
    ("ARCH007", "Method Naming Violation (Must be PascalCase)", WARNING, 0, "name_case"),
    ("ARCH008", "Field Casing Violation (PascalCase in Private Field)", WARNING, 0, "name_case"),
    ("ARCH009", "Console I/O in Business Domain Logic", WARNING, 0, "scan"),
    ("ARCH010", "Public Field Encapsulation Violation", WARNING, 0, "scan"),
    ("ARCH011", "Empty Marker Interface Anti-Pattern", WARNING, 0, "empty_groups"),
    ("ARCH012", "Layer Boundary Violation", WARNING, 0, "layer_boundary"),
    ("ARCH013", "Direct DbContext Instantiation in Controller", WARNING, 0, "in_scope"),
    ("ARCH014", "Magic Literal in Conditional Logic", WARNING, 0, "magic_numbers"),
    ("ARCH015", "Multiple Top-Level Types in Single File", WARNING, 0, "extras"),
]

# Line tests of the `scan` rules. Patterns use no lookaround, no back-reference and no \b,
# so they mean the same in Java and RE2. `unless` lets a line off. `needs` lists plain
# texts a match cannot do without (any of the tuples, whole): a cheap test before the pattern.
#   fixed value: the secret pattern of SEC002 and the API and type names
SCAN_RULES = [
    {"rule_id": "SAF004", "needs": [("[", "-")],
     "pattern": r"\w\[\s*-", "note": "negative index"},
    {"rule_id": "SAF004", "needs": [("<=", ".Length"), ("<=", ".Count")],
     "pattern": r"for\s*\([^;]*;[^;]*<=\s*[\w.()]+\.(Length|Count)\s*;", "note": "off by one"},
    {"rule_id": "SAF007", "needs": [("Exception",)],
     "pattern": r"throw\s+new\s+Exception\s*\(", "note": "exact type name"},
    {"rule_id": "SAF010", "needs": [("==",), ("!=",)],
     "pattern": r"[fdFD]\s*[!=]=[^=]|[!=]=\s*[\w.]*[fdFD]\s*([;)&|,?]|$)",
     "note": "an operand text ends with f, d, F or D, also a name"},
    {"rule_id": "SAF015", "needs": [("(", ")")],
     "pattern": r"\([A-Z]\w*(<[^()]*>)?\)\s*[A-Za-z_]\w*\s*[;,)]",
     "unless": r"(^|\W)(if|while|foreach|for|switch|using|lock|catch|is)\W|\((Guid|DateTime|TimeSpan)\)",
     "note": "cast of a plain name on a line without a test"},
    {"rule_id": "CON002", "needs": [("async", "void")],
     "pattern": r"(^|\W)async\s+void\s+\w", "note": ""},
    {"rule_id": "CON003", "needs": [(".Result",), (".Wait",), (".GetResult",)],
     "pattern": r"\.(Result|Wait|GetResult)(\W|$)", "note": "any member of these names"},
    {"rule_id": "CON004", "needs": [("lock", "(")],
     "pattern": r"(^|\W)lock\s*\(\s*(this\s*\)|\"|typeof)", "note": ""},
    {"rule_id": "CON005", "needs": [("Async",)],
     "pattern": r"^\s*[\w.]+Async\s*\(", "unless": r"Task\.(Run|Factory|Delay)",
     "note": "the call starts its line"},
    {"rule_id": "CON008", "needs": [("await",)],
     "pattern": r"(^|\W)await\s+[^;]*(Async\(\)\s*[;)]|Task\.)", "unless": r"ConfigureAwait",
     "note": ""},
    {"rule_id": "SEC002", "needs": [("=", "\"")],
     "pattern": r'(?i)(password|passwd|api_key|apikey|secret|token|private_key|connstr|connectionstring)\s*=\s*"[^"]{6,}"',
     "note": "any text line, not only code"},
    {"rule_id": "SEC007", "needs": [("new", "Formatter"), ("new", "NetDataContractSerializer")],
     "pattern": r"new\s+[\w.]*(BinaryFormatter|NetDataContractSerializer|LosFormatter|SoapFormatter)",
     "note": ""},
    {"rule_id": "SEC008", "needs": [("Process.Start",)],
     "pattern": r"Process\.Start\s*\([^,()]+,\s*(\$\"|[^,()]*[+])", "note": "second argument is built"},
    {"rule_id": "PERF002", "needs": [("new", "ArrayList"), ("new", "Hashtable")],
     "pattern": r"new\s+([\w.]+\.)?(ArrayList|Hashtable)\s*[({]", "note": ""},
    {"rule_id": "PERF003", "needs": [(".Count()",)],
     "pattern": r"\.Count\(\)\s*(==|!=|>=|<=|>|<)\s*[01](\D|$)|(^|[^\w.])[01]\s*(==|!=|>=|<=|>|<)\s*[\w.]+\.Count\(\)", "note": ""},
    {"rule_id": "PERF005", "needs": [(".ToLower()",), (".ToUpper()",)],
     "pattern": r"\.To(Lower|Upper)\(\)\s*[!=]=|[!=]=\s*[\w.()]+\.To(Lower|Upper)\(\)", "note": ""},
    {"rule_id": "PERF009", "needs": [("~", "(")],
     "pattern": r"(^|\s)~\w+\s*\(\s*\)", "note": ""},
    {"rule_id": "PERF010", "needs": [("Matrix",), ("Vector",), ("Buffer",), ("Payload",)],
     "pattern": r"[(,]\s*\w*(Matrix|Vector|Buffer|Payload)\w*(<[^>]*>)?\s+\w+\s*[,)=]",
     "note": "no modifier before the type"},
    {"rule_id": "ARCH006", "needs": [("BinaryFormatter",), ("Thread.Abort",), ("WebRequest.Create",), ("AppDomain.Unload",)],
     "pattern": r"new\s+[\w.]*BinaryFormatter|(Thread\.Abort|WebRequest\.Create|AppDomain\.Unload)\w*\s*\(", "note": ""},
    {"rule_id": "ARCH009", "needs": [("Console.Write",)],
     "pattern": r"Console\.Write(Line)?\s*\(",
     "note": "the exempt type names are applied by plans.code_rules"},
    {"rule_id": "ARCH010", "needs": [("public", ";"), ("public", "=")],
     "pattern": r"^\s*public\s+(static\s+|readonly\s+|volatile\s+)*[\w<>\[\],.?]+\s+\w+\s*(=[^>]|;)",
     "unless": r"(^|\W)const\W|static\s+readonly|readonly\s+static", "note": ""},
]

# SAF004 has a second name for loops that run one step too far.
OFF_BY_ONE = "Off-by-One Loop Boundary Violation"
OFF_BY_ONE_LINE = next(r["pattern"] for r in SCAN_RULES if r["note"] == "off by one")
RULE_NAME = {r[0]: r[1] for r in RULES}
RULE_SEVERITY = {r[0]: r[2] for r in RULES}


def rule_table(spark):
    """The catalogue as a table of 72 rows."""
    return inline_table(
        spark, RULES, "rule_id string, rule_name string, severity string, limit int, carrier string"
    )
