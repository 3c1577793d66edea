"""Source-code templates: per rule one text that breaks it and one that does not.

`{id}` and `{name}` are filled in per file. `code_corpus` spreads the templates over
the rows of `part`, so the number of files breaking each rule is known.
"""

from __future__ import annotations


def _in_method(body: str, head: str = "public void Run()", extra: str = "") -> str:
    inner = "\n".join("        " + line for line in body.split("\n"))
    return (
        "namespace Shop\n{\n    public class Item{id}\n    {\n" + (extra + "\n" if extra else "")
        + "    " + head + "\n    {\n" + inner + "\n    }\n    }\n}\n"
    )


def _in_class(members: str, head: str = "public class Item{id}") -> str:
    return f"namespace Shop\n{{\n    {head}\n    {{\n{members}\n    }}\n}}\n"


def _repeat(line: str, n: int) -> str:
    return "\n".join(line.replace("#", str(i)) for i in range(n))


# rule_id: (violating, clean) or (violating, clean, folder)
TEMPLATES = {
    "CQ001": (_in_method(_repeat("Step(#);", 60)), _in_method(_repeat("Step(#);", 10))),
    "CQ002": (_in_method(_repeat("if (a#) { Step(#); }", 12)), _in_method(_repeat("if (a#) { Step(#); }", 3))),
    "CQ003": (_in_method("Step();", "public void Run(int a, int b, Map<int, int> c, int d, int e)"),
              _in_method("Step();", "public void Run(int a, Map<int, int> b, int c)")),
    "CQ004": (_in_method("if (a)\n{\n    if (b)\n    {\n        if (c)\n        {\n            if (d)\n            {\n                Step();\n            }\n        }\n    }\n}"),
              _in_method("if (a)\n{\n    if (b)\n    {\n        Step();\n    }\n}")),
    "CQ005": (_in_class(_repeat("    private int n#;", 310)), _in_class(_repeat("    private int n#;", 20))),
    "CQ006": (_in_class("    public Item{id}(A a, B b, C c, D d, E e, F f)\n    {\n        Keep(a);\n    }"),
              _in_class("    public Item{id}(A a, B b)\n    {\n        Keep(a);\n    }")),
    "CQ007": (_in_method("foreach (var a in xs)\n{\n    while (b)\n    {\n        if (c && d)\n        {\n            if (e || f)\n            {\n                for (int i = 0; i < 3; i++)\n                {\n                    if (g) { Step(); }\n                }\n            }\n        }\n    }\n}"),
              _in_method("foreach (var a in xs)\n{\n    if (c && d) { Step(); }\n}")),
    "CQ008": (_in_class("    private int n;", "public class Item{id} : Base, IOne, ITwo<A, B>, IThree"),
              _in_class("    private int n;", "public class Item{id} : Base, ITwo<A, B>")),
    "CQ009": (_in_class(_repeat("    public void Do#()\n    {\n        Step();\n    }", 22)),
              _in_class(_repeat("    public void Do#()\n    {\n        Step();\n    }", 4))),
    "CQ010": (_in_method("switch (kind)\n{\n    case 1:\n        Step();\n        break;\n}"),
              _in_method("switch (kind)\n{\n    case 1:\n        Step();\n        break;\n    default:\n        break;\n}")),
    "SAF001": (_in_method("var city = order.Buyer.Home.City;"), _in_method("var city = order?.Buyer?.Home?.City;\nvar t = System.A.B.C;")),
    "SAF002": (_in_method("int parts = 0;\nint share = total / parts;"), _in_method("int parts = 0;\nparts = 2;\nint share = total / parts;")),
    "SAF003": (_in_method("var file = new FileStream(path);\nfile.Read();"),
               _in_method("using var file = new FileStream(path);\nusing (var other = new StreamReader(file))\n{\n    var third = new MemoryStream();\n}")),
    "SAF004": (_in_method("for (int i = 0; i <= xs.Length; i++)\n{\n    Step(i);\n}\nvar last = xs[-1];"),
               _in_method("for (int i = 0; i < xs.Length; i++)\n{\n    Step(i);\n}\nvar last = xs[n - 1];")),
    "SAF005": (_in_method("try\n{\n    Step();\n}\ncatch (IOException e)\n{\n    // nothing\n}"),
               _in_method("try\n{\n    Step();\n}\ncatch (IOException e)\n{\n    Log(e);\n}")),
    "SAF006": (_in_method("if (a)\n{\n    return;\n    Step();\n}"), _in_method("if (a)\n{\n    Step();\n    return;\n}\nStep();")),
    "SAF007": (_in_method('throw new Exception("bad {id}");'), _in_method('throw new FormatException("bad {id}");')),
    "SAF008": (_in_method("order.Ship();", "public void Run(Order order)"),
               _in_method("if (order == null) { return; }\norder.Ship();", "public void Run(Order order)")),
    "SAF009": (_in_method("while (true)\n{\n    Step();\n}"), _in_method("while (true)\n{\n    if (done) { break; }\n}")),
    "SAF010": (_in_method("if (price == 1.5f)\n{\n    Step();\n}"), _in_method("if (Near(price, limit))\n{\n    Step();\n}")),
    "SAF011": (_in_method("var x = name ?? name;"), _in_method("var x = name ?? other;")),
    "SAF012": (_in_method("foreach (var x in items)\n{\n    items.Remove(x);\n}"), _in_method("foreach (var x in items)\n{\n    gone.Add(x);\n}")),
    "SAF013": (_in_method("try\n{\n    Step();\n}\ncatch (IOException ex)\n{\n    Log(ex);\n    throw ex;\n}"),
               _in_method("try\n{\n    Step();\n}\ncatch (IOException ex)\n{\n    Log(ex);\n    throw;\n}")),
    "SAF014": (_in_class("    public override bool Equals(object o)\n    {\n        return Same(o);\n    }"),
               _in_class("    public override bool Equals(object o)\n    {\n        return Same(o);\n    }\n    public override int GetHashCode()\n    {\n        return n;\n    }")),
    "SAF015": (_in_method("var dog = (Dog)animal;"), _in_method("int n = (int)total;\nif (animal is Dog)\n{\n    var dog = (Dog)animal;\n}")),
    "CON001": (_in_class("    public void One()\n    {\n        lock (left)\n        {\n            lock (right) { Step(); }\n        }\n    }\n    public void Two()\n    {\n        lock (right)\n        {\n            lock (left) { Step(); }\n        }\n    }"),
               _in_class("    public void One()\n    {\n        lock (left)\n        {\n            lock (right) { Step(); }\n        }\n    }\n    public void Two()\n    {\n        lock (left)\n        {\n            lock (right) { Step(); }\n        }\n    }")),
    "CON002": (_in_method("await StepAsync(n).ConfigureAwait(false);", "public async void RunAsync()"),
               _in_method("await StepAsync(n).ConfigureAwait(false);", "public async Task RunAsync()")),
    "CON003": (_in_method("var x = LoadTask(n).Result;"), _in_method("var x = LoadTask(n).Results;")),
    "CON004": (_in_method("lock (this)\n{\n    Step();\n}"), _in_method("lock (gate)\n{\n    Step();\n}")),
    "CON005": (_in_method("store.SaveAsync(n);"), _in_method("var t = store.SaveAsync(n);")),
    "CON006": (_in_method("Thread.Sleep(10);", "public async Task RunAsync()"), _in_method("Thread.Sleep(10);")),
    "CON007": (_in_method("total = 5;", extra="    private static int total;"),
               _in_method("lock (gate)\n{\n    total = 5;\n}", extra="    private static int total;")),
    "CON008": (_in_method("await LoadAsync();", "public async Task RunAsync()"),
               _in_method("await LoadAsync().ConfigureAwait(false);", "public async Task RunAsync()")),
    "CON009": (_in_method("for (int i = 0; i < 3; i++)\n{\n    Task.Run(() => Step(i));\n}"),
               _in_method("for (int i = 0; i < 3; i++)\n{\n    Task.Run(() => Step());\n}")),
    "CON010": (_in_method("await LoadAsync(n);", "public async Task RunAsync(int n, CancellationToken stop)"),
               _in_method("await LoadAsync(n, stop);", "public async Task RunAsync(int n, CancellationToken stop)")),
    "CON011": (_in_method("Parallel.ForEach(xs, x =>\n{\n    found.Add(x);\n});"), _in_method("Parallel.ForEach(xs, x =>\n{\n    Step(x);\n});")),
    "SEC001": (_in_method('db.Execute($"DELETE FROM t WHERE id = {n}");'), _in_method('db.Execute("DELETE FROM t WHERE id = @id", n);')),
    "SEC002": (_in_method('var password = "hunter2{id}";'), _in_method('var password = vault.Get("db");')),
    "SEC003": (_in_method("var h = MD5.Create();"), _in_method("var h = SHA256.Create();")),
    "SEC004": (_in_method('Response.Write("<b>" + name);'), _in_method("Response.Write(Encode(name));")),
    "SEC005": (_in_method("var r = new Random();", "public int MakeToken()"), _in_method("var r = new Random();", "public int RollDice()")),
    "SEC006": (_in_method("var t = File.ReadAllText(path);"), _in_method("path = Path.GetFullPath(path);\nvar t = File.ReadAllText(path);")),
    "SEC007": (_in_method("var f = new BinaryFormatter();"), _in_method("var f = new JsonFormatter();")),
    "SEC008": (_in_method('Process.Start("git", "log " + name);'), _in_method('Process.Start("git", name);')),
    "SEC009": (_in_method("var doc = new XmlDocument();"), _in_method("var doc = new XmlDocument();\ndoc.XmlResolver = null;")),
    "SEC010": (_in_method("return Redirect(url);", "public Result Go(string url)"),
               _in_method("if (Url.IsLocalUrl(url)) { return Redirect(url); }\nreturn Home();", "public Result Go(string url)")),
    "SEC011": (_in_method("var o = new CookieOptions { Path = p };"), _in_method("var o = new CookieOptions { HttpOnly = true };")),
    "PERF001": (_in_method('foreach (var x in xs)\n{\n    line += x;\n}', extra="    private string line;"),
                _in_method("foreach (var x in xs)\n{\n    line += x;\n}", extra="    private int line;")),
    "PERF002": (_in_method("var l = new ArrayList();"), _in_method("var l = new List<int>();")),
    "PERF003": (_in_method("var any = xs.Count() > 0;"), _in_method("var many = xs.Count() > 7;")),
    "PERF004": (_in_method("var a = xs.Count();\nvar b = xs.Any();", "public void Run(IEnumerable<int> xs)"),
                _in_method("var a = xs.Count();", "public void Run(IEnumerable<int> xs)")),
    "PERF005": (_in_method("var same = a.ToLower() == b;"), _in_method("var low = a.ToLower();")),
    "PERF006": (_in_method("while (more)\n{\n    var s = text.Substring(1);\n}"), _in_method("var s = text.Substring(1);")),
    "PERF007": (_in_method("while (more)\n{\n    Each(x => x + 1);\n}"), _in_method("Each(x => x + 1);")),
    "PERF008": (_in_method("var r = new Regex(p);"), _in_class("    private static readonly Regex R = new Regex(p);")),
    "PERF009": (_in_class("    ~Item{id}()\n    {\n        Free();\n    }"), _in_class("    public void Dispose()\n    {\n        Free();\n    }")),
    "PERF010": (_in_method("Step();", "public void Run(BigMatrix m)"), _in_method("Step();", "public void Run(in BigMatrix m)")),
    "ARCH001": ("public interface Shape{id}\n{\n    void Draw();\n}\n", "public interface IShape{id}\n{\n    void Draw();\n}\n"),
    "ARCH002": (_in_method("await StepAsync(n).ConfigureAwait(false);", "public async Task Load()"),
                _in_method("await StepAsync(n).ConfigureAwait(false);", "public async Task LoadAsync()")),
    "ARCH003": (_in_class("    private int n;", "public class item_{name}"), _in_class("    private int n;", "public class Item{id}")),
    "ARCH004": (_in_class("    public int item_count { get; set; }"), _in_class("    public int ItemCount { get; set; }")),
    "ARCH005": (_in_method("int item_count = 3;"), _in_method("int itemCount = 3;")),
    "ARCH006": (_in_method("var r = WebRequest.Create(url);"), _in_method("var r = client.GetPage(url);")),
    "ARCH007": (_in_method("Step();", "public void run_all()"), _in_method("Step();", "public void RunAll()")),
    "ARCH008": (_in_class("    private int Total;"), _in_class("    private int total;\n    private static readonly int Limit = 3;\n    private const int Most = 9;")),
    "ARCH009": (_in_method('Console.WriteLine("{name}");'), _in_class('    public void Run()\n    {\n        Console.WriteLine("x");\n    }', "public class Item{id}Demo")),
    "ARCH010": (_in_class("    public int total;"), _in_class("    public const int Most = 3;\n    public int Total { get; set; }")),
    "ARCH011": ("public interface IMark{id}\n{\n}\n", "public interface IMark{id} : IBase\n{\n}\n"),
    "ARCH012": ("using Microsoft.AspNetCore.Mvc;\n" + _in_class("    private int n;"), "using System.Text;\n" + _in_class("    private int n;"), "src/Domain/"),
    "ARCH013": (_in_class("    public void Run()\n    {\n        var db = new ShopContext();\n    }", "public class CartController"),
                _in_class("    public void Run()\n    {\n        var db = new ShopContext();\n    }", "public class CartService")),
    "ARCH014": (_in_method("if (size > 42)\n{\n    Step();\n}"), _in_method("if (size > 1 && rate < 100)\n{\n    Step();\n}\nvar n = 42;")),
    "ARCH015": ("namespace Shop\n{\n    public class A{id} { }\n    public class B{id} { }\n}\n", "namespace Shop\n{\n    public class A{id}\n    {\n        class B { }\n    }\n}\n"),
}

# (tid, rule_id, violating, dir, body) in a fixed order.
ROWS = []
for _rule, _t in TEMPLATES.items():
    for _violating, _body in ((True, _t[0]), (False, _t[1])):
        ROWS.append((len(ROWS), _rule, _violating, _t[2] if len(_t) > 2 else "src/Shop/", _body))

NEWLINE = "¶"  # newlines of a body while it is part of a table; put back last

#: Line of the first statement of a method here, where a violating text is reported unless said otherwise.
_FIRST = 7
#: Where else: rules by line, worked out from the texts above.
_LINES = {
    1: "ARCH001 ARCH011 ARCH012",
    3: "CQ005 CQ008 CQ009 SAF014 ARCH003",
    4: "ARCH015",
    5: "CQ001 CQ002 CQ003 CQ004 CQ006 CQ007 SAF008 CON002 PERF004 PERF009 PERF010 ARCH002 ARCH004 ARCH007 ARCH008 ARCH010",
    8: "SAF002 CON007",
    9: "SAF012 CON009 CON011 PERF006 PERF007",
    10: "SAF006 PERF001",
    11: "SAF005",
    14: "SAF013 CON001",
}
#: Last lines of what the measuring rules measure; other rules report one line.
_ENDS = {"CQ001": 67, "CQ002": 19, "CQ003": 8, "CQ004": 20, "CQ005": 315, "CQ006": 8, "CQ007": 23, "CQ008": 6, "CQ009": 93}
#: Texts that break another rule too: (template, violating, rule, line, last line, severity).
_ALSO = [
    ("SAF004", True, "SAF004", 11, 0, "Error"),  # the index -1 after the loop
    ("CQ006", True, "CQ003", 5, 8, "Warning"),  # six parameters
    ("CQ007", True, "CQ004", 5, 23, "Error"),  # six blocks deep
    ("CQ007", True, "ARCH014", 15, 0, "Warning"),  # a loop to 3 inside an if
    ("CON009", True, "PERF007", 9, 0, "Warning"),  # a lambda in a loop
    ("CON009", False, "PERF007", 9, 0, "Warning"),
    ("SEC007", True, "ARCH006", 7, 0, "Warning"),  # an outdated type
    ("PERF004", True, "SAF008", 5, 0, "Warning"),  # a parameter used without a guard
    ("PERF004", False, "SAF008", 5, 0, "Warning"),
]


def expected_findings(severity: dict[str, str]) -> list[tuple[int, str, int, int, str]]:
    """(tid, rule_id, line_no, end_line_no, severity) of every finding in the texts above.

    `severity` gives that of each rule; measures here are above their limit, but not by enough for an error.
    """
    place = {(rule, violating): tid for tid, rule, violating, *_ in ROWS}
    line = {rule: n for n, rules in _LINES.items() for rule in rules.split()}
    level = lambda rule: "Warning" if rule in _ENDS else severity[rule]
    own = [(place[r, True], r, line.get(r, _FIRST), _ENDS.get(r, 0), level(r)) for r in TEMPLATES]
    return own + [(place[t, violating], *rest) for t, violating, *rest in _ALSO]
