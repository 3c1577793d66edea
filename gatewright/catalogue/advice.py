"""Short advice per rule. `{member}`, `{actual}`, `{limit}` and rule values are filled in per finding."""

from __future__ import annotations

from gatewright.catalogue.rules import RULES
from gatewright.session import inline_table

# rule_id: (rationale, fix, steps, example)
_TEXTS = {
    "CQ001": ("{member} runs over {actual} lines, the limit is {limit}. Long bodies hide several jobs in one place.",
              "Move each job of the body into a method of its own.",
              ["Start where the fewest local variables are needed.", "Cut those lines out, with what they read as arguments.", "Go on until the rest fits a screen."],
              "Total(o) => Price(o) + Tax(o);"),
    "CQ002": ("{member} has {actual} paths, the limit is {limit}. Every path wants a test.",
              "Leave early and replace long ladders by lookups.",
              ["Turn nested tests into early returns.", "Use a table for ladders of equal tests."], "if (!ok) return;"),
    "CQ003": ("{member} takes {actual} parameters, the limit is {limit}.", "Pass one parameter object.",
              ["Declare a record for the values.", "Change {member} to take it."], "void Ship(Parcel p)"),
    "CQ004": ("{member} is nested {actual} levels deep, the limit is {limit}.", "Flatten the body with early exits.",
              ["Return when a condition fails.", "Move inner loops out."], "if (x == null) return;"),
    "CQ005": ("{member} has {actual} lines, the limit is {limit}.", "Split the type by responsibility.",
              ["Group members that change together.", "Give each group a type."], "class Prices {} class Taxes {}"),
    "CQ006": ("{member} needs {actual} services, the limit is {limit}.", "Group services behind one facade.",
              ["Find services used together.", "Inject the facade."], "Shop(IStock s, IBilling b)"),
    "CQ007": ("{member} scores {actual} for reading effort, the limit is {limit}.", "Name the conditions and flatten the loops.",
              ["Move conditions into named methods."], "if (IsDue(bill)) Remind(bill);"),
    "CQ008": ("{member} has {actual} base types, the limit is {limit}.", "Hold parts instead of inheriting them.",
              ["Inject the behaviour."], "class Mailer { IQueue queue; }"),
    "CQ009": ("{member} has {actual} methods, the limit is {limit}.", "Split the type by topic.",
              ["Group the methods by topic."], "class Login {} class Profile {}"),
    "CQ010": ("An unforeseen value passes the switch without notice.", "Add a default branch.",
              ["Add `default:` and report the value."], "default: throw new NotSupportedException();"),
    "SAF001": ("{member} fails when any link is null.", "Use `?.` along the chain.", ["Put `?.` before each link.", "Give a fallback."], "a?.B?.C"),
    "SAF002": ("{member} divides by a value that is 0.", "Test the divisor first.", ["Compare the divisor with 0."], "d == 0 ? 0 : n / d"),
    "SAF003": ("{member} holds a handle until it is collected.", "Create it in a `using`.", ["Declare it with `using var`."], "using var s = new MemoryStream();"),
    "SAF004": ("{member} leaves the bounds of its array.", "Keep the index from 0 up to Length - 1.", ["Use `<` with Length."], "for (i = 0; i < a.Length; i++)"),
    "SAF005": ("{member} drops the exception.", "Log it or throw it on.", ["Write to a log.", "Rethrow when unsure."], "catch (IOException e) { log.Warn(e); }"),
    "SAF006": ("{member} is never reached.", "Remove it or move it up.", ["Delete the statement."], "return x;"),
    "SAF007": ("Callers cannot tell this failure from others.", "Throw a specific type.", ["Pick the type that names the failure."], "throw new FormatException(text);"),
    "SAF008": ("{member} may be null when it is used.", "Check the argument on entry.", ["Add a null check."], "ArgumentNullException.ThrowIfNull(x);"),
    "SAF009": ("The loop has no way out.", "Add an exit.", ["Add a break or a condition."], "while (!done) { }"),
    "SAF010": ("Rounding makes equal values differ.", "Compare with a tolerance.", ["Test the distance of both values."], "Math.Abs(a - b) < eps"),
    "SAF011": ("Both sides of {member} are the same.", "Drop the operator.", ["Keep one side."], "name ?? \"none\""),
    "SAF012": ("{member} changes the collection being read.", "Collect the changes and apply them afterwards.", ["Loop over a copy."], "foreach (var x in xs.ToList())"),
    "SAF013": ("{member} loses where the exception came from.", "Use a bare `throw`.", ["Write `throw;`."], "catch { throw; }"),
    "SAF014": ("Hash tables lose objects of {member}.", "Override both methods.", ["Add the missing override."], "override int GetHashCode()"),
    "SAF015": ("{member} throws on another type.", "Test the type first.", ["Use a pattern."], "if (x is Dog d) d.Bark();"),
    "CON001": ("{member} takes two locks in both orders.", "Take locks in one order.", ["Agree on an order.", "Apply it everywhere."], "lock (a) lock (b)"),
    "CON002": ("Nobody can await {member} or catch what it throws.", "Return Task.", ["Change the return type."], "async Task SaveAsync()"),
    "CON003": ("{member} blocks a pool thread.", "Await the task.", ["Make the caller async."], "var x = await LoadAsync();"),
    "CON004": ("Others can lock {member} too.", "Lock a private object.", ["Add a private lock field."], "lock (gate)"),
    "CON005": ("{member} runs on unobserved.", "Await it.", ["Add `await`."], "await SendAsync();"),
    "CON006": ("{member} holds its thread while waiting.", "Await a delay.", ["Use Task.Delay."], "await Task.Delay(10);"),
    "CON007": ("{member} is shared by all instances.", "Guard it or make it an instance field.", ["Lock around writes."], "lock (gate) total = x;"),
    "CON008": ("The continuation wants its context back.", "Add ConfigureAwait(false).", ["Add it in library code."], "await t.ConfigureAwait(false);"),
    "CON009": ("{member} may have moved on when the task runs.", "Copy it inside the loop.", ["Declare a copy."], "var n = i;"),
    "CON010": ("{member} cannot be cancelled.", "Pass the token on.", ["Add the token argument."], "await LoadAsync(token);"),
    "CON011": ("{member} is not safe for parallel use.", "Use a concurrent collection.", ["Switch the type."], "new ConcurrentBag<int>()"),
    "SEC001": ("{member} lets input become SQL.", "Use parameters.", ["Bind values."], "WHERE id = @id"),
    "SEC002": ("Whoever reads the text owns the credential.", "Keep it in a secret store.", ["Revoke it.", "Read it at run time."], "vault.Get(\"db\")"),
    "SEC003": ("{member} can be broken.", "Use a current algorithm.", ["Switch to SHA-256 or AES."], "SHA256.HashData(bytes)"),
    "SEC004": ("{member} writes input as markup.", "Encode it.", ["Encode before writing."], "encoder.Encode(text)"),
    "SEC005": ("Its values can be guessed.", "Use a cryptographic source.", ["Switch the generator."], "RandomNumberGenerator.GetBytes(16)"),
    "SEC006": ("{member} follows any path.", "Check the full path.", ["Resolve it.", "Compare it with the root."], "Path.GetFullPath(p)"),
    "SEC007": ("{member} runs what it reads.", "Use a plain data format.", ["Switch to JSON."], "JsonSerializer.Deserialize<T>(s)"),
    "SEC008": ("Input becomes a command.", "Pass arguments as a list.", ["Use ArgumentList."], "info.ArgumentList.Add(x)"),
    "SEC009": ("{member} loads outside entities.", "Forbid DTDs.", ["Set DtdProcessing."], "DtdProcessing.Prohibit"),
    "SEC010": ("{member} sends users anywhere.", "Allow local targets only.", ["Test the target."], "if (Url.IsLocalUrl(u))"),
    "SEC011": ("Scripts can read the cookie.", "Set HttpOnly and Secure.", ["Set both flags."], "HttpOnly = true"),
    "PERF001": ("{member} copies the text each time.", "Use a builder.", ["Append to a builder."], "sb.Append(x);"),
    "PERF002": ("{member} boxes its values.", "Use a generic collection.", ["Switch the type."], "new List<int>()"),
    "PERF003": ("{member} counts everything.", "Ask for any.", ["Use Any()."], "xs.Any()"),
    "PERF004": ("{member} is read more than once.", "Store it once.", ["Call ToList once."], "var list = xs.ToList();"),
    "PERF005": ("{member} makes two copies.", "Compare without case.", ["Use OrdinalIgnoreCase."], "StringComparison.OrdinalIgnoreCase"),
    "PERF006": ("{member} copies text in a loop.", "Use spans.", ["Use AsSpan."], "text.AsSpan(0, 4)"),
    "PERF007": ("A delegate is made on each turn.", "Move it out of the loop.", ["Declare it before."], "Func<int> f = Next;"),
    "PERF008": ("The pattern is compiled on each call.", "Keep it in a static field.", ["Make it static readonly."], "static readonly Regex R"),
    "PERF009": ("{member} delays collection.", "Dispose instead.", ["Implement IDisposable."], "void Dispose()"),
    "PERF010": ("{member} is copied on each call.", "Pass it with `in`.", ["Add `in`."], "Scale(in Matrix m)"),
    "ARCH001": ("{member} does not look like an interface.", "Rename it to {expected}.", ["Rename it."], "interface IShape"),
    "ARCH002": ("{member} does not tell that it is async.", "Rename it to {expected}.", ["Rename it."], "LoadAsync"),
    "ARCH003": ("{member} breaks the type name form.", "Rename it to {expected}.", ["Rename it."], "class PriceList"),
    "ARCH004": ("{member} breaks the property name form.", "Rename it to {expected}.", ["Rename it."], "int Count { get; }"),
    "ARCH005": ("{member} breaks the variable name form.", "Rename it to {expected}.", ["Rename it."], "var itemCount"),
    "ARCH006": ("{member} is out of support.", "Use its successor.", ["Replace the call."], "HttpClient"),
    "ARCH007": ("{member} breaks the method name form.", "Rename it to {expected}.", ["Rename it."], "void Run()"),
    "ARCH008": ("{member} looks public.", "Rename it to {expected}.", ["Rename it."], "int _count"),
    "ARCH009": ("{member} writes past the log.", "Use the logger.", ["Inject a logger."], "log.Info(text);"),
    "ARCH010": ("Anyone can set {member}.", "Make it a property.", ["Add get and set."], "int Size { get; set; }"),
    "ARCH011": ("{member} says nothing.", "Use an attribute.", ["Replace it."], "[Audited]"),
    "ARCH012": ("The core depends on {member}.", "Turn the dependency round.", ["Move the type."], "interface IView"),
    "ARCH013": ("{member} makes its own context.", "Inject it.", ["Add a constructor parameter."], "Cart(IDb db)"),
    "ARCH014": ("The meaning of {member} is unknown.", "Name the number.", ["Declare a constant."], "const int Limit = 7;"),
    "ARCH015": ("{member} is hard to find.", "Give it a file.", ["Move it."], "Cart.cs"),
}

ADVICE = [(rule[0], *_TEXTS[rule[0]]) for rule in RULES]
ADVICE_SCHEMA = "rule_id string, rationale string, fix string, steps array<string>, example string"


def advice_table(spark):
    """One row per rule of the catalogue."""
    return inline_table(spark, ADVICE, ADVICE_SCHEMA)
