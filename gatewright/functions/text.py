"""Column functions for report text. All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_str(text: str) -> str:
    """A text as a Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def sql_lookup(col: str, values: dict[str, str]) -> Column:
    """The value of a small fixed dictionary for a key column, null for other keys."""
    pairs = ", ".join(f"{sql_str(k)}, {sql_str(v)}" for k, v in values.items())
    return F.expr(f"try_element_at(map({pairs}), {col})")


def _replace(col: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


# Escapes of annotation lines, in the order they are applied.
DATA_ESCAPES = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
PROPERTY_ESCAPES = DATA_ESCAPES + [(":", "%3A"), (",", "%2C")]
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_data(col: Column) -> Column:
    return _replace(col, DATA_ESCAPES)


def escape_property(col: Column) -> Column:
    return _replace(col, PROPERTY_ESCAPES)


def html_escape(col: Column) -> Column:
    """Markup characters as entities; U+00A0..U+00FF and astral characters as numbers."""
    basic = _replace(col, HTML_ESCAPES)
    numeric = r"[\x{A0}-\x{FF}\x{10000}-\x{10FFFF}]"
    pieces = F.regexp_extract_all(
        basic, F.lit(r"[\x{A0}-\x{FF}\x{10000}-\x{10FFFF}]|[^\x{A0}-\x{FF}\x{10000}-\x{10FFFF}]+"), F.lit(0)
    )
    coded = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(f"^{numeric}$"), F.concat(F.lit("&#"), F.ascii(p), F.lit(";"))).otherwise(p),
        ),
        "",
    )
    return F.when(basic.rlike(numeric), coded).otherwise(basic)


def truncate_text(col: Column, limit: int, keep: int, notice: str, unit: str = "chars") -> Column:
    """Cut text over `limit` to `keep` characters and append the notice.

    `unit` says how the limit is measured: in characters or in UTF-8 bytes.
    """
    size = F.octet_length(col) if unit == "bytes" else F.length(col)
    cut = F.concat(F.substr(col, F.lit(1), F.lit(keep)), F.lit(notice))
    return F.when(size > limit, cut).otherwise(col)


# Size test and cut of the two report kinds.
SUMMARY_LIMIT_BYTES, SUMMARY_KEEP = 850 * 1024, 800 * 1024
COMMENT_LIMIT_CHARS, COMMENT_KEEP = 60_000, 58_000


def split_outside(col: Column, openers: str = "<([{", closers: str = ">)]}") -> Column:
    """The parts of a text between commas that stand in no bracket, however deep; an empty text has none.

    A fold over the text's brackets, commas and runs between them; the `>` of `=>` closes nothing.
    """
    pieces = F.regexp_extract_all(col, F.lit(r"=>|[<>()\[\]{},]|[^<>()\[\]{},=]+|="), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, piece: Column) -> Column:
        cut = (piece == ",") & (state["depth"] == 0)
        depth = state["depth"] + F.when(piece.isin(list(openers)), 1).when(piece.isin(list(closers)), -1).otherwise(0)
        return F.struct(
            F.greatest(depth, F.lit(0)).alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["part"], piece)).alias("part"),
            F.when(cut, F.concat(state["parts"], F.array(state["part"]))).otherwise(state["parts"]).alias("parts"),
        )

    whole = F.aggregate(pieces, start, step, lambda s: F.concat(s["parts"], F.array(s["part"])))
    return F.when(F.trim(col) == "", F.array().cast("array<string>")).otherwise(whole)


def relative_path(path: Column, base: str) -> Column:
    """The path as seen from the base folder, percent escapes decoded; `../` leads out of it.

    Paths of another root (scheme and host, drive) stay as they are. A `+` is a plain character in
    a path. A path that cannot be decoded is only made relative.
    """
    root = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:/*[^/]*)?/?"
    folder = base if base.endswith("/") else base + "/"
    base_root = F.regexp_extract(F.lit(folder), root, 0)
    steps = F.split(F.substr(F.lit(folder), F.length(base_root) + 1), "/")  # ends with an empty name
    names = F.split(F.substr(path, F.length(base_root) + 1), "/")
    most = F.least(F.size(steps), F.size(names)) - 1
    shared = F.coalesce(
        F.array_min(F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.get(steps, i) != F.get(names, i)))), F.lit(0))
    up = F.repeat(F.lit("../"), F.size(steps) - 1 - shared)
    rest = F.concat(up, F.array_join(F.slice(names, shared + 1, F.size(names)), "/"))
    decoded = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    same_root = F.regexp_extract(path, root, 0) == base_root
    return F.when(same_root & (base_root != ""), F.coalesce(decoded, rest)).otherwise(path)


# The formats of report times.
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"
SHOWN_FORMAT = "yyyy-MM-dd hh:mm:ss a"


def local_time(ts_utc: Column, zone: str = "Asia/Kolkata") -> Column:
    """UTC time as local wall-clock time (no zone)."""
    return F.from_utc_timestamp(ts_utc.cast("timestamp_ntz").cast("timestamp"), zone).cast("timestamp_ntz")


def local_stamp(ts_utc: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.date_format(local_time(ts_utc, zone), STAMP_FORMAT)


def local_shown(ts_utc: Column, zone: str = "Asia/Kolkata", suffix: str = " IST") -> Column:
    return F.concat(F.date_format(local_time(ts_utc, zone), SHOWN_FORMAT), F.lit(suffix))


def fill(template: Column, values: Column) -> Column:
    """Replace each `{name}` by its map value in one pass.

    Text put in is never looked at again, and a name without a value stays.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike(r"^\{\w+\}$"),
                F.coalesce(F.try_element_at(values, F.substr(p, F.lit(2), F.length(p) - 2)), p),
            ).otherwise(p),
        ),
        "",
    )
