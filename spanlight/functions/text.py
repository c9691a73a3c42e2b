"""Scalar functions over source lines and names, as column expressions (S-*, M-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\s\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether c holds one of the words (S-1, without lowering)."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def name_has(c: Column, words: list[str]) -> Column:
    """Whether the lower-case name holds one of the words (S-1)."""
    return contains_any(F.lower(c), words)


def _first(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def quoted(c: Column) -> Column:
    """Text between the first and the second quote; null if there are fewer (S-2)."""
    return _first(c, '"([^"]*)"')


def instrument_name(c: Column) -> Column:
    """The first quoted text after the first `name` (S-3)."""
    return _first(c, 'name[^"]*"([^"]*)"')


def is_fn_start(c: Column) -> Column:
    """Whether a trimmed line starts a plain function (S-5)."""
    return c.rlike("^(?:pub )?(?:async )?fn ")


def fn_name(c: Column) -> Column:
    """A trimmed line's function name: prefixes off, up to the first parenthesis; null if empty (S-4)."""
    bare = F.regexp_replace(c, "^(?:pub )*(?:async )*(?:fn )*", "")
    return F.nullif(trimmed(F.regexp_extract(bare, r"^([^(]*)\(", 1)), F.lit(""))


def sanitize_path(c: Column) -> Column:
    """A route path as part of a span name (S-6)."""
    return F.btrim(F.translate(c, "/:{}", "_"), F.lit("_"))


def endpoint_span(method: Column, path: Column) -> Column:
    """The span name of an endpoint (S-8)."""
    return F.concat(F.lower(method), F.lit("_"), sanitize_path(path))


def choose(c: Column, table: dict, otherwise: Column | None = None) -> Column:
    """A CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def span_name(kind: Column, function: Column) -> Column:
    """prefix.function for kinds with a prefix, else the function (S-7)."""
    prefix = choose(kind, K.KIND_PREFIXES)
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("."), function)).otherwise(function)


def mermaid_id(c: Column) -> Column:
    """An identifier that Mermaid accepts (S-9)."""
    return F.regexp_replace(c, "::|<|>| ", "_")


def module_path(file: Column) -> Column:
    """Modules of a file: what follows the first /src/; none for main, lib and other places (S-10)."""
    at = F.instr(file, "/src/")
    part = F.regexp_replace(F.substr(file, at + 5), r"(?:\.rs)+\z", "")
    return F.when((at == 0) | part.isin("main", "lib"), F.array().cast("array<string>")).otherwise(F.split(part, "/"))


def function_id(modules: Column, name: Column) -> Column:
    """module::path::name (S-11)."""
    return F.array_join(F.array_append(modules, name), "::")


def truncated(c: Column, length: int) -> Column:
    """At most `length` bytes, cut between characters and with an ellipsis (S-12)."""
    room = max(length - 3, 0)
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        full = s["full"] | (F.octet_length(s["out"]) + F.octet_length(x) > room)
        return F.struct(F.when(full, s["out"]).otherwise(F.concat(s["out"], x)).alias("out"), full.alias("full"))

    cut = F.aggregate(F.split(c, ""), state, step)["out"]
    return F.when(F.octet_length(c) <= length, c).otherwise(F.concat(cut, F.lit("...")))


def summary_line(label: Column, value: Column, width: int) -> Column:
    """label ..... value (S-13)."""
    dots = F.greatest(F.lit(width) - F.length(label) - F.length(value) - 2, F.lit(0))
    return F.concat(label, F.lit(" "), F.repeat(F.lit("."), dots), F.lit(" "), value)


def indentation(c: Column) -> Column:
    """The white space before a line's text (S-14)."""
    return F.regexp_extract(c, f"^({_SPACE}*)", 1)


def attribute_of(fix: Column) -> Column:
    """The attribute line of a suggested fix, or its first line (S-15)."""
    lines = F.split(fix, "\n", -1)
    found = F.filter(F.transform(lines, trimmed), lambda x: x.startswith("#[instrument"))
    return F.coalesce(F.get(found, F.lit(0)), F.get(lines, F.lit(0)))


def coverage_text(c: Column) -> Column:
    """Five characters wide with one decimal and a percent sign (S-17)."""
    return F.format_string("%5.1f%%", F.bround(c, 1))


def coverage_colour(c: Column) -> Column:
    """green from 80, yellow from 60, else red (S-17)."""
    return F.when(c >= 80, "green").when(c >= 60, "yellow").otherwise("red")


def coloured(c: Column, colour: Column | str, enabled: bool = True) -> Column:
    """A text between terminal codes, or as it is (S-17)."""
    if not enabled:
        return c
    code = choose(colour, {k: v for k, v in K.ANSI.items() if k != "reset"}) if isinstance(colour, Column) else F.lit(K.ANSI[colour])
    return F.concat(code, c, F.lit(K.ANSI["reset"]))


def coverage_bar(c: Column, width: int) -> Column:
    """A bar of `width` cells (S-17)."""
    full = F.floor(c / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.greatest(F.lit(width) - full, F.lit(0))), F.lit("]"))


def priority_score(c: Column) -> Column:
    """4 for Critical to 1 for Low (M-2)."""
    return choose(c, K.PRIORITY_SCORES)


def edge_weight(kind: Column, conditional: Column, loop: Column) -> Column:
    """Base weight of the kind, less where conditional, more in loops (M-1)."""
    return choose(kind, K.EDGE_BASES) * F.when(conditional, 0.8).otherwise(1.0) * F.when(loop, 1.5).otherwise(1.0)


def risk_level(cyclomatic: Column) -> Column:
    """Low up to 5, Medium up to 10, High up to 20, else Critical (M-3)."""
    return F.when(cyclomatic <= 5, "Low").when(cyclomatic <= 10, "Medium").when(cyclomatic <= 20, "High").otherwise("Critical")


def needs_refactoring(cyclomatic: Column, cognitive: Column, lines: Column, nesting: Column) -> Column:
    """Whether one of the limits is passed (M-4)."""
    return (cyclomatic > 10) | (cognitive > 15) | (lines > 50) | (nesting > 4)


def size_text(c: Column) -> Column:
    """Bytes with a unit and one decimal, halves to even (M-5)."""
    c = c.cast("double")
    return (
        F.when(c < 1024, F.format_string("%.1f B", F.bround(c, 1)))
        .when(c < 1024**2, F.format_string("%.1f KB", F.bround(c / 1024, 1)))
        .when(c < 1024**3, F.format_string("%.1f MB", F.bround(c / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(c / 1024**3, 1)))
    )


def duration_text(c: Column) -> Column:
    """Seconds as s, m s or h m (M-6)."""
    whole = lambda n: F.floor(c / n).cast("string")
    return (
        F.when(c < 60, F.concat(c.cast("string"), F.lit("s")))
        .when(c < 3600, F.concat(whole(60), F.lit("m "), (c % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(whole(3600), F.lit("h "), F.floor(c % 3600 / 60).cast("string"), F.lit("m")))
    )


def percent_text(c: Column) -> Column:
    """A share as a whole percentage (M-7)."""
    return F.format_string("%.0f", F.bround(c * 100, 0))


def quality_status(c: Column) -> Column:
    """OK from 0.8, WARN from 0.5, else BAD (M-9)."""
    return F.when(c >= 0.8, "OK").when(c >= 0.5, "WARN").otherwise("BAD")


def weighted_score(criticality: Column, errors: Column, external: Column, complexity: Column) -> Column:
    """The documented score of 0 to 100 from four shares of 0 to 1 (M-10)."""
    return criticality * 35 + errors * 25 + external * 25 + complexity * 15


def score_band(c: Column) -> Column:
    """The documented bands at 80, 60, 40 and 20 (M-10)."""
    return F.when(c >= 80, "Critical").when(c >= 60, "High").when(c >= 40, "Medium").when(c >= 20, "Low").otherwise("Minimal")


def is_retryable(kind: Column, io_kind: Column) -> Column:
    """Whether an error is worth another try: input or output that would block, was interrupted or timed out (R-12)."""
    return (kind == "Io") & F.coalesce(io_kind.isin(*K.RETRYABLE), F.lit(False))
