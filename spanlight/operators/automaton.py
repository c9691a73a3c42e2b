"""Many patterns over one text: an automaton of the literals that patterns need (P-4, J-13, S-16, V-5).

A plain pattern is found where its text is.  A regular expression that needs a
literal can only match where that literal is.  All these literals form one
Aho-Corasick automaton, which passes a text once however many patterns there
are; a text goes on only with the patterns whose literal it holds, and only
regular expressions among them are then evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import map_arrow

Pattern = tuple[str, str, float, bool]


def required_literal(pattern: str) -> str:
    """The longest text that every match of a regular expression holds, '' if none is certain.

    Only literals in a row count that stand outside of groups, choices and
    repeats; what the standard parser can't read, or what sets flags, needs
    nothing for certain.
    """
    try:
        tree = re._parser.parse(pattern)  # the same syntax as the evaluating engine's, as far as single literals go
    except re.error:
        return ""
    if tree.state.flags & re.IGNORECASE or "\\Q" in pattern or "(?" in pattern:
        return ""
    best = run = ""
    for op, value in tree:
        run = run + chr(value) if str(op) == "LITERAL" else ""
        best = max(best, run, key=len)
    return best


def literals_of(patterns: list[Pattern]) -> list[str]:
    """The literal that each pattern needs; '' for one that must see every text."""
    return [required_literal(p) if is_regex else p for _, p, _, is_regex in patterns]


def _finder(literals: list[str], is_regex: list[bool], keep: str):
    always = [i for i, word in enumerate(literals) if not word]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_word: dict[str, list[int]] = {}
        for i, word in enumerate(literals):
            if word:
                by_word.setdefault(word, []).append(i)
        machine = ahocorasick.Automaton()
        for word, owners in by_word.items():
            machine.add_word(word, owners)
        if by_word:
            machine.make_automaton()
        for batch in batches:
            rows, hits, texts = [], [], []
            column = batch.column(1)
            for r in range(batch.num_rows):
                text = column[r].as_py()
                if text is None:
                    continue
                found = set(always)
                if by_word:
                    # A text is passed once; what ends at a place tells which literals are there.
                    for _, owners in machine.iter(text):
                        found.update(owners)
                if found:
                    rows.append(r)
                    hits.append(sorted(found))
                    texts.append(text if any(is_regex[i] for i in found) else None)
            taken = pc.take(batch.column(0), pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.int32()))], names=[keep, "text", "hits"])

    return run


def candidates(texts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """doc, text, hits: the indexes of the patterns whose literal a text holds, for texts with any.

    text is null where no regular expression is among them.  Null texts hold
    nothing.
    """
    kind = texts.schema["doc"].dataType.simpleString()
    finder = _finder(literals_of(patterns), [p[3] for p in patterns], "doc")
    return map_arrow(texts.select("doc", "text"), finder, f"doc {kind}, text string, hits array<int>")


def matches(texts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """doc, ord, grp, pattern, weight, matched: each match of a regular expression, and each plain pattern once for a text that holds it.

    Facts of patterns are one constant of the plan; regular expressions are
    literals of it, so that each is compiled once.
    """
    rows = candidates(texts, patterns)
    plain = F.transform(
        F.filter("hits", lambda i: ~F.array_contains(F.array(*[F.lit(k) for k, p in enumerate(patterns) if p[3]]).cast("array<int>"), i)),
        lambda i: F.struct(i.alias("ord"), F.get(F.array(*[F.lit(p[1]) for p in patterns]), i).alias("matched")),
    )
    parts = [plain.cast("array<struct<ord:int,matched:string>>")]
    for k, (_, pattern, _, is_regex) in enumerate(patterns):
        if is_regex:
            found = F.regexp_extract_all("text", F.lit(pattern.replace("$", r"\z")), F.lit(0))
            parts.append(F.when(F.array_contains("hits", k), F.transform(found, _with_order(k))).otherwise(F.array()).cast("array<struct<ord:int,matched:string>>"))
    told = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(p).alias("pattern"), F.lit(float(w)).alias("weight")) for g, p, w, _ in patterns])
    one = rows.select("doc", F.explode(F.concat(*parts)).alias("x"))
    return one.select("doc", "x.ord", F.get(told, F.col("x.ord")).alias("of"), "x.matched").select("doc", "ord", "of.grp", "of.pattern", "of.weight", "matched")


def _with_order(k: int):
    return lambda m: F.struct(F.lit(k).alias("ord"), m.alias("matched"))
