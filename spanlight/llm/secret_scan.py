"""Secret scans [native]: fixed patterns, and a randomness test battery with control of false discoveries.

Patterns find assignments, access keys and long hex strings.  Beside them every
run of encoded characters that holds a letter and a digit is a candidate.  Its
encoding is the first alphabet that has all its characters, and three tests ask
whether it could be drawn from that alphabet evenly and independently:

* chi-squared of its symbols' counts, as a gamma of the exact mean and variance
  for its length (Wilson-Hilferty), so that short runs with few symbols count right;
* the number of changes between the alphabet's halves (runs);
* the lag-one product of symbol values (serial correlation).

Their least p-value, Sidak-corrected, is near even on (0, 1) for secrets and
near 0 for words and numbers put together by people, the nearer the longer the
run.  So each class of lengths gets its own threshold: the random runs of a
class follow from how many p-values pass one half, the others among those above
a threshold are what these do not explain, and the lowest threshold is taken at
which they are at most Q of what is found.  A class without such a threshold
finds nothing.

A document is scanned within its row; what is gathered from the corpus is a
histogram of fixed size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

KEYWORDS = ("password", "passwd", "secret", "token")


def any_case(word: str) -> str:
    """A pattern for a word in ASCII letters of either case, and for nothing else that folds to them."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


ASSIGN = "(" + "|".join([*map(any_case, KEYWORDS), any_case("api") + "_?" + any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
RUN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: What a run holds that is a span of its own already.
FIXED = "AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Alphabets in order of their symbols' values; all have an even number of symbols.
ALPHABETS = [_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_"]
#: Lengths from which a class begins.
CLASSES = (16, 20, 24, 32, 48)
BINS = 64
#: The share of finds that may be false, as a fraction, and the largest threshold, in bins.
Q = (1, 10)
LAST_BIN = 16
#: Abramowitz and Stegun 26.2.17, the tail of the normal distribution.
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
ROOT = 0.3989422804014327
#: Matches whose places are added up together.
BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's matches, in code points, end exclusive.

    The gaps between matches and the matches add up to places; they are added
    within blocks and over blocks, which keeps long lists near linear.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).cast("bigint").alias("gap"), h.alias("hit")))

    def placed(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        length = lambda x: F.length(x["hit"]).cast("bigint")
        totals = F.transform(blocks, lambda b: F.struct(b.alias("pairs"), F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + length(x)).alias("size")))
        empty = "array<struct<base:bigint,pairs:array<struct<gap:bigint,hit:string>>>>"
        based = F.aggregate(
            totals,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(empty).alias("out")),
            lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("base"), x["pairs"].alias("pairs"))).cast(empty)).alias("out")),
            lambda a: a["out"],
        )
        spans = "array<struct<start:bigint,end:bigint,hit:string>>"
        inside = lambda b: F.aggregate(
            b["pairs"],
            F.struct(b["base"].alias("at"), F.array().cast(spans).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + length(x)).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + length(x)).alias("end"), x["hit"].alias("hit"))).cast(spans)).alias("out"),
            ),
            lambda a: a["out"],
        )
        return F.when(F.size(pairs) > 0, F.flatten(F.transform(based, inside))).otherwise(F.array().cast(spans))

    # A list of one binds what the block sums use again and again.
    found = F.element_at(F.transform(F.array(pairs), placed), 1)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))


def base_spans(row_assign: Column, text: Column) -> Column:
    """array<struct<start, kind, end>> of what the fixed patterns find; row_assign: `located` assignments."""
    of = lambda found, kind: F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= LEAST_VALUE
    long = lambda least: lambda s: s["end"] - s["start"] >= least
    return F.concat(
        of(F.filter(row_assign, value), 0),
        # Cheap tests first: texts without a long enough run are not cut.
        F.when(text.rlike(ACCESS), of(F.filter(located(text, ACCESS), long(LEAST_ACCESS)), 1)).otherwise(F.array().cast(SPANS)),
        F.when(text.rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), of(F.filter(located(text, HEX), long(LEAST_HEX)), 2)).otherwise(F.array().cast(SPANS)),
    )


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def pieces_of(text: Column, assigned: Column) -> Column:
    """array<struct<start, inside, piece>>: the text cut at the edges of its assignments."""
    cut = F.transform(
        assigned,
        lambda s, i: F.array(
            F.struct(F.coalesce(F.get(assigned, i - 1)["end"], F.lit(0).cast("bigint")).alias("start"), F.lit(False).alias("inside"), s["start"].alias("end")),
            F.struct(s["start"].alias("start"), F.lit(True).alias("inside"), s["end"].alias("end")),
        ),
    )
    last = F.struct(F.coalesce(F.get(assigned, F.size(assigned) - 1)["end"], F.lit(0).cast("bigint")).alias("start"), F.lit(False).alias("inside"), F.length(text).cast("bigint").alias("end"))
    return F.concat(F.flatten(cut), F.array(last))


def candidates(text: Column, assigned: Column) -> Column:
    """array<struct<start, end, fixed, body, alphabet>> of the runs that hold a letter and a digit and have an encoding.

    fixed: the run lies in an assignment or holds another fixed span.  Runs do
    not cross the edges of assignments.
    """
    gaps = F.split(text, ASSIGN, -1)
    whole = F.zip_with(
        pieces_of(text, assigned),
        # Gaps and matches alternate as the pieces do.
        F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(assigned, i)["hit"], F.lit(""))))),
        lambda p, t: F.struct(p["start"].alias("start"), p["inside"].alias("inside"), F.coalesce(t, F.lit("")).alias("piece")),
    )
    runs = F.flatten(
        F.transform(
            whole,
            lambda p: F.transform(
                located(p["piece"], RUN),
                lambda r: F.struct(
                    (p["start"] + r["start"]).alias("start"), (p["start"] + r["end"]).alias("end"), (p["inside"] | r["hit"].rlike(FIXED)).alias("fixed"), F.rtrim(r["hit"], F.lit("=")).alias("body")
                ),
            ),
        )
    )
    mixed = F.filter(runs, lambda r: r["body"].rlike("[0-9]") & r["body"].rlike("[A-Za-z]"))
    alphabet = lambda body: F.coalesce(*[F.when(F.translate(body, a, "") == "", F.lit(a)) for a in ALPHABETS])
    told = F.transform(mixed, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["fixed"].alias("fixed"), r["body"].alias("body"), alphabet(r["body"]).alias("alphabet")))
    found = F.filter(told, lambda r: r["alphabet"].isNotNull())
    return F.when(text.rlike(RUN), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,fixed:boolean,body:string,alphabet:string>>"))


def measured(found: Column) -> Column:
    """array<struct<start, end, fixed, n, a, squares, serial, changes>>: whole numbers from which the tests follow.

    squares: counts of symbols, squared and summed.  serial: products of
    neighbours' values, which run over the odd numbers from 1 - a to a - 1.
    changes: neighbours in different halves of the alphabet.
    """
    chars = lambda r: F.split(r["body"], "")
    one = lambda r, c: F.length(r["body"]) - F.length(F.replace(r["body"], c, F.lit("")))
    valued = F.transform(
        found,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["fixed"].alias("fixed"),
            F.length(r["body"]).cast("bigint").alias("n"),
            F.length(r["alphabet"]).cast("bigint").alias("a"),
            F.aggregate(F.array_distinct(chars(r)), F.lit(0).cast("bigint"), lambda s, c: s + one(r, c).cast("bigint") * one(r, c).cast("bigint")).alias("squares"),
            F.transform(chars(r), lambda c: (2 * F.position(c, r["alphabet"]) - F.length(r["alphabet"]) - 1).cast("bigint")).alias("values"),
        ),
    )
    products = F.transform(
        valued,
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("start", "end", "fixed", "n", "a", "squares")],
            F.zip_with(F.slice(r["values"], F.lit(1), F.size(r["values"]) - 1), F.slice(r["values"], F.lit(2), F.size(r["values"]) - 1), lambda x, y: x * y).alias("p"),
        ),
    )
    return F.transform(
        products,
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("start", "end", "fixed", "n", "a", "squares")],
            F.aggregate(r["p"], F.lit(0).cast("bigint"), lambda s, x: s + x).alias("serial"),
            F.size(F.filter(r["p"], lambda x: x < 0)).cast("bigint").alias("changes"),
        ),
    )


def tail(z: Column) -> Column:
    """P(Z > z) of a normal Z, for z >= 0."""
    t = 1 / (1 + TAIL[0] * z)
    poly = F.lit(0.0)
    for b in reversed(TAIL[1:]):
        poly = t * (F.lit(b) + poly)
    return ROOT * F.exp(-z * z / 2) * poly


def tested(of: Column) -> Column:
    """array<struct<start, end, fixed, class, bin>>: the bin of the combined p-value and the class of the length."""
    n, a = (lambda r: r["n"].cast("double")), (lambda r: r["a"].cast("double"))
    spread = lambda r: 2 * (n(r) - 1) / (9 * (a(r) - 1) * n(r))
    scored = F.transform(
        of,
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("start", "end", "fixed", "n")],
            ((F.cbrt((r["a"] * r["squares"] - r["n"] * r["n"]).cast("double") / n(r) / (a(r) - 1)) - (1 - spread(r))) / F.sqrt(spread(r))).alias("z1"),
            F.abs((2 * r["changes"] - (r["n"] - 1)).cast("double") / F.sqrt(n(r) - 1)).alias("z2"),
            F.abs(3 * r["serial"].cast("double") / (a(r) * a(r) - 1) / F.sqrt(n(r) - 1)).alias("z3"),
        ),
    )
    chances = F.transform(
        scored,
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("start", "end", "fixed", "n")],
            F.least(F.when(r["z1"] >= 0, tail(r["z1"])).otherwise(1 - tail(-r["z1"])), 2 * tail(r["z2"]), 2 * tail(r["z3"])).alias("p"),
        ),
    )
    sidak = lambda p: 1 - (1 - p) * (1 - p) * (1 - p)
    of_length = lambda n: sum((F.when(n >= c, 1).otherwise(0) for c in CLASSES[1:]), F.lit(0))
    return F.transform(
        chances,
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("start", "end", "fixed")],
            of_length(r["n"]).cast("int").alias("class"),
            F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(sidak(r["p"]) * BINS))).cast("int").alias("bin"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end), runs (start, end, fixed, class, bin) of every row, as a written table."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("assigned", located(F.col("text"), ASSIGN))
    rows = rows.withColumns({"base": base_spans(F.col("assigned"), F.col("text")), "found": candidates(F.col("text"), F.col("assigned"))})
    return scratch.written(rows.select("doc_id", F.col("base").cast(SPANS).alias("base"), tested(measured(F.col("found"))).alias("runs")), "secrets")


def thresholds(rows: DataFrame) -> list[int]:
    """The lowest bin that counts as random for each class of lengths; BINS where none does."""
    by = [[0] * BINS for _ in CLASSES]
    for r in rows.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").count().collect():  # classes x bins rows at most
        by[r["class"]][r["bin"]] = r["count"]
    return [lowest_bin(counts) for counts in by]


def lowest_bin(counts: list[int]) -> int:
    """The least bin j from 1 to LAST_BIN at which runs of no random origin are at most Q of those from j on.

    Random runs are even over the bins, so there are twice as many as in the
    upper half, where one is taken off; a share of them lies from j on.
    """
    random = 2 * max(0, sum(counts[BINS // 2 :]) - 1)
    for j in range(1, LAST_BIN + 1):
        found = sum(counts[j:])
        if found and Q[1] * (BINS * found - random * (BINS - j)) <= Q[0] * BINS * found:
            return j
    return BINS


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row: arrays of (start, kind, end) by start, then kind, an index of KINDS.

    spans has what base has, and runs that pass the battery and touch no base
    span.  Places are code points of the whole text, end exclusive.  Null
    texts are empty and have no spans; repeated rows count each and get equal
    answers; an empty table gives no rows; other columns are ignored.
    """
    rows = scanned(docs)
    least = F.array(*[F.lit(j) for j in thresholds(rows)])
    more = F.filter("runs", lambda r: ~r["fixed"] & (r["bin"] >= F.get(least, r["class"])))
    spans = F.concat("base", F.transform(more, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end"))).cast(SPANS))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
