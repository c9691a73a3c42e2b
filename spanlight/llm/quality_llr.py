"""Quality rules [native]: hashed n-gram log-likelihood ratio, and whole-text rules before it.

Two multinomials over BUCKETS hashed n-grams are counted, one over every
document of the corpus and one over trusted documents.  A document's score is
the mean log ratio of its n-grams; a fixed threshold keeps or drops it.  The
log ratios are one array of BUCKETS whole numbers whatever the corpus, so a
document is scored within its row: no n-gram is ever shuffled for it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BUCKETS = 1 << 16
ORDERS = (1, 2)
SMOOTHING = 0.5
MIN_LLR = -0.2
WHITE = " \t\n\x0b\f\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def hashes_of(words: Column) -> Column:
    """A 64-bit name for each word, from which windows and n-grams are hashed."""
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column) -> Column:
    """A hash of each run of WINDOW words."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = scratch.keyed(docs).withColumn("words", words_of(F.col("text"))).withColumn("hashes", hashes_of(F.col("words")))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
            "full_lines": F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0),
            "windows": window_hashes(F.col("hashes")),
        }
    )
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("bigint"),
            # Only texts with a repeated window pay for sorting their windows.
            # A hash of the words themselves stands beside that of their names.
            "ordered": F.when(
                F.size(F.array_distinct("windows")) < F.size("windows"),
                F.array_sort(F.transform("windows", lambda h, i: F.struct(F.struct(h.alias("a"), F.xxhash64(F.lit(1), F.slice("words", i + 1, WINDOW)).alias("b")).alias("h"), i.alias("p")))),
            ),
        }
    )
    same = lambda i, x: F.coalesce(F.get("ordered", i)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("places", F.array_sort(F.transform(F.filter("ordered", lambda x, i: ((i > 0) & same(i - 1, x)) | same(i + 1, x)), lambda x: x["p"])))
    step = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1), p + WINDOW) - p))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return rows.select("doc_id", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_hashes(hashes: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """A hash of each n-gram of each order, from the hashes of the words."""

    def of(n: int) -> Column:
        if n == 1:
            return hashes
        head = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
        return F.transform(head, lambda h, i: F.xxhash64(F.lit(n), h, *[F.get(hashes, i + k) for k in range(1, n)]))

    return F.concat(*[of(n) for n in orders])


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all good, harmless labelled documents."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """gram, llr: smoothed log(p_target / p_corpus) of each bucket that the corpus holds."""
    ids = trusted.select(F.col("doc_id").alias("t_id"), F.lit(1).alias("t_one"))
    # Only texts that may be trusted are shuffled.
    some, others = scratch.split_by_ids(docs.select("doc_id", "text"), trusted, "doc_id")
    marked = some.join(ids, F.col("doc_id") == F.col("t_id"), "left").select("t_one", "text")
    marked = marked.unionByName(others.select(F.lit(None).cast("int").alias("t_one"), "text"))
    grams = (
        marked.select("t_one", hashes_of(words_of(F.col("text"))).alias("hashes"))
        .select("t_one", F.explode(gram_hashes(F.col("hashes"), orders)).alias("gram"))
        .select("t_one", bucket_of(F.col("gram"), buckets).alias("gram"))
    )
    counts = scratch.written(grams.groupBy("gram").agg(F.count("*").alias("n_raw"), F.count("t_one").alias("n_target")), "llr-counts")
    total = counts.agg(F.coalesce(F.sum("n_raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("n_target"), F.lit(0)).alias("target")).first()
    if not total["target"]:
        return counts.select("gram", F.lit(0.0).alias("llr"))
    shift = math.log(total["raw"] + smoothing * buckets) - math.log(total["target"] + smoothing * buckets)
    return counts.select("gram", (F.log(F.col("n_target") + smoothing) - F.log(F.col("n_raw") + smoothing) + shift).alias("llr"))


FIXED = 1 << 32


def score_of(hashes: Column, ratios: Column, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Column:
    """The mean of the n-grams' ratios, summed as whole numbers of 1 / FIXED; null without n-grams."""
    grams = gram_hashes(hashes, orders)
    total = F.aggregate(grams, F.lit(0).cast("bigint"), lambda a, g: a + F.get(ratios, bucket_of(g, buckets)))
    return F.when(F.size(hashes) > 0, total / F.size(grams) / FIXED)


def ratio_list(ratios: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The log ratio of each bucket in units of 1 / FIXED, 0 where the corpus holds none."""
    out = [0] * buckets
    for r in ratios.select("gram", F.round(F.col("llr") * FIXED).cast("bigint").alias("v")).collect():  # `buckets` rows at most
        out[r["gram"]] = r["v"]
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, min_llr: float = MIN_LLR, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of every row.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of them
    in repeated windows.  llr is the mean log ratio of the n-grams, rounded to
    9 digits; ratios are summed as whole numbers, so that no order of additions
    can move a verdict; null for a text with no words.  kept: not base_failed
    and llr >= min_llr.  Without trusted documents every llr is 0.  Null texts
    have no words; rows that repeat get equal answers each; an empty table
    gives no rows.
    """
    # `buckets` numbers become a constant of the plan; as a column they would be copied for every row.
    ratios = F.from_json(F.lit(json.dumps(ratio_list(log_ratios(docs, trusted_ids(labels), orders, buckets), buckets))), "array<bigint>")
    rows = base_measures(docs).withColumn("llr", F.round(score_of(F.col("hashes"), ratios, orders, buckets), 9))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *measures, "base_failed", "llr", (~F.col("base_failed") & F.coalesce(F.col("llr") >= min_llr, F.lit(False))).alias("kept"))
