"""One query for each operator of this subpackage, with production parameters, and its SQL.

Each query hands its whole table to the operator and derives the columns of
its contract from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, cotraining, decontaminate, line_dedup, mixing, order_minhash, pii, quality_llr, recompression, secret_scan, training_order, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session; the one given here is for the synthetic tables, which hide nobody."""
    return pii.replace_pii(_table(spark, sf_dir, "documents"), spark.conf.get("spark.spanlight.pii.key", "key of the synthetic tables"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("tid")


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "p_low_quality", "p_toxic", "kept")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(_table(spark, sf_dir, "documents"))


def op5_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("repeats")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    n_hit = decontaminate.covered_words()
    return out.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive_records(warc.responses_of(_table(spark, sf_dir, "pages")))
    return made.withColumnRenamed("key", "page_id")


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, mode="all")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compressed(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)
    return out.drop("label").withColumnRenamed("key", "vec_id")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.clustered(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, salt=3)
    return out.withColumnRenamed("key", "vec_id")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secret_scan.spelled(F.col("base")), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_order_minhash": op2_order_minhash,
    "op3_co_training": op3_co_training,
    "op4_training_order": op4_training_order,
    "op5_ngram_llr": op5_ngram_llr,
    "op6_mix_sources": op6_mix_sources,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_recompression": op9_recompression,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroids": op12_centroids,
    "op13_secret_scan": op13_secret_scan,
}

WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM totals),
ranked AS (
  SELECT *, sum(w) OVER () AS w_all, sum(source_size) OVER () AS size_all,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM weighed
  WINDOW b AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (w_all - w_before) <= (size_all - cap_before) * w AS is_capped FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap::DOUBLE
              ELSE (size_all - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0))::DOUBLE * w::DOUBLE
                   / (w_all - coalesce(sum(CASE WHEN is_capped THEN w END) OVER (), 0))::DOUBLE END AS target
  FROM capped),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
leaves AS (
  SELECT source, place, sum(size) AS leaf, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto
  FROM sized GROUP BY source, place),
edges AS (
  SELECT b.source, min(l.place) AS edge FROM leaves l JOIN budgets b ON l.source IS NOT DISTINCT FROM b.source
  WHERE l.upto > b.target - b.whole * b.source_size AND b.target - b.whole * b.source_size > 0 GROUP BY b.source),
cuts AS (
  SELECT b.*, CASE WHEN e.edge IS NULL THEN 0
                   WHEN (b.target - b.whole * b.source_size - (l.upto - l.leaf)) * 2 >= l.leaf THEN e.edge + 1 ELSE e.edge END AS below
  FROM budgets b LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM b.source
  LEFT JOIN leaves l ON l.source IS NOT DISTINCT FROM b.source AND l.place = e.edge)
SELECT s.doc_id, s.size, c.source_size, c.target,
       (s.size * (c.whole + CASE WHEN s.place < c.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""

ORACLE_SQL["op10_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""

ORACLE_SQL["op7_decontaminate"] = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL),
bp AS (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM bw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS w FROM bp),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM dw, ks WHERE len(ws) >= k),
hits AS (SELECT doc_id, item_id, p, win.k FROM dp JOIN win ON dp.k = win.k AND array_to_string(list_slice(ws, p, p + dp.k - 1), ' ') = win.w),
spots AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op9_recompression"] = f"""
WITH dw AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM dw),
wins AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p, p + 49), ' ')) AS h
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM dw WHERE len(ws) >= 50)),
dups AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM wins) WHERE first < doc_id),
marked AS (
  SELECT words.doc_id, words.p, w,
         coalesce(max(CASE WHEN dups.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM words LEFT JOIN dups ON dups.doc_id = words.doc_id AND dups.p = words.p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
WHOLE_SQL = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Full scans in every round; a vector without a number is told apart by rid."""
    dot = "list_dot_product(v::DOUBLE[], e::DOUBLE[])"
    near = "(list_dot_product(v::DOUBLE[], v::DOUBLE[]) - 2 * {0} + list_dot_product(e::DOUBLE[], e::DOUBLE[]))::BIGINT".format(dot)
    out = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, {WHOLE_SQL} AS v FROM embeddings WHERE {FINITE_SQL} AND len(embedding) > 0),
seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS i, v FROM kept ORDER BY vec_id NULLS LAST, v LIMIT {entries}),
pieces AS MATERIALIZED (SELECT rid, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, i, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS e FROM seeds, range({parts}) t(p))"""]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT rid, p, min(struct_pack(d := {near}, i := i)) AS m FROM pieces JOIN b{n} USING (p) GROUP BY rid, p)")
        if n < rounds:
            out.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(u.e, b.e) AS e FROM b{n} b LEFT JOIN (
    SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (
      SELECT p, m.i AS i, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{n} JOIN pieces USING (rid, p), range(1, len(v) + 1) t(j) GROUP BY 1, 2, 3)
    GROUP BY p, i) u USING (p, i))""")
    last = f"a{rounds}"
    out.append(f"""coded AS (SELECT rid, string_agg(lpad(lower(to_hex(m.i)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM {last} GROUP BY rid)""")
    digest = f"(SELECT sha256(coalesce(string_agg(array_to_string(e, ','), ',' ORDER BY p, i), '')) FROM b{rounds})"
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM kept JOIN coded USING (rid)"""


def _centroids_sql(k: int = 8, rounds: int = 10, width: int = 64, salt: int = 3) -> str:
    """All distances over the vectors themselves."""
    near = "list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, {WHOLE_SQL} AS v FROM embeddings WHERE {FINITE_SQL} AND len(embedding) = {width}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS e
  FROM (SELECT sha256('{salt}:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {near}, c := c)) AS m FROM kept, c{n} GROUP BY rid)")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(u.e, c.e) AS e FROM c{n} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (
      SELECT m.c AS c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{n} JOIN kept USING (rid), range(1, {width} + 1) t(j) GROUP BY 1, 2)
    GROUP BY c) u USING (c))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} c ON c.c = m.c"""


ORACLE_SQL["op11_vector_codes"] = _vector_codes_sql()
ORACLE_SQL["op12_centroids"] = _centroids_sql()


def _secret_scan_sql() -> str:
    """Matches as rows; places by window sums over gaps and matches."""
    q = lambda x: x.replace("'", "''")
    place = """sum(len(gap)) OVER w + coalesce(sum(len(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""

    def matches(source: str, text: str, by: str, pattern: str) -> str:
        return f"""SELECT *, ({place})::BIGINT AS start, ({place})::BIGINT + len(hit) AS stop FROM (
    SELECT {by}, i, hits[i] AS hit, gaps[i] AS gap FROM (
      SELECT {by}, regexp_extract_all({text}, '{q(pattern)}') AS hits, string_split_regex({text}, '{q(pattern)}') AS gaps FROM {source}),
      unnest(range(1, len(hits) + 1)) u(i))
  WINDOW w AS (PARTITION BY {by} ORDER BY i)"""

    alphabet = "CASE " + " ".join(f"WHEN translate(body, '{a}', '') = '' THEN '{a}'" for a in secret_scan.ALPHABETS) + " END"
    t = f"(1 / (1 + {secret_scan.TAIL[0]} * z))"
    poly = "0.0::DOUBLE"
    for b in reversed(secret_scan.TAIL[1:]):
        poly = f"{t} * ({b}::DOUBLE + {poly})"
    tail = f"({secret_scan.ROOT}::DOUBLE * exp(-z * z / 2) * ({poly}))".replace("(1 / (1 + ", "(1 / (1::DOUBLE + ")
    of = lambda z: tail.replace("z", z)
    classes = " + ".join(f"(n >= {c})::INTEGER" for c in secret_scan.CLASSES[1:])
    bins, last, (num, den) = secret_scan.BINS, secret_scan.LAST_BIN, secret_scan.Q
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
assigned AS MATERIALIZED (
  {matches("docs", "t", "rid", secret_scan.ASSIGN)}),
access AS ({matches("docs", "t", "rid", secret_scan.ACCESS)}),
hexes AS ({matches("docs", "t", "rid", secret_scan.HEX)}),
base AS MATERIALIZED (
  SELECT rid, start, 0 AS kind, stop FROM assigned WHERE len(regexp_extract(hit, '{q(secret_scan.ASSIGN)}', 2)) >= 6
  UNION ALL SELECT rid, start, 1, stop FROM access WHERE len(hit) >= 20
  UNION ALL SELECT rid, start, 2, stop FROM hexes WHERE len(hit) >= 24),
pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS pid, * FROM (
    SELECT rid, start AS began, true AS inside, hit AS piece FROM assigned
    UNION ALL SELECT rid, start - len(gap), false, gap FROM assigned
    UNION ALL SELECT rid, coalesce(stop, 0), false, substr(t, coalesce(stop, 0)::INTEGER + 1)
              FROM docs LEFT JOIN (SELECT rid, max(stop) AS stop FROM assigned GROUP BY rid) USING (rid))),
runs AS (
  SELECT p.rid, began + r.start AS start, began + stop AS stop, inside OR regexp_matches(hit, '{secret_scan.FIXED}') AS fixed, rtrim(hit, '=') AS body
  FROM ({matches("pieces", "piece", "pid", secret_scan.RUN)}) r JOIN pieces p USING (pid)),
coded AS (
  SELECT *, {alphabet} AS alphabet, len(body) AS n FROM runs WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]')),
valued AS (
  SELECT rid, start, stop, fixed, n, len(alphabet) AS a,
         list_sum(list_transform(list_distinct(string_split(body, '')), lambda c: (n - len(replace(body, c, ''))) * (n - len(replace(body, c, '')))))::BIGINT AS squares,
         list_transform(string_split(body, ''), lambda c: 2 * strpos(alphabet, c) - len(alphabet) - 1) AS v
  FROM coded WHERE alphabet IS NOT NULL),
measured AS (
  SELECT * EXCLUDE (pr), list_sum(pr)::BIGINT AS serial, len(list_filter(pr, lambda x: x < 0)) AS changes
  FROM (SELECT *, list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1]) AS pr FROM valued)),
scored AS (
  SELECT *, (cbrt((a * squares - n * n)::DOUBLE / n::DOUBLE / (a::DOUBLE - 1)) - (1 - s)) / sqrt(s) AS z1,
         abs((2 * changes - (n - 1))::DOUBLE / sqrt(n::DOUBLE - 1)) AS z2, abs(3 * serial::DOUBLE / (a::DOUBLE * a::DOUBLE - 1) / sqrt(n::DOUBLE - 1)) AS z3
  FROM (SELECT *, 2 * (n::DOUBLE - 1) / (9 * (a::DOUBLE - 1) * n::DOUBLE) AS s FROM measured)),
chances AS (
  SELECT *, least(CASE WHEN z1 >= 0 THEN {of("abs(z1)")} ELSE 1 - {of("abs(z1)")} END, 2 * {of("z2")}, 2 * {of("z3")}) AS p FROM scored),
binned AS MATERIALIZED (
  SELECT rid, start, stop, fixed, {classes} AS class, greatest(0, least({bins - 1}, floor((1 - (1 - p) * (1 - p) * (1 - p)) * {bins})))::INTEGER AS bin FROM chances),
uppers AS (SELECT class, 2 * greatest(0, count(*) FILTER (WHERE bin >= {bins // 2}) - 1) AS random FROM binned GROUP BY class),
cuts AS (
  SELECT class, min(j) AS cut FROM (
    SELECT class, j, random, count(*) FILTER (WHERE bin >= j) AS found FROM binned JOIN uppers USING (class), range(1, {last + 1}) t(j) GROUP BY ALL)
  WHERE found > 0 AND {den} * ({bins} * found - random * ({bins} - j)) <= {num} * {bins} * found GROUP BY class),
spans AS (
  SELECT rid, start, kind, stop, true AS is_base FROM base
  UNION ALL SELECT rid, start, 3, stop, false FROM binned JOIN cuts USING (class) WHERE NOT fixed AND bin >= cut),
named AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS s FROM spans),
told AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE is_base) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (rid)"""


ORACLE_SQL["op13_secret_scan"] = _secret_scan_sql()
