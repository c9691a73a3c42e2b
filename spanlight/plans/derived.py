"""Source trees, manifests, graphs and findings that Spark and SQL derive from the given tables alike.

Each table is one SELECT that Spark and DuckDB read the same way: documents
become source files, suppliers the dependencies of their nation's project,
customers the functions, orders the calls between them, parts the metrics of
functions, events the instrumentation that is there.  Every row of the given
tables takes part, so what queries do grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import written

_BASE = ("documents", "supplier", "customer", "orders", "part", "events", "pages")


def _lines(*parts: str) -> str:
    """SQL for lines of text, each with its line end; braces are doubled, as names of tables stand in single ones."""
    return " || ".join(f"{p} || chr(10)" for p in parts).replace("{", "{{").replace("}", "}}")


#: A word of a document's text, and a name that no other document has.
_WORD = "CASE WHEN regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) = '' THEN 'none' ELSE lower(regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1)) END"
_CODE = _lines(
    "CASE doc_id % 4 WHEN 0 THEN 'use axum::Router;' WHEN 1 THEN 'use actix_web::get;' WHEN 2 THEN 'use tonic::Request;' ELSE 'use std::fs;' END",
    "'/// Serves ' || w || '.'",
    "'pub fn app_' || n || '() {'",
    "'    let r = Router::new()'",
    "'        .route(\"/' || w || '/:id\", get(show_' || n || ').post(save_' || n || '))'",
    "'        .route(\"/' || w || '/{id}/x\", put('",
    "'            save_' || n || '))'",
    "'        .route(\"/list\", post(list_' || n || '));'",
    "'}'",
    "'#[get(\"/' || w || '/' || doc_id || '\")]'",
    "CASE doc_id % 6 WHEN 0 THEN '// mock! of ' || w WHEN 1 THEN '// contains ' || w ELSE '// lists' END",
    "'pub async fn list_' || n || '() {}'",
    "CASE doc_id % 3 WHEN 0 THEN '#[instrument(name = \"db.' || w || '\", token)]' WHEN 1 THEN '#[tracing::instrument(err = true, body)]' ELSE '// plain' END",
    "'async fn show_' || n || '(req: Request<Hello>) {'",
    "CASE doc_id % 5 WHEN 0 THEN '    info!(\"seen\");' WHEN 1 THEN '    counter!(\"d\");' WHEN 2 THEN '    let s = info_span!(\"work ' || w || '\");' WHEN 3 THEN '    tracing::debug!(\"x\");' ELSE '    let y = 1;' END",
    "'}'",
    "''",
    "'fn save_' || n || '(id: u64) -> Result<(), String> { let v = load()?; Ok(()) }'",
    "'#[cfg(test)]'",
    "'mod tests {'",
    "'    use super::*;'",
    "'    #[test]'",
    "'    fn test_' || n || '() { assert_eq!(1, 1); let x = load().unwrap(); }'",
    "'}'",
)
_NAMED = f"(SELECT doc_id, coalesce(lang, 'xx') AS lang, coalesce(text, '') AS t, {_WORD} AS w, {_WORD} || '_' || doc_id AS n FROM {{documents}}) d"
_PROJECT = "'n' || doc_id % 25"
_FILE = f"{_PROJECT} || '/src/' || lang || '/d' || doc_id || '.rs'"
#: The number of the line on which a document's code begins.
_FIRST = "CAST(length(t) - length(replace(t, chr(10), '')) + 2 AS INT)"
_FIX = "'#[instrument(name = \"get_' || w || '\")]'"

_VERBS = ["fetch_user", "query_all", "cache_get", "validate", "handle_error", "checkout", "send_request", "plain", "connect", "retry_later", "get_page", "island"]
_ID = "lower(c_mktsegment) || '::' || CASE CAST(floor(abs(c_acctbal)) AS INT) % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERBS)) + " END || '_' || c_custkey"
_CRATES = ["axum", "sqlx", "reqwest", "redis", "tracing", "tracing-subscriber", "actix-web", "tonic", "serde", "env_logger", "diesel", "rocket", "moka", "warp"]
_EDGE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Direct' WHEN '2-HIGH' THEN 'Indirect' WHEN '3-MEDIUM' THEN 'Dynamic' WHEN '5-LOW' THEN 'Closure' ELSE 'Trait' END AS kind,
  o_orderstatus = 'F' AS is_conditional, o_orderkey % 3 = 0 AS is_in_loop"""
_IDS = f"(SELECT c_custkey, c_nationkey, {_ID} AS id FROM {{customer}})"

TABLES = {
    "fx_files": f"SELECT {_PROJECT} AS project, {_FILE} AS file, t || chr(10) || {_CODE} AS source FROM {_NAMED}",
    # The code alone, which parses.
    "fx_sources": f"SELECT {_FILE} AS file, {_CODE} AS source FROM {_NAMED}",
    "fx_deps": "SELECT 'n' || s_nationkey AS project, 'n' || s_nationkey AS package, CASE s_suppkey % 14 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CRATES)) + " END AS dep_name, CASE s_suppkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'build' ELSE 'normal' END AS dep_kind FROM {supplier}",
    "fx_nodes": f"""SELECT 'n' || c_nationkey AS project, {_ID} AS id, 'c_' || c_custkey AS name, CASE WHEN c_acctbal > 9000 THEN 'Endpoint' WHEN c_acctbal < 500 THEN 'Test' ELSE 'Internal' END AS kind,
  'n' || c_nationkey || '/src/c.rs' AS file, CAST(1 + c_custkey AS INT) AS line FROM {{customer}} WHERE c_acctbal >= 0""",
    # The customer of each order calls that of the next.
    "fx_edges": f"SELECT a.id AS src, b.id AS dst, {_EDGE} FROM (SELECT x.*, y.o_custkey AS next_key FROM {{orders}} x JOIN {{orders}} y ON y.o_orderkey = x.o_orderkey + 1) o JOIN {_IDS} a ON a.c_custkey = o_custkey JOIN {_IDS} b ON b.c_custkey = next_key",
    # The calls within a project; such a graph is sparse and has few cycles.
    "fx_hops": f"SELECT a.id AS src, b.id AS dst, {_EDGE} FROM (SELECT x.*, y.o_custkey AS next_key FROM {{orders}} x JOIN {{orders}} y ON y.o_orderkey = x.o_orderkey + 1) o JOIN {_IDS} a ON a.c_custkey = o_custkey JOIN {_IDS} b ON b.c_custkey = next_key AND b.c_nationkey = a.c_nationkey",
    "fx_points": f"""SELECT 'f' || o_custkey AS file, CAST(o_orderkey % 500 AS INT) AS line, id AS function_name,
  CASE o_orderkey % 7 WHEN 0 THEN 'Endpoint' WHEN 1 THEN 'DatabaseCall' WHEN 2 THEN 'ExternalApiCall' WHEN 3 THEN 'CacheOperation' WHEN 4 THEN 'ErrorBoundary' ELSE 'BusinessLogic' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
  CASE o_orderkey % 11 WHEN 0 THEN 'api.show' WHEN 1 THEN 'db.save' WHEN 2 THEN 'password_job' WHEN 3 THEN 'ext.call' WHEN 4 THEN 'cache.token' ELSE 'run_' || o_orderkey END AS suggested_span_name
  FROM {{orders}} JOIN {_IDS} c ON c_custkey = o_custkey""",
    "fx_existing": f"""SELECT 'f' || user_id AS file, CAST(event_id % 500 AS INT) AS line, CASE WHEN event_id % 40 = 0 THEN coalesce(id, '') ELSE '' END AS function_name,
  CASE event_type WHEN 'click' THEN 'TracingInstrument' WHEN 'view' THEN 'ManualSpan' WHEN 'error' THEN 'LogMacro' ELSE 'Metrics' END AS kind,
  CASE WHEN event_type NOT IN ('click', 'view') THEN NULL ELSE CASE event_id % 9 WHEN 0 THEN 'api.show' WHEN 1 THEN 'sql_save' WHEN 2 THEN 'redis password' WHEN 3 THEN 'external' WHEN 4 THEN 'grpc.token' WHEN 5 THEN 'http_in' ELSE 'plain' END END AS span_name,
  CAST(0.7 AS DOUBLE) AS score FROM {{events}} LEFT JOIN {_IDS} c ON c_custkey = user_id""",
    "fx_functions": """SELECT CAST(p_partkey AS INT) AS ord, 'f' || p_size || '.rs' AS file, 'fn_' || p_partkey AS name, p_partkey % 3 = 0 AS is_async, p_partkey % 7 = 0 AS is_test, CAST(floor(p_retailprice) AS INT) % 29 AS cyclomatic,
  CAST(floor(p_retailprice) AS INT) % 23 AS cognitive, 2 * p_size AS lines_of_code, p_size % 7 AS max_nesting_depth, CAST(CASE WHEN p_partkey % 6 = 0 THEN p_size ELSE 0 END AS INT) AS unwrap_calls, CAST(CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS expect_calls,
  CAST(p_partkey % 2 AS INT) AS question_mark_ops, CAST(CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS INT) AS error_matches, CAST(CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS INT) AS error_if_lets, CAST(p_partkey % 4 AS INT) AS result_returns FROM {part}""",
    "fx_calls": """SELECT CAST(o_orderkey AS INT) AS call_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'm' || o_custkey % 25 WHEN 2 THEN 'm' || o_custkey % 25 || '::v1' ELSE 'm' || o_orderkey % 25 END AS module,
  CASE o_orderkey % 7 WHEN 0 THEN 'std::fs::read' WHEN 1 THEN 'al' || o_custkey % 10 || '::f' || o_orderkey % 300 WHEN 2 THEN 'unknown::thing' WHEN 3 THEN 'al' || o_orderkey % 40 WHEN 4 THEN 'serde::to' ELSE 'f' || o_custkey END AS path FROM {orders}""",
    "fx_symbols": "SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'f' || c_custkey WHEN 1 THEN 'm' || c_custkey % 25 || '::v1::f' || c_custkey ELSE 'm' || c_custkey % 25 || '::f' || c_custkey END AS full_path FROM {customer}",
    "fx_imports": "SELECT 'al' || s_suppkey AS local_name, CASE WHEN s_suppkey % 3 = 0 THEN 'm' || s_nationkey || '::f' || s_suppkey ELSE 'm' || s_nationkey END AS full_path FROM {supplier}",
    "fx_gaps": f"""SELECT {_FILE} AS file, {_FIRST} + 13 AS line, 'show_' || n AS function_name, {_FIX} AS suggested_fix, CASE WHEN doc_id % 2 = 0 THEN 'Critical' ELSE 'Major' END AS severity, 1 AS ord FROM {_NAMED}
  UNION ALL SELECT {_FILE}, {_FIRST} + 17, 'save_' || n, '  #[instrument(name = "save")]' || chr(10) || 'fn save(...) {{{{ ... }}}}', 'Minor', 2 FROM {_NAMED}
  UNION ALL SELECT {_FILE}, {_FIRST} + 9, 'list_' || n, 'no attribute here', 'Major', 3 FROM {_NAMED} WHERE doc_id % 4 = 0
  UNION ALL SELECT {_FILE}, 9999999, 'lost_' || n, '#[instrument(name = "lost")]', 'Major', 4 FROM {_NAMED} WHERE doc_id % 5 = 0
  UNION ALL SELECT 'gone/d' || doc_id || '.rs', 3, 'gone_' || n, '#[instrument(name = "gone")]', 'Critical', 1 FROM {_NAMED} WHERE doc_id % 10 = 0""",
}


TEXTS = ("fx_files", "fx_sources")


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def values(name: str) -> str:
    """`name AS (SELECT ...)` for a WITH clause over the given tables."""
    text = TABLES[name]
    return f"{name} AS ({text.format(**{t: t for t in _names(text)})})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same rows as `values` has, over the tables in sf_dir."""
    text = TABLES[name]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _names(text)}
    rows = spark.sql(text, **given)
    # Texts are written, so that no filter on them repeats what makes them.
    return written(rows, name) if name in TEXTS else rows
