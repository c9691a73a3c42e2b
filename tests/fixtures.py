"""Small sources and tables with corner cases, as Spark rows and as SQL VALUES, for queries that otherwise read derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


SHOP = '''//! Shop service
#![allow(dead_code)]

use axum::{routing::get, Router};
use sqlx::PgPool;

pub fn app(pool: PgPool) -> Router {
    Router::new()
        .route("/health", get(health))
        .route("/items/:id", get(show_item).delete(drop_item))
        .route("/items", post(create_item))
        .route("/orders/{id}/", put(
            update_order))
        .route("/feed", options(feed))
}

async fn health() -> &'static str {
    "ok"
}

/// Shows an item.
#[instrument(name = "api.show_item", skip(pool), err)]
pub async fn show_item(pool: PgPool) -> Result<String, Error> {
    info!("showing an item");
    let row = pool.fetch_one("select 1").await?;
    Ok(row)
}

#[tracing::instrument(name = "create_item", fields(token, body))]
pub async fn create_item(body: String) -> Result<(), Error> {
    let span = tracing::span!(Level::INFO, "insert.query", key = 1);
    counter!("items_created", 1); tracing::debug!("made");
    Ok(())
}

async fn feed() -> Vec<String> {
    let _guard = debug_span!("client feed").entered();
    log::warn!("slow feed");
    vec![]
}
'''
DESK = '''use actix_web::{get, post, HttpResponse};

#[get("/tickets")]
/// lists tickets

#[protected]
pub async fn list_tickets() -> HttpResponse {
    error!("none");
    HttpResponse::Ok()
}

#[post("/tickets")]
const LIMIT: usize = 5;
pub fn open_ticket() {}

#[delete("/tickets/{id}")]
// closing
async fn close_ticket<T>(id: u32) {
    histogram!("closing", 2.0);
}

#[head(no_quotes)]
fn ping() {}
'''
RPC = '''use tonic::{Request, Response};

#[tonic::async_trait]
impl Greeter for Server {
    async fn say_hello(&self, request: Request<Hello>) -> Result<Response<Reply>, Status> {
        prometheus::default_registry();
        Ok(Response::new(Reply {}))
    }
    pub async fn hidden(&self, request: Request<Hello>) {}
}
'''
LEDGER = "fn add(a: i64, b: i64) -> i64 {\r\n    a + b\r\n}\r\n\r\n    #[instrument(err = true)]\r\n    fn audit() {\r\n        metrics::gauge(1);\r\n    }"
TESTS = '''use super::*;
use proptest::prelude::*;

#[cfg(test)]
mod tests {
    #[test]
    fn test_add() {
        assert_eq!(add(1, 2), 3);
        let x = parse("1").unwrap();
        assert!(x.is_ok());
    }

    #[tokio::test]
    async fn it_should_fail() {
        let e = load().expect("no file").unwrap();
        assert_that!(e).is_equal_to(Err(1));
    }
}
'''
MOCKS = '''#[automock]
trait Store { fn setup_test(&self); }
mod store_tests { fn helper() -> Result<(), String> { Err("x".into()) } }
'''

#: project, file, source
FILES = [
    ("shop", "shop/src/main.rs", SHOP), ("desk", "desk/src/api/desk.rs", DESK), ("rpc", "rpc/src/lib.rs", RPC),
    ("shop", "shop/src/ledger.rs", LEDGER), ("shop", "shop/src/ledger/tests.rs", TESTS), ("desk", "desk/src/mocks.rs", MOCKS),
    ("void", "void/src/empty.rs", ""), ("void", "void/src/line.rs", "// nothing\n"),
]
#: project, package, dep_name, dep_kind
DEPS = [
    ("shop", "shop", "axum", "normal"), ("shop", "shop", "sqlx", "normal"), ("shop", "shop", "tracing", "normal"), ("shop", "shop", "tracing-subscriber", "dev"), ("shop", "shop", "serde", "normal"),
    ("desk", "desk", "actix-web", "normal"), ("desk", "desk", "reqwest", "normal"), ("desk", "desk", "redis", "normal"), ("desk", "desk", "env_logger", "normal"), ("desk", "desk", "tonic", "build"),
    ("rpc", "rpc", "tonic", "normal"), ("rpc", "rpc", "warp", "normal"), ("void", "void", "serde", "normal"),
]
#: project, id, name, kind, file, line
NODES = [
    ("shop", "main", "main", "Endpoint", "shop/src/main.rs", 1), ("shop", "api::fetch_user", "fetch_user", "Internal", "shop/src/api.rs", 4),
    ("shop", "api::create_order", "create_order", "Internal", "shop/src/api.rs", 9), ("shop", "db::connect", "connect", "Internal", "shop/src/db.rs", 2),
    ("shop", "util::retry_later", "retry_later", "Internal", "shop/src/util.rs", 3), ("shop", "util::plain", "plain", "Internal", "shop/src/util.rs", 9),
    ("desk", "send_request", "send_request", "Internal", "desk/src/net.rs", 1), ("desk", "cache_get", "cache_get", "Internal", "desk/src/net.rs", 5),
    ("desk", "get_page", "get_page", "Internal", "desk/src/net.rs", 8), ("desk", "validate", "validate", "Test", "desk/src/net.rs", 12), ("desk", "fetch", "fetch", "Internal", "desk/src/net.rs", 20),
    ("void", "query_all", "query_all", "Internal", "void/src/line.rs", 1), ("void", "checkout", "checkout", "Internal", "void/src/line.rs", 7), ("void", "island", "island", "Internal", "void/src/line.rs", 9),
]
#: src, dst, kind, is_conditional, is_in_loop
EDGES = [
    ("main", "api::fetch_user", "Direct", False, False), ("main", "api::create_order", "Direct", True, False), ("api::create_order", "db::connect", "Trait", False, True),
    ("db::connect", "util::retry_later", "Closure", True, True), ("util::retry_later", "api::create_order", "Indirect", False, False), ("util::retry_later", "util::retry_later", "Direct", False, False),
    ("api::fetch_user", "db::connect", "Dynamic", False, False), ("api::fetch_user", "db::connect", "Direct", False, False), ("send_request", "cache_get", "Direct", False, False),
    ("cache_get", "get_page", "Direct", False, False), ("get_page", "send_request", "Direct", True, False), ("validate", "fetch", "Direct", False, False), ("main", "std::fs::read", "Direct", False, False),
    ("fetch", "tokio::spawn", "Direct", False, False),
] + [(f"shop::caller{i}", "island", "Direct", False, False) for i in range(12)] + [(f"shop::caller{i}", "checkout", "Direct", False, False) for i in range(7)]
CALLER_NODES = [("void", f"shop::caller{i}", f"caller{i}", "Internal", "void/src/line.rs", 20 + i) for i in range(12)]
NODES = NODES + CALLER_NODES
#: file, line, function_name, kind, priority, suggested_span_name
POINTS = [
    ("a.rs", 10, "show", "Endpoint", "Critical", "get_show"), ("a.rs", 20, "save", "DatabaseCall", "High", "db.save"), ("a.rs", 30, "call", "ExternalApiCall", "High", "http.call"),
    ("a.rs", 0, "cached", "CacheOperation", "Low", "cache.cached"), ("b.rs", 5, "checkout", "BusinessLogic", "Medium", "checkout"), ("b.rs", 6, "failing", "ErrorBoundary", "High", "error.failing"), ("c.rs", 1, "api::create_order", "ErrorBoundary", "Low", "password_job"),
]
#: file, line, function_name, kind, span_name, score
EXISTING = [
    ("a.rs", 9, "", "TracingInstrument", "api.show", 1.0), ("a.rs", 22, "save", "ManualSpan", "sql_save", 0.7), ("a.rs", 1, "", "LogMacro", None, 1.0), ("b.rs", 7, "", "Metrics", None, 1.0),
    ("c.rs", 9, "x", "TracingInstrument", "redis password", 0.4), ("c.rs", 12, "y", "ManualSpan", "external", 1.0), ("d.rs", 1, "z", "ManualSpan", "grpc.token", 1.0), ("d.rs", 2, "z", "ManualSpan", "plain", 1.0),
]
#: ord, file, name, is_async, is_test, cyclomatic, cognitive, lines_of_code, max_nesting_depth, unwrap_calls, expect_calls, question_mark_ops, error_matches, error_if_lets, result_returns
FUNCTIONS = [
    (1, "a.rs", "one", True, False, 3, 2, 10, 1, 0, 0, 1, 0, 0, 1), (2, "a.rs", "two", False, False, 15, 20, 60, 5, 1, 0, 0, 0, 0, 1), (3, "a.rs", "three", True, False, 25, 9, 51, 2, 0, 1, 2, 1, 0, 0),
    (4, "b.rs", "four", False, True, 8, 3, 12, 2, 3, 0, 0, 0, 0, 0), (5, "b.rs", "five", False, False, 25, 16, 20, 4, 0, 0, 0, 0, 0, 0), (6, "b.rs", "six", True, False, 5, 1, 4, 1, 0, 0, 0, 0, 0, 1), (7, "b.rs", "seven", False, False, 10, 15, 50, 4, 0, 0, 0, 1, 0, 1),
]
#: call_id, module, path
CALLS = [(1, "", "helper"), (2, "api", "helper"), (3, "api::v1", "inner"), (4, "api::v1", "top"), (5, "api", "m::load"), (6, "", "std::fs::read"), (7, "", "unknown::thing"), (8, "api", "alias"), (9, "", "helper::deep"), (10, "api::v1", "serde::to")]
SYMBOLS = ["helper", "api::helper", "api::inner", "top", "store::load", "api::v1::inner"]
IMPORTS = [("m", "store"), ("alias", "api::inner")]
#: file, line, function_name, suggested_fix, severity, ord
GAPS = [
    ("shop/src/main.rs", 17, "health", '#[instrument(name = "get_health")]', "Critical", 1), ("shop/src/main.rs", 23, "show_item", '#[instrument(name = "get_items")]\nasync fn show_item(...) { ... }', "Major", 2),
    ("shop/src/main.rs", 38, "feed", "no attribute here", "Minor", 3), ("desk/src/api/desk.rs", 7, "list_tickets", '  #[instrument(name = "get_tickets")]', "Critical", 1), ("desk/src/api/desk.rs", 99, "lost", '#[instrument(name = "lost")]', "Major", 2),
    ("shop/src/ledger.rs", 1, "add", '#[instrument(name = "add")]', "Minor", 1), ("shop/src/ledger.rs", 6, "audit", '#[instrument(name = "audit")]', "Major", 2), ("gone.rs", 3, "gone", '#[instrument(name = "gone")]', "Critical", 1),
]

TABLES = {
    "fx_files": ("project string, file string, source string", FILES),
    "fx_deps": ("project string, package string, dep_name string, dep_kind string", DEPS),
    "fx_nodes": ("project string, id string, name string, kind string, file string, line int", NODES),
    "fx_edges": ("src string, dst string, kind string, is_conditional boolean, is_in_loop boolean", EDGES),
    "fx_points": ("file string, line int, function_name string, kind string, priority string, suggested_span_name string", POINTS),
    "fx_existing": ("file string, line int, function_name string, kind string, span_name string, score double", EXISTING),
    "fx_functions": ("ord int, file string, name string, is_async boolean, is_test boolean, cyclomatic int, cognitive int, lines_of_code int, max_nesting_depth int, unwrap_calls int, expect_calls int, question_mark_ops int, error_matches int, error_if_lets int, result_returns int", FUNCTIONS),
    "fx_calls": ("call_id int, module string, path string", CALLS),
    "fx_symbols": ("full_path string", [(s,) for s in SYMBOLS]),
    "fx_imports": ("local_name string, full_path string", IMPORTS),
    "fx_gaps": ("file string, line int, function_name string, suggested_fix string, severity string, ord int", GAPS),
}


TABLES["fx_hops"] = TABLES["fx_edges"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """In the place of `derived.table`."""
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    parts = v.replace("'", "''").split("\r")
    return "'" + "' || chr(13) || '".join(parts) + "'" if len(parts) == 1 else "('" + "' || chr(13) || '".join(parts) + "')"


def values(name: str) -> str:
    """`name(columns) AS (VALUES ...)` for a WITH clause, with the columns' types."""
    schema, rows = TABLES[name]
    columns = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    types = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    body = ",\n".join("(" + ", ".join(f"{_literal(v)}::{types[t]}" for v, (_, t) in zip(row, columns)) + ")" for row in rows)
    return f"{name}({', '.join(c for c, _ in columns)}) AS (VALUES\n{body})"
