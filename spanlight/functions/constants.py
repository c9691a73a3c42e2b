"""Fixed values that results depend on: word lists, names, weights and patterns."""

# Words that tell operations by a function's name.
DB_GATED = ["query", "execute", "fetch", "insert", "update", "delete", "select", "transaction", "commit", "rollback", "pool"]
HTTP_GATED = ["send_request", "http_get", "http_post", "call_api", "fetch_from", "remote_", "_client", "api_call"]
CACHE_GATED = ["cache_get", "cache_set", "get_cached", "set_cache", "invalidate", "cache_", "_cache"]
DB_NAIVE = [*DB_GATED, "connect", "database", "db_", "_db", "sql", "postgres", "mysql", "sqlite", "redis", "mongo", "dynamo"]
HTTP_NAIVE = ["request", "response", "http", "fetch", "call_api", "send_request", "client", "get_", "post_", "put_", "delete_", "patch_", "api_call", "remote", "external"]
ERROR_WORDS = ["error", "handle_error", "map_err", "on_error", "catch", "recover", "fallback", "retry", "validate"]
BUSINESS_WORDS = ["process", "handle", "create", "calculate", "validate", "authorize", "authenticate", "payment", "order", "checkout", "register", "login", "logout", "subscribe", "publish"]

# Crates by category and the label they count under.
CRATES = [
    ("database", "sqlx", "sqlx"), ("database", "diesel", "diesel"), ("database", "sea-orm", "sea-orm"),
    ("database", "tokio-postgres", "tokio-postgres"), ("database", "rusqlite", "rusqlite"), ("database", "mongodb", "mongodb"),
    ("http_client", "reqwest", "reqwest"), ("http_client", "hyper", "hyper"), ("http_client", "ureq", "ureq"), ("http_client", "surf", "surf"),
    ("cache", "redis", "redis"), ("cache", "memcache", "memcache"), ("cache", "moka", "moka"), ("cache", "cached", "cached"),
    ("framework", "axum", "axum"), ("framework", "actix-web", "actix-web"), ("framework", "rocket", "rocket"),
    ("framework", "tonic", "tonic"), ("framework", "warp", "warp"), ("framework", "poem", "poem"),
    ("observability", "tracing", "tracing"), ("observability", "tracing-subscriber", "tracing"), ("observability", "tracing-opentelemetry", "tracing"),
    ("observability", "opentelemetry", "opentelemetry"), ("observability", "opentelemetry-jaeger", "opentelemetry"), ("observability", "opentelemetry-otlp", "opentelemetry"),
    ("observability", "log", "log"), ("observability", "env_logger", "log"), ("observability", "pretty_env_logger", "log"),
    ("observability", "metrics", "metrics"), ("observability", "metrics-exporter-prometheus", "metrics"),
    ("observability", "prometheus", "prometheus"), ("observability", "prometheus-client", "prometheus"),
]
CATEGORY_TITLES = [("framework", "Frameworks"), ("database", "Databases"), ("http_client", "HTTP Clients"), ("cache", "Caches"), ("observability", "Observability")]
NO_DEPENDENCIES = "No recognized infrastructure dependencies"

# Frameworks in the order in which they are tried, and what shows them in source.
FRAMEWORKS = [("Axum", "axum"), ("Actix", "actix-web"), ("Rocket", "rocket"), ("Tonic", "tonic")]
FRAMEWORK_MARKERS = [("Axum", ["axum::", "use axum"]), ("Actix", ["actix_web::", "use actix_web"]), ("Rocket", ["rocket::", "#[rocket"]), ("Tonic", ["tonic::", "use tonic"])]

# Existing instrumentation.
SPAN_MARKS = ["tracing::span!", "info_span!", "debug_span!", "trace_span!", "warn_span!", "error_span!"]
LEVELS = ["info", "debug", "warn", "error", "trace"]
LOG_MARKS = [f"{p}::{level}!" for p in ("tracing", "log") for level in LEVELS] + [f"{level}!(" for level in LEVELS]
METRIC_MARKS = ["counter!", "gauge!", "histogram!", "metrics::counter", "metrics::gauge", "metrics::histogram", "prometheus::"]
LARGE_WORDS = ["body", "request", "response"]
SENSITIVE_WORDS = ["password", "token", "secret", "key", "credential"]

# Routes.
AXUM_METHODS = ["get", "post", "put", "delete", "patch", "head", "options"]
ATTRIBUTE_METHODS = ["get", "post", "put", "delete", "patch", "head"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
EXTRACTORS = ["Json", "Path", "Query", "Header", "Extension", "Form", "Bytes", "String", "State", "ConnectInfo", "Host", "OriginalUri", "RawQuery", "Request", "TypedHeader", "WebSocketUpgrade"]
HANDLER_RETURNS = ["IntoResponse", "Response", "Result", "Json", "Html", "StatusCode"]

# Kinds of points, their names and span prefixes; priorities and scores.
KIND_NAMES = {
    "Endpoint": "HTTP/gRPC Endpoint", "DatabaseCall": "Database Call", "ExternalApiCall": "External API Call", "CacheOperation": "Cache Operation",
    "BusinessLogic": "Business Logic", "ErrorBoundary": "Error Boundary", "BackgroundJob": "Background Job", "MessageQueue": "Message Queue",
}
KIND_PREFIXES = {"DatabaseCall": "db", "ExternalApiCall": "http", "CacheOperation": "cache", "MessageQueue": "mq", "ErrorBoundary": "error", "BackgroundJob": "job"}
KIND_FIELDS = {
    "Endpoint": [("method", "method"), ("path", "path")], "DatabaseCall": [("query", "query"), ("table", "table")],
    "ExternalApiCall": [("url", "url"), ("method", "method")], "CacheOperation": [("key", "key"), ("operation", "op")], "ErrorBoundary": [("error", "err")],
}
PRIORITY_SCORES = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
CATEGORY_KINDS = {"Database": "DatabaseCall", "HttpClient": "ExternalApiCall", "ExternalService": "ExternalApiCall", "Cache": "CacheOperation", "MessageQueue": "MessageQueue", "ErrorHandling": "ErrorBoundary"}
HIGH_CATEGORIES = ["Database", "HttpClient", "ExternalService", "ErrorHandling", "Auth"]

# Categories in their order, with names and ids.
CATEGORIES = [
    ("UnitTest", "Unit Test", "unit"), ("IntegrationTest", "Integration Test", "integration"), ("PropertyTest", "Property Test", "property"),
    ("Benchmark", "Benchmark", "bench"), ("Fuzz", "Fuzz Test", "fuzz"), ("Mock", "Mock/Stub", "mock"), ("TestUtility", "Test Utility", "utility"),
    ("Example", "Example", "example"), ("Database", "Database", "database"), ("HttpClient", "HTTP Client", "http_client"),
    ("ExternalService", "External Service", "external_service"), ("Cache", "Cache", "cache"), ("MessageQueue", "Message Queue", "message_queue"),
    ("ErrorHandling", "Error Handling", "error_handling"), ("Auth", "Authentication", "auth"), ("BusinessLogic", "Business Logic", "business_logic"),
    ("Unknown", "Unknown", "unknown"),
]
CATEGORY_WORDS = [
    ("UnitTest", ["#[test]", "test_", "mod tests"]), ("PropertyTest", ["quickcheck", "proptest"]), ("Benchmark", ["bench", "criterion"]),
    ("Mock", ["mock", "stub"]), ("TestUtility", ["helper", "fixture", "setup", "teardown"]), ("Example", ["example", "doc("]), ("Fuzz", ["fuzz", "arbitrary"]),
]

# Weighted patterns as (group, pattern, weight, is regex).
PATTERNS = [
    *[("function_names", p, w, False) for p, w in (("test_", 0.9), ("should_", 0.8), ("it_", 0.8), ("when_", 0.7), ("given_", 0.7))],
    *[("function_names", p, w, True) for p, w in ((r"_test$", 0.8), (r"_should_\w+", 0.7))],
    *[("attributes", p, w, False) for p, w in (("#[test]", 1.0), ("#[cfg(test)]", 0.9), ("#[tokio::test]", 1.0), ("#[async_std::test]", 1.0), ("#[quickcheck]", 0.9), ("#[proptest]", 0.9), ("#[rstest]", 0.9), ("#[test_case", 0.9), ("#[should_panic", 0.8), ("#[ignore]", 0.6))],
    *[("assertions", p, w, False) for p, w in (("assert!", 0.9), ("assert_eq!", 0.9), ("assert_ne!", 0.9), ("debug_assert!", 0.7), ("assert_matches!", 0.8), ("assert_approx_eq!", 0.8))],
    *[("assertions", p, w, True) for p, w in ((r"\.expect\(", 0.6), (r"\.unwrap\(", 0.5))],
    *[("error_handling", p, w, r) for p, w, r in (("should_panic", 0.9, False), ("catch_unwind", 0.7, False), ("Result<(), ", 0.6, False), (r"Err\(.+\)", 0.6, True), (".is_err()", 0.7, False), (".is_ok()", 0.6, False))],
    *[("modules", p, w, r) for p, w, r in (("mod tests", 1.0, False), ("mod test", 0.9, False), (r"mod \w+_tests", 0.8, True), ("#[cfg(test)]", 0.9, False))],
    *[("imports", p, w, r) for p, w, r in (("use super::*", 0.7, False), ("use crate::", 0.5, False), (r"use .+test", 0.6, True), ("use mockall::", 0.8, False), ("use spectral::", 0.8, False), ("use proptest::", 0.8, False), ("use quickcheck::", 0.8, False))],
    *[("framework:mockall", p, w, False) for p, w in (("mock!", 0.8), ("automock", 0.8), ("predicate::", 0.7))],
    *[("framework:spectral", p, w, False) for p, w in (("assert_that!", 0.9), ("asserting!", 0.8), ("is_equal_to", 0.7), ("contains", 0.6))],
    *[("framework:cucumber", p, 0.8, False) for p in ("given!", "when!", "then!", "#[given", "#[when", "#[then")],
]

# Call edges, node kinds, roots of paths that lie outside, configuration defaults.
EDGE_BASES = {"Direct": 1.0, "Indirect": 0.8, "Dynamic": 0.5, "Recursive": 1.0, "Trait": 0.7, "Closure": 0.9}
NODE_KINDS = ["Endpoint", "Test", "Internal", "External"]
EXTERNAL_ROOTS = ["std", "core", "alloc", "proc_macro", "tokio", "async_trait", "serde", "anyhow", "thiserror", "log", "tracing", "futures"]
DEFAULT_THRESHOLD, DEFAULT_MAX_DEPTH = 0.8, 10
DEFAULT_EXCLUDES = ["target", "node_modules", ".git"]
EXISTING_LABELS = {"TracingInstrument": "#[instrument]", "ManualSpan": "span!()", "LogMacro": "log macro", "Metrics": "metrics"}
TEST_FRAMEWORKS = [
    ("BuiltIn", ["#[test]"], ["std::test"]), ("Tokio", ["#[tokio::test]"], ["tokio::test"]),
    ("AsyncStd", ["#[async_std::test]"], ["async_std::test"]), ("Proptest", ["proptest!"], ["proptest::prelude"]),
]

# Texts that show a crate in use.
CRATE_USAGE = {
    "sqlx": ["sqlx::query", "Pool", "PgPool", "MySqlPool", "SqlitePool"], "diesel": ["diesel::", "table!", "Insertable", "Queryable"], "sea-orm": ["sea_orm::", "Entity", "ActiveModel"],
    "tokio-postgres": ["tokio_postgres::", "Client"], "rusqlite": ["rusqlite::", "Connection"], "mongodb": ["mongodb::", "Collection", "Database"],
    "reqwest": ["reqwest::", "Client::new", ".get(", ".post(", ".send().await"], "hyper": ["hyper::", "Request::builder"], "ureq": ["ureq::", "Agent"], "surf": ["surf::", "surf::get", "surf::post"],
    "redis": ["redis::", "Commands", "AsyncCommands", ".get(", ".set("], "memcache": ["memcache::"], "moka": ["moka::", "Cache::new"], "cached": ["#[cached]", "cached::"],
    "axum": ["Router::new", ".route(", "routing::get", "routing::post"], "actix-web": ["#[get(", "#[post(", "web::get()", "HttpServer::new"], "rocket": ["#[get(", "#[post(", "routes!", "rocket::build"],
    "tonic": ["#[tonic::async_trait]", "tonic::Request", "Server::builder"], "warp": ["warp::path!", "warp::get()", "warp::post()"], "poem": ["#[handler]", "Route::new", "poem::get"],
}
# Terminal codes.
ANSI = {"reset": "\x1b[0m", "bold": "\x1b[1m", "dim": "\x1b[2m", "red": "\x1b[31m", "green": "\x1b[32m", "yellow": "\x1b[33m", "blue": "\x1b[34m"}
#: Kinds of input and output errors that are worth another try.
RETRYABLE = ["WouldBlock", "Interrupted", "TimedOut"]
