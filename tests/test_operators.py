"""Golden facts and corner cases of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlight.functions import text as S
from spanlight.operators import ast, fixer, functions, gaps, graph, patterns, points, rules
from spanlight.operators.existing import scan_existing
from spanlight.operators.lines import scan_lines
from spanlight.operators.rustlex import SyntaxFault, parse
from spanlight.plans import analyze, report
from spanlight.sources import config, files, manifest

EDGE = "src string, dst string, kind string, is_conditional boolean, is_in_loop boolean"


def chain(spark, back=False):
    nodes = spark.createDataFrame([("main", "Endpoint"), ("foo", "Internal"), ("bar", "Internal"), ("baz", "Internal")], "id string, kind string")
    rows = [("main", "foo"), ("foo", "bar"), ("bar", "baz")] + ([("baz", "foo")] if back else [])
    return nodes, spark.createDataFrame([(a, b, "Direct", False, False) for a, b in rows], EDGE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_chain_graph(spark):
    nodes, edges = chain(spark)
    at = lambda x: nodes.filter(F.col("id") == x)
    assert ids(graph.reachable(at("main"), edges)) == ["bar", "baz", "foo", "main"]
    assert ids(graph.reachable(at("bar"), edges)) == ["bar", "baz"]
    assert ids(graph.reaching(at("foo"), edges)) == ["foo", "main"]
    assert ids(graph.reachable(at("nothing"), edges)) == []
    paths = {r["id"]: r["path"] for r in graph.shortest_paths(at("main"), edges).collect()}
    assert paths["baz"] == ["main", "foo", "bar", "baz"]
    assert "main" not in {r["id"] for r in graph.shortest_paths(at("baz"), edges).collect()}
    s = graph.graph_stats(nodes, edges).first()
    assert (s.total_nodes, s.total_edges, s.endpoint_count, s.internal_count, s.unreachable_internal, s.cycle_count) == (4, 3, 1, 3, 0, 0)


def test_one_cycle(spark):
    nodes, edges = chain(spark, back=True)
    assert [r["cycle"] for r in graph.cycles(edges).collect()] == [["bar", "baz", "foo"]]


@pytest.mark.parametrize("n", [12, 40])
def test_cycles_of_any_length(spark, n):
    ring = [(f"n{i:02d}", f"n{(i + 1) % n:02d}", "Direct", False, False) for i in range(n)]
    tail = [("n03", "out", "Direct", False, False), ("in", "n05", "Direct", False, False), ("in", "in", "Direct", False, False)]
    edges = spark.createDataFrame(ring + tail, EDGE)
    assert sorted(map(len, (r["cycle"] for r in graph.cycles(edges).collect()))) == [1, n]


def test_lines_are_trimmed_once(spark):
    """No filter holds copies of what makes the trimmed text, and prose without marks is not cut into lines."""
    f = spark.createDataFrame([("a", "x")], "file string, source string")
    from spanlight.operators import existing
    from spanlight.operators.lines import lines_with

    for df in (scan_existing(scan_lines(f)), scan_existing(lines_with(f, existing.MARKS)), analyze.analyze(f, config=analyze.Config(framework="Axum")).points):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace(" not in plan.split("Generate")[0] and plan.count("btrim(") + plan.count("trimboth") <= 2 * plan.count("Generate")


def test_failed_syntax_undoes_a_fix(spark):
    attempts = spark.createDataFrame([("a.rs", 1, "f", "Applied", "+ x"), ("a.rs", 2, "g", "Skipped: Severity filter", None), ("b.rs", 1, "h", "Applied", "+ y")], "file string, line int, function_name string, status string, diff string")
    parsed = spark.createDataFrame([("a.rs", False, "no end"), ("b.rs", True, None)], "file string, parse_ok boolean, parse_error string")
    got = {(r["file"], r["line"]): (r["status"], r["diff"]) for r in fixer.gated(attempts, parsed).collect()}
    assert got == {("a.rs", 1): ("Failed: Syntax validation failed: no end", None), ("a.rs", 2): ("Skipped: Severity filter", None), ("b.rs", 1): ("Applied", "+ y")}


def test_cut_texts_stay_whole(spark):
    rows = spark.createDataFrame([("short",), ("twelve chars",), ("ääääääääää",), ("日本語日本語",), ("a" * 20,)], "t string").select("t", S.truncated(F.col("t"), 12).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == {"short": "short", "twelve chars": "twelve chars", "ääääääääää": "ääää...", "日本語日本語": "日本語...", "a" * 20: "a" * 9 + "..."}


def test_graph_without_edges(spark):
    nodes, edges = chain(spark)
    s = graph.graph_stats(nodes, edges.filter("false")).first()
    assert (s.total_edges, s.max_in_degree, s.cycle_count, s.unreachable_internal) == (0, 0, 0, 3)


@pytest.mark.parametrize("kind, conditional, loop, weight", [("Direct", False, False, 1.0), ("Direct", True, False, 0.8), ("Direct", False, True, 1.5), ("Direct", True, True, 1.2)])
def test_edge_weights(spark, kind, conditional, loop, weight):
    e = spark.createDataFrame([("a", "b", kind, conditional, loop)], EDGE)
    assert graph.weighted_edges(e).first()["weight"] == pytest.approx(weight)


def test_risk_levels(spark):
    rows = spark.createDataFrame([(3,), (15,), (25,)], "c int").select(S.risk_level(F.col("c")).alias("r"))
    assert [r["r"] for r in rows.collect()] == ["Low", "High", "Critical"]


@pytest.mark.parametrize("threshold, kept", [(0.25, 4), (0.5, 3), (0.75, 2), (0.8, 1), (1.0, 1)])
def test_thresholds(spark, threshold, kept):
    p = spark.createDataFrame([("Critical",), ("High",), ("Medium",), ("Low",)], "p string")
    assert p.filter(points.reaches(F.col("p"), threshold)).count() == kept


POINT = "file string, line int, function_name string, kind string, priority string, suggested_span_name string"


def test_gap_distance(spark):
    p = spark.createDataFrame([("a", n, f"f{n}", "Endpoint", "Critical", "s") for n in (0, 1, 2, 4, 5, 6, 8)], POINT)
    e = spark.createDataFrame([("a", 5, ""), ("a", 1, ""), ("b", 8, "")], "file string, line int, function_name string")
    assert ids(gaps.uncovered_nearby(p, e), "line") == [8]
    assert ids(gaps.uncovered_strict(p, e), "line") == [0, 2, 4, 6, 8]


def test_coverage_without_points(spark):
    p = spark.createDataFrame([], POINT)
    e = spark.createDataFrame([], "file string, line int, function_name string")
    assert gaps.coverage_check(p, gaps.gaps_live(p, e), 80.0).first()["coverage"] == 100.0
    assert gaps.coverage_strict(p, e).first()["coverage"] == 100.0


def test_line_ends(spark):
    rows = spark.createDataFrame([("a", "x\r\n\r\ny"), ("b", "x\n"), ("c", ""), ("d", "\n"), ("e", "p\r\r\n\tq 　")], "file string, source string")
    got = {}
    for r in scan_lines(rows).orderBy("file", "line").collect():
        got.setdefault(r["file"], []).append((r["line"], r["raw"], r["text"]))
    assert got == {"a": [(1, "x", "x"), (2, "", ""), (3, "y", "y")], "b": [(1, "x", "x")], "d": [(1, "", "")], "e": [(1, "p\r", "p"), (2, "\tq 　", "q")]}


def existing_of(spark, line):
    return [(r["kind"], r["span_name"], r["score"]) for r in scan_existing(scan_lines(spark.createDataFrame([("f", line)], "file string, source string"))).orderBy("ord").collect()]


@pytest.mark.parametrize(
    "line, want",
    [
        ('#[instrument(name = "a.b")]', [("TracingInstrument", "a.b", 1.0)]),
        ("#[instrument]", [("TracingInstrument", None, 1.0)]),
        ('#[instrument(fields(username = "x"))]', [("TracingInstrument", "x", 1.0)]),
        ("#[instrument(err)]", [("TracingInstrument", None, 0.9)]),
        ("#[instrument(err = true)]", [("TracingInstrument", None, 1.0)]),
        ("#[instrument(body, token, secret, password, key)]", [("TracingInstrument", None, 0.0)]),
        ('span!(Level::INFO, "x")', []),
        ('let s = info_span!("work");', [("ManualSpan", "work", 1.0)]),
        ("// info!(x)", [("LogMacro", None, 1.0)]),
        ('tracing::span!("s"); log::info!("x"); counter!("c")', [("ManualSpan", "s", 1.0), ("LogMacro", None, 1.0), ("Metrics", None, 1.0)]),
    ],
)
def test_existing_lines(spark, line, want):
    assert existing_of(spark, line) == want


def test_rules_skip_what_does_not_compile():
    assert rules.NamingRules(forbidden_patterns=["ok", "(", "(?=x)"]).forbidden() == ["ok"]


def test_pattern_sets(spark):
    own = patterns.add_pattern([], "rstest_like", "given_", 0.4)
    assert own == [("framework:rstest_like", "given_", 0.4, False)]
    texts = spark.createDataFrame([("d", "mod tests fn x_test"), ("e", "x_test\n")], "doc string, text string")
    found = patterns.match_patterns(texts)
    assert ids(found.filter("doc = 'd'"), "pattern") == ["_test$", "mod test", "mod tests"]
    assert found.filter("doc = 'e' and pattern = '_test$'").count() == 0  # a last line end is no end


def test_function_measures_when_empty(spark):
    f = spark.createDataFrame([], "file string, name string, ord int, is_test boolean, cyclomatic int, unwrap_calls int, expect_calls int, question_mark_ops int, error_matches int, error_if_lets int, result_returns int")
    assert functions.average_complexity(f).first()[0] == 0.0
    assert functions.error_handling_score(f).first()[0] == 100.0
    assert functions.test_coverage_estimate(f).first()[0] == 100.0
    assert functions.most_complex(f).count() == 0


SNIPPETS = {
    "strings": r'fn f() { let a = r#"} " {"#; let b = b"\"}"; let c = \'}\'; let d: &\'static str = "x"; }'.replace("\\'", "'"),
    "generics": "impl<'a, T: Into<Vec<u8>>> A<'a, T> where T: Clone { fn g<const N: usize>(&self, x: [T; N]) -> Option<Vec<Vec<T>>> { self.0.iter().map(|x| x + 1).collect::<Vec<_>>() } }",
    "control": "fn f() { if let Some(x) = a && b { } else if c { } while let Ok(x) = it.next() { continue; } 'o: loop { break 'o; } match x { A | B if c => 1, C { d, .. } => { 2 } _ => 3 }; for (i, x) in a.iter().enumerate() {} }",
    "closures": "fn f() { let g = move |a: u8, b| -> u8 { a }; h(|| 1, async move { x.await? }); let r = ..=5; a[1..]; S { x, y: 1, ..z }; }",
    "macros": 'macro_rules! m { ($x:expr) => { $x }; } fn f() { println!("{}", 1); vec![1, 2].len(); quote! { a }.to_string(); }',
    "comments": "/* a /* nested */ b */ fn f() {} // end",
    "items": "pub(crate) unsafe extern \"C\" fn f() {} pub const fn g() {} static mut X: u8 = 1; type A<T> = B<T>; extern crate x; use a::{b as c, d::{e, f}, *}; enum E { A(u8), B { x: u8 } } struct T(u8); union U { a: u8 }",
}


@pytest.mark.parametrize("name", sorted(SNIPPETS))
def test_parses(name):
    parse(SNIPPETS[name])


@pytest.mark.parametrize("source", ["fn f( {", "fn f() { let x = ; }", "fn", "}", "fn f() { a b }", "struct", "/* open", "fn f() { match x { } "])
def test_rejects(source):
    with pytest.raises((SyntaxFault, IndexError)):
        parse(source)


def analysed(spark, source, observed=True):
    return ast.functions(ast.parse_files(spark.createDataFrame([("f.rs", source)], "file string, source string"), observed))


def test_direct_children_are_stepped_over(spark):
    source = "fn f() -> u8 { g(h(1)); a.b()?; if x && y { z() } }"
    seen = analysed(spark, source).first()
    assert [c["callee"] for c in seen["calls"]] == ["g", "z"]
    assert (seen["question_mark_ops"], seen["cyclomatic"]) == (1, 2)
    full = analysed(spark, source, observed=False).first()
    assert sorted(c["callee"] for c in full["calls"]) == ["b", "g", "h", "z"]
    assert full["cyclomatic"] == 3


def test_methods_are_functions_but_no_nodes(spark):
    parsed = ast.parse_files(spark.createDataFrame([("x/src/lib.rs", "struct A; impl A { fn new() -> A { A } fn go(&self, n: u8) {} } fn free() {}")], "file string, source string"))
    assert ids(ast.functions(parsed), "name") == ["free", "go", "new"]
    assert {r["name"]: r["param_count"] for r in ast.functions(parsed).collect()} == {"free": 0, "go": 1, "new": 0}
    assert ids(ast.fn_nodes(parsed)) == ["free"]


def test_broken_file_is_dropped_or_fatal(spark):
    files_ = spark.createDataFrame([("a.rs", "fn a() {}"), ("b.rs", "fn b( {"), ("c.rs", None)], "file string, source string")
    parsed = ast.parse_files(files_)
    assert ids(ast.functions(parsed), "name") == ["a"]
    with pytest.raises(Exception, match="b.rs|c.rs"):
        ast.parsed_or_fail(parsed).collect()


def test_fixing_keeps_sources_valid(spark):
    source = "//! doc\nuse std::fs;\n\n/// about\n#[inline]\nfn one() {}\n    fn two() {}\n"
    f = spark.createDataFrame([("a.rs", source)], "file string, source string")
    g = spark.createDataFrame([("a.rs", 6, "one", '#[instrument(name = "one")]', "Major", 1), ("a.rs", 7, "two", '#[instrument(name = "two")]', "Major", 2)], "file string, line int, function_name string, suggested_fix string, severity string, ord int")
    out = fixer.fixed_files(f, g).first()["source"]
    assert out == '//! doc\nuse std::fs;\nuse tracing::instrument;\n\n#[instrument(name = "one")]\n/// about\n#[inline]\nfn one() {}\n    #[instrument(name = "two")]\n    fn two() {}\n'
    parse(out)


def test_sources(spark, tmp_path):
    src = tmp_path / "proj" / "src"
    (src / "retarget").mkdir(parents=True)
    (src / "a b.rs").write_text("fn a() {}\n")
    (src / "c+d.rs").write_text("//\n")
    (src / "empty.rs").write_text("")
    (src / "retarget" / "x.rs").write_text("fn x() {}")
    (src / "note.txt").write_text("no")
    got = {r["file"]: r["source"] for r in files.scan_files(spark, [str(tmp_path / "proj")]).collect()}
    assert got == {str(src / "a b.rs"): "fn a() {}\n", str(src / "c+d.rs"): "//\n"}
    both = files.scan_files(spark, [str(src / "retarget" / "x.rs"), str(src / "a b.rs"), str(src)], [])
    assert both.count() == 5 and files.distinct_files(both).count() == 3


def test_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["m"]\n[package]\nname = "root"\n[dependencies]\naxum = "0.7"\nweb = { package = "reqwest", version = "1" }\n[target.\'cfg(unix)\'.dependencies]\nmoka = "1"\n')
    (tmp_path / "m" / "Cargo.toml").write_text('[package]\nname = "m"\n[dev-dependencies]\nsqlx = "1"\n')
    rows = {(r["package"], r["dep_name"], r["dep_kind"]) for r in manifest.read_manifest(spark, str(tmp_path)).collect()}
    assert rows == {("root", "axum", "normal"), ("root", "reqwest", "normal"), ("root", "moka", "normal"), ("m", "sqlx", "dev")}
    assert manifest.has_axum(str(tmp_path)) and not manifest.has_axum(str(tmp_path / "m"))
    assert manifest.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_config_round_trip(tmp_path):
    c = analyze.Config(threshold=0.5, filter_path="x", naming_rules=rules.NamingRules("api.", forbidden_patterns=["a\\d"]))
    config.save_config(c, str(tmp_path / "c.toml"))
    assert config.load_config(str(tmp_path / "c.toml")) == c
    (tmp_path / "p.toml").write_text('[[patterns]]\nname = "x"\ncategory = "mine"\nregex = "a+"\nconfidence = 0.3\n')
    assert config.load_patterns(str(tmp_path / "p.toml")) == [("mine", "a+", 0.3, True)]


def test_large_project_in_time(spark):
    import time

    body = "use std::fs;\npub fn create_{0}() -> Result<(), String> {{ let x = load()?; Ok(()) }}\npub fn get_{0}(id: u64) -> Option<u64> {{ if id > 1 {{ Some(id) }} else {{ None }} }}\nfn helper_{0}() {{ for i in 0..3 {{ create_{0}(); }} }}\n"
    rows = [(f"big/src/module_{i}.rs", body.format(i)) for i in range(50)] + [("big/src/lib.rs", "".join(f"mod module_{i};\n" for i in range(50)))]
    f = spark.createDataFrame(rows, "file string, source string")
    ast.parse_files(f).count()  # workers start, and code is compiled
    analyze.analyze(f).stats.first()
    begun = time.time()
    parsed = ast.parse_files(f).cache()
    a = analyze.analyze(f, nodes=ast.fn_nodes(parsed))
    s = a.stats.first()
    assert (s["total_files"], s["total_functions"]) == (51, 150)
    assert time.time() - begun < 10


def test_reports(spark):
    f = spark.createDataFrame([("a.rs", 'fn app() {\n    Router::new().route("/x", get(show))\n}\n\nfn show() {}\n')], "file string, source string")
    a = analyze.analyze(f, config=analyze.Config(framework="Axum"))
    text = report.tree_text(a)
    assert "GET /x → show" in text and "[Critical] show (HTTP/gRPC Endpoint) has no instrumentation" in text and "📍" in text
    assert '"total_files" : 1' in report.FORMATTERS["json"](a)
    assert 'EP0["GET /x"]' in report.mermaid_text(a)
    check = gaps.coverage_check(a.points, a.gaps, 80.0)
    assert "FAILED: Coverage 0.0% is below threshold 80.0%" in report.check_text(check, a.gaps, 0)


def test_streaming(spark, tmp_path):
    from spanlight.streaming.incremental import new_sources, watch_existing

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rs").write_text('fn f() {\n  info!("x");\n}\n')
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    watch_existing(new_sources(spark, str(tmp_path / "in")), out, check).awaitTermination(60)
    (tmp_path / "in" / "b.rs").write_text('counter!("c");\n')
    watch_existing(new_sources(spark, str(tmp_path / "in")), out, check).awaitTermination(60)
    assert sorted((r["kind"], r["line"]) for r in spark.read.parquet(out).collect()) == [("LogMacro", 2), ("Metrics", 1)]


def test_written_tables_are_cleaned_up(spark):
    import os

    from spanlight.sources import tables

    folder = tables._app_dir(spark)
    t = tables.written(spark.range(3), "three")
    assert t.count() == 3 and any(x.endswith("-three") for x in os.listdir(folder))
    tables.clean_up(spark)
    assert not os.path.exists(folder)
