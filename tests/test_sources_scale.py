"""Split files, manifests and settings in tasks, many patterns at once, gaps over a stream."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlight.functions import constants as K
from spanlight.operators import automaton, fixer, lines, patterns
from spanlight.plans import report
from spanlight.sources import config, manifest, splits
from spanlight.sources.tables import setting
from spanlight.streaming import gaps as stream_gaps


def test_line_numbers_hold_across_splits(spark, tmp_path):
    """Splits of 4 KB cut files of up to 60 KB; numbers and texts are those of whole files."""
    r = random.Random(1)
    texts = {
        "long.rs": "".join(f"line {i} {'x' * r.randint(0, 90)}" + r.choice(["\n", "\r\n", "\n\n"]) for i in range(900)), "open.rs": "a\nb\r\nlast without end", "blank.rs": "\n\n\n", "one.rs": "x" * 9000 + "\ny\n", "ümlaut +1.rs": "é\n" * 3000, "empty.rs": "",
        "skip.txt": "no\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4096"), setting(spark, "spark.sql.files.openCostInBytes", "512"):
        assert splits.split_counts(splits._read(spark, str(tmp_path), "*.rs")).count() > 15
        got = splits.scan_text_lines(spark, str(tmp_path), "*.rs").collect()
        counts = {x["file"]: x["line_count"] for x in splits.count_text_lines(spark, str(tmp_path), "*.rs").collect()}
    want = spark.createDataFrame([(str(tmp_path / n), t) for n, t in texts.items() if n.endswith(".rs") and t], "file string, source string")
    assert sorted(map(tuple, got)) == sorted(map(tuple, lines.scan_lines(want).collect()))
    assert counts == {x["file"]: x["line_count"] for x in lines.line_counts(want).collect()}


def test_manifests_of_workspaces(spark, tmp_path):
    """What the scan finds for each project is what reading one project finds."""
    made = {
        "shop": '[package]\nname = "shop"\n[dependencies]\naxum = "1"\nlog = { package = "tracing" }\n[dev-dependencies]\nredis = "1"\n', "work": '[workspace]\nmembers = ["crates/*", "tool"]\nexclude = ["crates/old"]\n', "work/crates/a": '[package]\nname = "a"\n[dependencies]\nsqlx = "1"\n',
        "work/crates/old": '[package]\nname = "old"\n[dependencies]\nold = "1"\n', "work/crates/a/deep": '[package]\nname = "deep"\n[dependencies]\ndeep = "1"\n', "work/tool": "[target.'cfg(unix)'.dependencies]\nhyper = \"1\"\n", "broken": "[package\n", "bare": "",
    }
    for folder, text in made.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "Cargo.toml").write_text(text)
    got = manifest.scan_manifests(spark, str(tmp_path)).collect()
    for folder in made:
        rows = sorted((x["package"], x["dep_name"], x["dep_kind"]) for x in got if x["folder"] == str(tmp_path / folder))
        assert rows == sorted(x[1:] for x in manifest.manifest_rows(str(tmp_path / folder))), folder
    probed = {x["folder"].rsplit("/", 1)[1]: x["detected"] for x in manifest.probed(manifest.scan_manifests(spark, str(tmp_path)), "axum").collect()}
    assert probed["shop"] and not probed["work"]


def test_settings_files(spark, tmp_path):
    for name, text in (("a", "threshold = 0.5\nmax_depth = 3\nunknown = true\n"), ("b", "= broken"), ("c", "\n")):
        (tmp_path / f"{name}.toml").write_text(text)
    got = {x["path"].rsplit("/", 1)[1]: (x["readable"], x["threshold"], x["max_depth"]) for x in config.scan_configs(spark, str(tmp_path)).collect()}
    one = config.Config()
    assert got == {"a.toml": (True, 0.5, 3), "b.toml": (False, one.threshold, one.max_depth), "c.toml": (True, one.threshold, one.max_depth)}


@pytest.mark.parametrize("pattern", ["a|b", "(ab)c", "ab?cd", "a{2}bcd", "[ab]cde", r"x\d+yz", r"a\.bc", "^abc$", "(?:abc)+", r"Err\(.+\)", "", "abc|abd", "x*", "a+b"])
def test_required_literals_are_required(pattern):
    """Every match that random texts hold has the literal."""
    word = automaton.required_literal(pattern)
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choices("abcdexyz1.E(r)", k=12))
        for m in re.finditer(pattern, text):
            assert word in m[0]


def test_patterns_that_need_nothing_see_every_text():
    assert [automaton.required_literal(p) for p in ("(?i)abc", r"\Qa.b\E", r"\p{L}+", "[", "a|b")] == [""] * 5


def test_automaton_against_each_pattern(spark):
    r = random.Random(4)
    words = [p for _, p, _, rx in K.PATTERNS if not rx] + ["x.expect(1)", "y.unwrap()", "mod a_tests", "use a::test", "Err(1)", "go_should_run", "a_test", "plain", "\n", "äöü"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 6)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "one_test")]
    mine = [*K.PATTERNS, ("framework:own", "(?i)PLAIN", 0.5, True), ("framework:own", "x|y", 0.5, True), ("framework:own", "plain", 0.5, False)]
    got = sorted((x["doc"], x["ord"], x["grp"], x["pattern"], x["weight"], x["matched"]) for x in patterns.match_patterns(spark.createDataFrame(texts, "doc int, text string"), mine).collect())
    want = []
    for doc, text in texts:
        for i, (g, p, w, rx) in enumerate(mine):
            if text is not None:
                found = [m[0] for m in re.finditer(p.replace("$", r"\Z"), text)] if rx else [p] * (p in text)
                want += [(doc, i, g, p, w, m) for m in found]
    assert got == sorted(want) and len(got) > 500


def gaps_by_hand(changes):
    points, existing = {}, {}
    for _, what, line, name, added in changes:
        table, key = (points, (line, name)) if what == "point" else (existing, line)
        table[key] = max(table.get(key, 0) + (1 if added else -1), 0)
    return sorted(k for k, n in points.items() if n and not any(existing.get(x) for x in range(max(k[0] - 1, 0), k[0] + 2)))


def test_gaps_over_a_stream(spark, tmp_path):
    """Two micro-batches; after each file's changes the open gaps are those of all its findings, and events alternate."""
    r = random.Random(6)
    rows = [(f"f{r.randrange(5)}", i, r.choice(["point", "existing"]), r.randrange(12), r.choice("ab"), r.random() < 0.7) for i in range(400)]
    for n, part in enumerate((rows[:250], rows[250:])):
        spark.createDataFrame(part, stream_gaps.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(stream_gaps.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = stream_gaps.drained(stream_gaps.gap_events(changes))
    got = {}
    for x in stream_gaps.open_gaps(events).collect():
        got.setdefault(x["file"], []).append((x["line"], x["name"]))
    for f in {x[0] for x in rows}:
        assert sorted(got.get(f, [])) == gaps_by_hand([x[1:] for x in rows if x[0] == f])
    by_gap = {}
    for x in events.orderBy("seq").collect():
        by_gap.setdefault((x["file"], x["line"], x["name"]), []).append(x["opened"])
    assert all(flags == [i % 2 == 0 for i in range(len(flags))] for flags in by_gap.values())


def test_json_pieces_are_the_report(spark):
    from types import SimpleNamespace

    place = "file string, line int, "
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    a = SimpleNamespace(
        endpoints=frame([("b", 1, "GET", '/"x"\n', "h", "axum"), ("a", 2, "PUT", "/y", None, "axum")], place + "method string, path string, handler string, framework string"), existing=frame([], place + "ord int, kind string, span_name string, score double, issues array<struct<kind:string,message:string>>"),
        gaps=frame([("a", 2, "f", "d", "s", "Major")], place + "function_name string, description string, suggested_fix string, severity string"), points=frame([("a", 2, "f", "Endpoint", "High", "r", "n", 1)], place + "function_name string, kind string, priority string, reason string, suggested_span_name string, phase int"),
        violations=frame([("a", 2, "f", "k", "m", "Info", "s")], place + "function_name string, kind string, message string, severity string, suggestion string"), stats=frame([(1, 2)], "total_files int, gaps_count int"),
    )
    pieces = "".join(x["text"] for x in report.json_rows(a).orderBy("section", "n").collect())
    assert json.loads(pieces) == json.loads(report.json_report(a).first()["report"])
    assert [e["location"]["file"] for e in json.loads(pieces)["endpoints"]] == ["a", "b"]


def test_fix_report_text(spark):
    rows = [("b.rs", 3, "g", "Failed: Failed to read file", None), ("a.rs", 9, "f", "DryRun", "  x\n+ y\n"), ("a.rs", 2, "e", "Skipped: Severity filter", None)]
    text = report.fix_report(spark.createDataFrame(rows, "file string, line int, function_name string, status string, diff string"))
    assert text == (
        "Instrumentation Fix Report\n==========================\n\nTotal gaps: 3\nApplied: 1\nSkipped: 1\nFailed: 1\n\nFile: a.rs\n  [SKIPPED: Severity filter] e at line 2\n  [DRY-RUN] f at line 9\n      x\n    + y\n"
        "\nFile: b.rs\n  [FAILED: Failed to read file] g at line 3\n"
    )
    assert fixer.tally(spark.createDataFrame(rows, "file string, line int, function_name string, status string, diff string")).count() == 1


def contexts(spark, texts):
    from spanlight.operators.detectors import detect

    rows = lines.scan_lines(spark.createDataFrame(texts, "file string, source string"))
    return {(x["file"], x["line"]): (x["module_path"], x["function"], x["depth"]) for x in detect(rows.repartition(3), "spanlight.operators.detectors:Contexts").collect()}


def test_contexts_of_lines(spark):
    source = 'mod a {\n  fn f() { let s = "} {";\n    /* } /* } */ } */ g(\'{\', r#"}"#);\n    let t = "open {\n } still";\n  }\n  mod b { fn one() {} }\n  fn after();\n  struct S { x: u8 }\n}\nfn last() {}\n// fn no() {\n}\nlet z;\n'
    got = contexts(spark, [("x", source), ("y", "fn only() {\n"), ("z", "")])
    at = lambda n: got[("x", n)][:2]
    assert at(1) == (["a"], None) and at(2) == (["a"], "f") and at(3) == (["a"], "f") and at(5) == (["a"], "f") and at(6) == (["a"], "f")
    assert at(7) == (["a", "b"], "one") and at(8) == (["a"], None) and at(9) == (["a"], None) and at(10) == (["a"], None)
    assert at(11) == ([], "last") and at(12) == ([], None) and at(13) == ([], None) and got[("y", 1)] == ([], "only", 0)


def test_each_detector_has_its_columns(spark):
    from spanlight.operators.detectors import LineDetector, detect

    rows = spark.createDataFrame([("a", 1, "x")], "file string, line int, raw string")
    assert detect(rows, "spanlight.operators.detectors:LineDetector").columns == ["file", "line"]
    assert detect(rows, "spanlight.operators.detectors:Contexts").columns == ["file", "line", "module_path", "function", "depth"]
    assert list(LineDetector().close()) == []


def test_files_are_written_once(spark, tmp_path):
    """A second run changes nothing and keeps the first backup; what is restored is the text before."""
    from spanlight.sources.rewrite import restore_files, rewrite_files

    (tmp_path / "a.rs").write_text("old")
    rows = spark.createDataFrame([(str(tmp_path / "a.rs"), "new é"), (str(tmp_path / "sub/b.rs"), "made"), (None, "x"), (str(tmp_path / "c.rs"), None)], "file string, source string")
    first = {x["file"].rsplit("/", 1)[1]: (x["n_bytes"], x["is_changed"], x["has_backup"]) for x in rewrite_files(rows, keep=True).collect()}
    assert first == {"a.rs": (6, True, True), "b.rs": (4, True, False)}
    again = {x["file"].rsplit("/", 1)[1]: (x["is_changed"], x["has_backup"]) for x in rewrite_files(rows, keep=True).collect()}
    assert again == {"a.rs": (False, True), "b.rs": (False, False)}
    assert ((tmp_path / "a.rs").read_text(), (tmp_path / "a.rs.bak").read_text()) == ("new é", "old")
    assert sorted(x["is_restored"] for x in restore_files(rows).collect()) == [False, False, True]
    assert (tmp_path / "a.rs").read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["a.rs", "sub"]
