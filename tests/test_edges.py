"""Queries on rows at the edges of what the given tables hold, and on larger files and graphs, against their SQL."""

from __future__ import annotations

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlight.plans.queries import QUERIES, SQL
from spanlight.sources.tables import setting


def from_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return sorted(con.sql(SQL[name]).fetchall(), key=repr)


def write_events(folder, rows):
    """rows of (ts, user_id, event_type); event_id counts them."""
    ts, users, types = zip(*rows)
    columns = {"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": list(types), "value": [1.0] * len(rows), "props": ["{}"] * len(rows)}
    pq.write_table(pa.table(columns), f"{folder}/events.parquet")


def test_hours_are_those_of_sql(spark, tmp_path):
    """Ends of hours, to the microsecond, before and after 1970 and where a time zone has no such hour."""
    rows = []
    for n, at in enumerate([datetime.datetime(2024, 1, 1, 5), datetime.datetime(1969, 12, 31, 22), datetime.datetime(1970, 1, 1), datetime.datetime(2024, 3, 10, 3)]):
        for m, us in enumerate([-500_001, -500_000, -499_999, -1, 0, 499_999, 500_000]):
            rows += [(at + datetime.timedelta(microseconds=us), 10 * n + m, "purchase"), (at + datetime.timedelta(hours=2, microseconds=-500_000), 10 * n + m, "error"), (at - datetime.timedelta(hours=2), 10 * n + m, "error")]
    rows += [(None, 1, "purchase"), (datetime.datetime(2024, 1, 1), None, "purchase"), (None, 1, "error")]
    write_events(tmp_path, rows)
    want = from_sql(tmp_path, "gaps_events", "events")
    assert 5 < len(want) < 30
    for zone in ("UTC", "America/New_York"):
        with setting(spark, "spark.sql.session.timeZone", zone):
            assert sorted(map(tuple, QUERIES["gaps_events"](spark, str(tmp_path)).select("event_id", "file", "line").collect()), key=repr) == want


def test_pairs_of_one_end_share_a_search(spark, monkeypatch):
    """Paths from and to few ids are as short as those that are searched for each pair, and no search is made for each pair."""
    from test_graph_scale import EDGE, depths, made, near

    from spanlight.operators import traverse

    rows = made(17, 60, 100, [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", "n03"), ("n03", "n03"), (None, "n03")])
    g = near(rows)
    pairs = [(x, "n03") for x in sorted(g)] + [("n05", "no"), ("no", "n03"), ("no", "no"), (None, "n03"), ("n07", None)] + [(x, "c12") for x in sorted(g)]
    monkeypatch.setattr(traverse, "_met", None)
    for flip in (False, True):
        asked, edges = [[(b, a) if flip else (a, b) for a, b in part] for part in (pairs, rows)]
        h = near(edges)
        out = traverse.paths_between(spark.createDataFrame(asked, EDGE), spark.createDataFrame(edges, EDGE)).collect()
        assert len(out) == len(set(asked))
        found = 0
        for r in out:
            d = depths(h, r["src"]) if r["src"] is not None else {}
            if r["dst"] not in d:
                assert r["path"] is None
            else:
                found += 1
                assert (r["path"][0], r["path"][-1], len(r["path"]) - 1) == (r["src"], r["dst"], d[r["dst"]])
                assert all(b in h[a] for a, b in zip(r["path"], r["path"][1:]))
        assert found > 40


def test_excluded_files_are_not_read(spark, tmp_path):
    """A file beyond 2 GB in an excluded folder stops no scan; trees walked in tasks have the files that Spark finds."""
    from spanlight.sources import files, tree

    for name, text in {"a b.rs": "fn a() {}\n", "c+d.rs": "//\n", "empty.rs": "", "deep/er/ü.rs": "é", "note.txt": "no", "retarget/x.rs": "x", "_tmp/y.rs": "y", ".z.rs": "z", "k=v/_n=1.rs": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "target").mkdir()
    with open(tmp_path / "target/big.rs", "wb") as f:
        f.truncate(2**31 + 10)  # takes no room
    got = {x["file"]: x["source"] for x in files.scan_files(spark, [str(tmp_path)]).collect()}
    assert {k.rpartition("/")[2] for k in got} == {"a b.rs", "c+d.rs", "ü.rs", "_n=1.rs"}
    assert sorted(x["file"] for x in tree.list_files(spark, [f"file://{tmp_path}"]).collect()) == sorted(got)
    both = tree.list_files(spark, [str(tmp_path / "retarget/x.rs"), str(tmp_path), str(tmp_path / "deep")], ["deep/er"])
    assert sorted(x["file"].rpartition("/")[2] for x in both.filter("file not like '%big%'").collect()) == ["_n=1.rs", "a b.rs", "c+d.rs", "x.rs", "x.rs"]


def test_hashes_of_files_read_in_blocks(spark, tmp_path):
    import hashlib


    from spanlight.sources import tree

    text = "x" + "ä€😀\r\n" * 300_000  # characters across the ends of blocks
    (tmp_path / "long.rs").write_bytes(text.encode())
    (tmp_path / "bom.rs").write_bytes(b"\xef\xbb\xbfa")
    got = {x["file"].rpartition("/")[2]: x["content_hash"] for x in tree.hash_files(tree.list_files(spark, [str(tmp_path)])).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    (tmp_path / "bad.rs").write_bytes(b"a\xff")
    with pytest.raises(Exception, match="is no UTF-8"):
        tree.hash_files(tree.list_files(spark, [str(tmp_path)])).collect()


ITEMS = [
    "fn a() {}", "pub(crate) async fn b<'a>(x: &'a str) -> Vec<u8> {\n  let s = \"} fn {\\\" \";\n  if x == '}' { g('\\u{7d}') }\n}", "use a::{b, c as d};\nuse e::f;", "const A: T = T { a: 1 }\n;\n", "const B: u8 = if X { 1 }\nelse { 2 };", "static C: [u8; 2] = [\n1,\n2];",
    "/* } /* { */\n fn no() {} */", "// } fn no() {\n", "//! inner {\n", "/// doc }\n#[cfg(test)]\nmod tests {\n  use super::*;\n  #[test]\n  fn t() { assert_eq!(1, 1); }\n}", "macro_rules! m { ($a:expr) => { fn x() {} } }", "lazy_static! {\n static ref X: u8 = 1;\n}", "thing!(a;\nb);\n",
    "impl<T> X for Y<N>\nwhere T: Z {\n  fn m(&self) {}\n}", "struct U;", "enum E { A, B(u8) }", "type F = G<{ 1 }>\n;", "fn r() { let x = r##\"\n} \"# fn z() {\n\"##; }", "fn q() -> H<{ 1 }>\nwhere I: J {}", "extern \"C\" {\n fn c();\n}", "trait T {\n  fn d();\n}", "fn byte() { f(b'{', br\"}\", c\"{\", 'l', r#type); }", "mod sub {\n fn a() {}\n}", "fn é() { \"😀}\"; }", "const D: u8 = { 1 }\n+ { 2 };", "#[a] #[b]\nunsafe fn u() {}", "fn s() {} fn t() {}",
]


def test_pieces_have_the_items_of_the_source():
    """Cut wherever it may be, however a source arrives, pieces join to the source and parse to what it holds; what does not parse whole has a piece that does not."""
    import random

    from spanlight.operators.ast import analyse
    from spanlight.operators.rustlex import SyntaxFault, cut_items

    r = random.Random(5)
    kinds = ("functions", "nodes", "imports", "traced", "endpoints", "routers", "handlers")
    cuts = 0
    for n in range(150):
        source = ("#!/bin/x {\n" if n % 7 == 0 else "") + "".join(x + r.choice(["\n", "\n\n  ", " ", "\r\n"]) for x in r.choices(ITEMS, k=r.randint(0, 25)))
        width = r.choice([1, 3, 50, 10_000])
        pieces = list(cut_items((source[i : i + width] for i in range(0, len(source), width)), r.choice([1, 30, 200])))
        assert "".join(text for _, text in pieces) == source
        cuts += len(pieces) - 1
        whole, found = analyse(source, True), [analyse(text, True, line) for line, text in pieces]
        for k in kinds:
            bare = lambda rows: [{a: b for a, b in x.items() if a not in ("id", "ord")} for x in rows]
            assert bare(whole[k]) == bare(sum((x[k] for x in found), [])), (k, source)
    assert cuts > 500
    for fault in ("fn a( {}\n", "}\n", "fn b() {\n", "const A: u8 = { 1 }\nfn c() {}\n", 'const X: &str = "open\n', "fn d() { '\n }\n", "/* open\n", "let x = 1;\n", 'fn e() { r#"open }\n', "use a::{b}\nfn f() {}\n"):
        source = "fn one() {}\n" * 20 + fault + "fn two() {}\n" * 20
        with pytest.raises(SyntaxFault):
            analyse(source, True)
        with pytest.raises(SyntaxFault):
            for line, text in cut_items((source[i : i + 60] for i in range(0, len(source), 60)), 1):
                analyse(text, True, line)


def test_files_are_parsed_in_pieces(spark, tmp_path):
    """No row of a scan holds a large file; lines and faults are those of the file."""
    from spanlight.operators import ast
    from spanlight.sources import tree

    text = "".join(f"fn f{i}() {{\n    g();\n}}\n" for i in range(20_000))
    (tmp_path / "big.rs").write_text(text)
    files = tree.list_files(spark, [str(tmp_path)])
    pieces = ast.source_pieces(files, 4096)
    sizes = [len(x["source"]) for x in pieces.collect()]
    assert sum(sizes) == len(text) and max(sizes) < 4200
    parsed = ast.parse_pieces(pieces)
    assert ast.fn_nodes(ast.parsed_or_fail(parsed)).count() == 20_000
    assert {x["name"]: x["loc"]["start_line"] for x in ast.functions(parsed).collect()}["f19999"] == 3 * 19_999 + 1
    (tmp_path / "big.rs").write_text(text + "}\n" + text)
    with pytest.raises(Exception, match="line 60001: "):
        ast.fn_nodes(ast.parsed_or_fail(ast.parse_pieces(pieces))).count()


def test_fixes_on_disk_are_listed_in_tasks(spark, monkeypatch):
    """The driver's file index lists none of the files that are fixed, and nothing of them stays."""
    import glob

    from spanlight.plans import queries
    from spanlight.sources import tables

    monkeypatch.setattr(queries.files, "scan_files", None)
    sf = "/root/testdata/sf0.001"
    got = QUERIES["fix_write"](spark, sf)
    assert sorted(map(tuple, got.select("file", "content_hash", "backup_hash", "is_restored").collect()), key=repr) == from_sql(sf, "fix_write", "documents")
    assert not glob.glob(f"{tables._app_dir(spark).removeprefix('file://')}/*-sources")


class Store:
    """A state's store that counts how often it is asked; as a value and as a map."""

    def __init__(self):
        self.asked, self.values = 0, {}

    def state(self, name):
        def at(f):
            def call(*a):
                self.asked += 1
                return f(self.values.setdefault(name, {}), *a)

            return staticmethod(call)

        return type("State", (), {
            "get": at(lambda d: d.get(())), "update": at(lambda d, v: d.__setitem__((), v)), "clear": at(lambda d: d.clear()), "exists": at(lambda d: () in d),
            "getValue": at(lambda d, k: d.get(k)), "containsKey": at(lambda d, k: k in d), "updateValue": at(lambda d, k, v: d.__setitem__(k, v)), "removeKey": at(lambda d, k: d.pop(k, None)),
        })()

    def getValueState(self, name, schema):
        return self.state(name)

    def getMapState(self, name, key, value):
        return self.state(name)


def test_state_is_asked_once_a_batch():
    """Changes of a file cost no round trip each, and what the store holds between batches is all there is to know."""
    import random

    from pyspark.sql import Row
    from test_sources_scale import gaps_by_hand

    from spanlight.streaming.gaps import GapKeeper

    r = random.Random(8)
    made = Row("file", "seq", "what", "line", "name", "added")
    rows = [made("f", i, r.choice(["point", "existing"]), r.randrange(12), r.choice("ab"), r.random() < 0.6) for i in range(600)]
    store, open_ = Store(), {}
    for lo in range(0, 600, 200):
        keeper = GapKeeper()
        keeper.init(store)
        asked = store.asked
        for x in keeper.handleInputRows(("f",), iter(r.sample(rows[lo : lo + 200], 200)), None):
            assert open_.get((x.line, x.name), False) != x.opened
            open_[(x.line, x.name)] = x.opened
        assert store.asked - asked <= 2
        assert sorted(k for k, v in open_.items() if v) == gaps_by_hand([tuple(x)[1:] for x in rows[: lo + 200]])
    gone = [made("f", 600 + i, x.what, x.line, x.name, False) for i, x in enumerate(rows)]
    list(keeper.handleInputRows(("f",), iter(gone), None))
    assert not any(store.values.values())
