"""Tables from parsed sources (F-3, F-8, F-9, Y-1 to Y-10, A-8, C-1, C-4, C-7, C-20, E-8 to E-13, H-6, P-6, V-7).

Each file is parsed once in a Python worker; one JSON document a file comes
back and Spark takes it apart.  `observed=True` keeps the visitor's habit of
stepping over the direct child of a call, method, try, branch or operator;
False visits every expression.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ship import map_arrow
from ..functions.text import contains_any, module_path
from ..sources import tree
from .graph import node_kind
from .rustlex import Attribute, Item, Node, SyntaxFault, cut_items, parse

LOC = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
SCHEMA = f"""struct<
 functions:array<struct<ord:int,id:string,name:string,full_path:string,is_async:boolean,is_unsafe:boolean,is_test:boolean,is_generic:boolean,param_count:int,return_type:string,
  calls:array<struct<callee:string,is_method:boolean,loc:{LOC}>>,cyclomatic:int,cognitive:int,lines_of_code:int,statement_count:int,max_nesting_depth:int,branch_count:int,loop_count:int,
  result_returns:int,option_returns:int,unwrap_calls:int,expect_calls:int,question_mark_ops:int,error_matches:int,error_if_lets:int,tokens:string,attributes:array<string>,loc:{LOC}>>,
 elements:array<struct<id:string,kind:string,loc:{LOC},parent_id:string,is_test:boolean>>,
 modules:array<struct<name:string,path:array<string>,is_test:boolean,loc:{LOC}>>,
 nodes:array<struct<name:string,inline:array<string>,is_public:boolean,is_async:boolean,is_unsafe:boolean,generics:array<string>,attributes:array<string>,paths:array<string>,signature:string>>,
 imports:array<struct<local_name:string,full_path:string>>,
 traced:array<struct<caller:string,path:string,is_method:boolean,is_conditional:boolean,is_in_loop:boolean>>,
 endpoints:array<struct<method:string,path:string,handler:string,module_path:array<string>,line:int>>,
 routers:array<struct<name:string,base_path:string,routes:array<struct<method:string,path:string,handler:string>>,middleware:array<string>>>,
 handlers:array<struct<name:string,is_async:boolean,return_type:string,parameters:array<struct<name:string,ty:string,is_extractor:boolean>>,extractors:array<string>,documentation:string>>>"""


def _loc(start: tuple, end: tuple) -> dict:
    return {"start_line": start[0], "start_column": start[1], "end_line": end[0], "end_column": end[1]}


def _paths(attributes: list[Attribute]) -> list[str]:
    return [a.path for a in attributes if a.path != "doc"]


class Visitor:
    """Functions, elements and modules of one file."""

    def __init__(self, observed: bool):
        self.observed = observed
        self.functions: list[dict] = []
        self.elements: list[dict] = []
        self.modules: list[dict] = []
        self.path: list[str] = []
        self.counter = self.depth = 0
        self.function: dict | None = None
        self.in_test = False

    def new_id(self, kind: str) -> str:
        self.counter += 1
        return f"{kind}_{self.counter - 1}"

    def element(self, kind: str, start: tuple, end: tuple) -> None:
        self.elements.append({"id": self.new_id(kind), "kind": kind, "loc": _loc(start, end), "parent_id": self.function and self.function["id"], "is_test": self.in_test})

    def count(self, name: str, n: int = 1) -> None:
        if self.function is not None:
            self.function[name] += n

    def branch(self, cognitive: int) -> None:
        self.count("cyclomatic")
        self.count("cognitive", cognitive)
        self.count("branch_count")

    def items(self, items: list[Item]) -> None:
        for item in items:
            self.item(item)

    def item(self, item: Item, method: bool = False) -> None:
        if item.kind == "fn":
            self.fn(item, method)
        elif item.kind == "mod":
            before = self.in_test
            test = any(a.path == "cfg" and "test" in a.text for a in item.attributes)
            self.in_test |= test
            self.path.append(item.name)
            self.modules.append({"name": item.name, "path": list(self.path), "is_test": test, "loc": _loc(*item.at)})
            self.items(item.items)
            self.path.pop()
            self.in_test = before
        elif item.kind == "impl":
            for x in item.items:
                self.item(x, method=True)
        elif item.kind == "trait":
            for x in item.items:
                if x.body is not None and x.kind == "fn":
                    self.block(x.body)
                elif x.body is not None:
                    self.visit(x.body)
        elif item.body is not None:
            self.visit(item.body)

    def fn(self, item: Item, method: bool) -> None:
        paths, x = _paths(item.attributes), item.extra
        test = "test" in paths or "tokio_test" in paths
        before_test, before = self.in_test, self.function
        self.in_test |= test
        returns = x["returns"] or ""
        info = {
            "id": self.new_id("Function"), "name": item.name, "full_path": "::".join([*self.path, item.name]), "is_async": x["is_async"], "is_unsafe": x["is_unsafe"], "is_test": test,
            "is_generic": bool(x["generics"]), "param_count": max(len(x["params"]) - method, 0), "return_type": x["returns"], "calls": [], "cyclomatic": 1, "cognitive": 0, "lines_of_code": 0,
            "statement_count": 0, "max_nesting_depth": 0, "branch_count": 0, "loop_count": 0, "result_returns": int("Result" in returns), "option_returns": int("Option" in returns), "unwrap_calls": 0,
            "expect_calls": 0, "question_mark_ops": 0, "error_matches": 0, "error_if_lets": 0, "loc": _loc(*item.at), "attributes": [a.text for a in item.attributes if a.path != "doc"],
            "tokens": f"{x['signature']} {{ {item.body.text} }}" if item.body else x["signature"],
        }
        self.function = info
        if item.body is not None:
            self.block(item.body)
            if not self.observed:
                info["lines_of_code"] = item.body.end[0] - item.body.start[0] + 1
        info["ord"] = len(self.functions)
        self.functions.append(info)
        self.function, self.in_test = before, before_test

    def block(self, block: Node) -> None:
        if self.observed:
            # Token text stands on one line.
            self.count("lines_of_code", 1)
        self.statements(block)

    def statements(self, block: Node) -> None:
        for s in block.parts:
            self.statement(s)

    def statement(self, s: Node) -> None:
        self.count("statement_count")
        if s.kind == "Item":
            self.item(s.parts[0])
        elif s.kind == "Local":
            for p in s.parts:
                self.block(p) if p.kind == "Block" and not p.text == "" and p is not s.parts[0] else self.visit(p)
        elif s.kind == "Stmt":
            self.element("Statement", s.parts[0].start, s.parts[0].end)
            self.visit(s.parts[0])

    def children(self, e: Node) -> None:
        """What an expression holds, without the expression itself."""
        if e.kind in ("Block", "Unsafe", "Async") and e.parts and e.parts[0].kind == "Block":
            self.block(e.parts[0])
        elif e.kind in ("If", "While", "For", "Loop"):
            for p in e.parts:
                self.block(p) if p.kind == "Block" and not (p.parts and p.parts[0].kind == "Block" and p.text == "" and e.kind == "If") else self.visit(p)
        elif e.kind == "Match":
            self.visit(e.parts[0])
            for arm in e.parts[1:]:
                if arm.extra["guard"] is not None:
                    self.visit(arm.extra["guard"])
                self.visit(arm.parts[0])
        else:
            for p in e.parts:
                self.visit(p)

    def child(self, e: Node) -> None:
        self.children(e) if self.observed else self.visit(e)

    def nested(self, parts: list[Node]) -> None:
        self.depth += 1
        if self.function is not None:
            self.function["max_nesting_depth"] = max(self.function["max_nesting_depth"], self.depth)
        for p in parts:
            if p.kind == "Block" and not (len(p.parts) == 1 and p.parts[0].kind == "Block" and p.text == ""):
                self.statements(p)
            else:
                self.child(p)
        self.depth -= 1

    def visit(self, e: Node) -> None:
        kind = e.kind
        if kind == "Call":
            callee = e.parts[0]
            self.element("FunctionCall", callee.start, callee.end)
            if callee.kind == "Path" and self.function is not None:
                self.function["calls"].append({"callee": callee.text, "is_method": False, "loc": _loc(callee.start, callee.end)})
            for p in e.parts:
                self.child(p)
        elif kind == "MethodCall":
            self.element("MethodCall", *e.at)
            if self.function is not None:
                self.function["calls"].append({"callee": e.name, "is_method": True, "loc": _loc(*e.at)})
                if e.name in ("unwrap", "expect"):
                    self.count(f"{e.name}_calls")
            for p in e.parts:
                self.child(p)
        elif kind == "If":
            self.element("IfExpression", *e.at)
            self.branch(1)
            self.nested(e.parts)
        elif kind == "Match":
            self.element("MatchExpression", *e.at)
            if "Result" in e.text or "Option" in e.text:
                self.count("error_matches")
            if len(e.parts) > 2:
                self.branch(len(e.parts) - 2)
            self.depth += 1
            if self.function is not None:
                self.function["max_nesting_depth"] = max(self.function["max_nesting_depth"], self.depth)
            self.child(e.parts[0])
            for arm in e.parts[1:]:
                self.element("MatchArm", arm.start, arm.end)
                if arm.extra["guard"] is not None:
                    self.child(arm.extra["guard"])
                self.child(arm.parts[0])
            self.depth -= 1
        elif kind in ("Loop", "While", "For"):
            self.element("Loop", *e.at)
            self.branch(1)
            self.count("loop_count")
            self.nested(e.parts)
        elif kind == "Return":
            self.element("Return", *e.at)
            for p in e.parts:
                self.child(p)
        elif kind == "Try":
            self.count("question_mark_ops")
            self.child(e.parts[0])
        elif kind == "Closure":
            self.element("Closure", *e.at)
            self.branch(1)
            self.nested(e.parts)
        elif kind == "Binary":
            self.element("BinaryOp", e.start, e.end)
            if e.name in ("&&", "||"):
                self.branch(1)
            for p in e.parts:
                self.child(p)
        elif kind == "Unary":
            self.element("UnaryOp", e.start, e.end)
            self.child(e.parts[0])
        elif kind == "Assign":
            self.element("Assignment", *e.at)
            for p in e.parts:
                self.child(p)
        else:
            self.children(e)


def _every(e):
    """All expression nodes below, statements and nested items' bodies left out."""
    stack = [e]
    while stack:
        n = stack.pop()
        if isinstance(n, Item):
            continue
        yield n
        guard = n.extra.get("guard") if n.kind == "Arm" else None
        stack += [*([guard] if guard is not None else []), *n.parts][::-1]


def definitions(items: list[Item], inline: list[str], nodes: list[dict], imports: list[dict]) -> None:
    """Free functions, inline modules and uses; methods are no nodes (C-1, C-7)."""
    for item in items:
        if item.kind == "fn":
            x = item.extra
            nodes.append({
                "name": item.name, "inline": inline, "is_public": item.public, "is_async": x["is_async"], "is_unsafe": x["is_unsafe"], "generics": x["generics"],
                "attributes": [a.text for a in item.attributes if a.path != "doc"], "paths": _paths(item.attributes), "signature": x["signature"],
            })
        elif item.kind == "mod":
            definitions(item.items, [*inline, item.name], nodes, imports)
        elif item.kind == "use":
            tree, path = item.extra["tree"], []
            groups = [tree]
            if tree["kind"] == "group":
                groups = tree["of"]
            for t in groups:
                path = []
                while t["kind"] == "path":
                    path.append(t["name"])
                    t = t["of"]
                if t["kind"] == "name":
                    imports.append({"local_name": t["name"], "full_path": "::".join([*path, t["name"]])})
                elif t["kind"] == "rename":
                    imports.append({"local_name": t["as"], "full_path": "::".join([*path, t["name"]])})


def trace(items: list[Item], out: list[dict]) -> None:
    """Calls in free functions with whether they lie under an if and in a loop (C-4)."""

    def walk(n, caller: str | None, conditional: bool, loop: bool) -> None:
        if isinstance(n, Item):
            if n.kind == "fn" and n.body is not None:
                walk(n.body, n.name, False, False)
            else:
                for x in [*n.items, *([n.body] if n.body is not None else [])]:
                    walk(x, caller if n.kind != "mod" else None, conditional, loop)
            return
        if n.kind == "Call" and n.parts[0].kind == "Path" and caller is not None:
            out.append({"caller": caller, "path": n.parts[0].text.replace(" ", ""), "is_method": False, "is_conditional": conditional, "is_in_loop": loop})
        if n.kind == "MethodCall" and caller is not None:
            out.append({"caller": caller, "path": n.name, "is_method": True, "is_conditional": conditional, "is_in_loop": loop})
        guard = n.extra.get("guard") if n.kind == "Arm" else None
        for p in [*([guard] if guard is not None else []), *n.parts]:
            walk(p, caller, conditional or n.kind == "If", loop or n.kind in ("Loop", "While", "For"))

    for item in items:
        if item.kind == "impl" or item.kind == "trait":
            for x in item.items:
                if x.body is not None:
                    walk(x.body, None, False, False)
        elif item.kind == "mod":
            trace(item.items, out)
        else:
            walk(item, None, False, False)


def _string(e: Node) -> str | None:
    return e.text[1:-1] if e.kind == "Lit" and e.text.startswith('"') else None


def _path_text(e: Node) -> str:
    return "::".join(e.extra.get("names", [])) if e.kind == "Path" else ""


def web_endpoints(items: list[Item], modules: list[str], out: list[dict]) -> None:
    """Method calls named like an HTTP method with a path and a handler (E-8)."""
    for item in items:
        inner = [*modules, item.name] if item.kind == "mod" else modules
        for body in [item.body] if item.body is not None else []:
            for e in _every(body):
                if e.kind == "MethodCall" and e.name in (*K.AXUM_METHODS, "trace") and len(e.parts) >= 3 and _string(e.parts[1]) is not None and e.parts[2].kind == "Path":
                    out.append({"method": e.name.upper(), "path": _string(e.parts[1]), "handler": _path_text(e.parts[2]), "module_path": inner, "line": 0})
        web_endpoints(item.items, inner, out)


def routers(items: list[Item], out: list[dict]) -> None:
    """Functions whose body calls `new` as a method on a Router path, with their routes, nest and layers (E-9)."""
    for item in items:
        routers(item.items, out)
        if item.kind != "fn" or item.body is None:
            continue
        calls = [e for e in _every(item.body) if e.kind == "MethodCall"]
        if not any(e.name == "new" and _path_text(e.parts[0]).split("::")[-1] == "Router" for e in calls):
            continue
        routes, base, layers = [], "", []
        for e in calls:
            if e.name in (*K.AXUM_METHODS, "trace") and len(e.parts) >= 3 and _string(e.parts[1]) is not None:
                routes.append({"method": e.name.upper(), "path": _string(e.parts[1]), "handler": _path_text(e.parts[2])})
            if e.name == "nest" and len(e.parts) >= 2 and _string(e.parts[1]) is not None:
                base = _string(e.parts[1])
            if e.name == "layer" and len(e.parts) >= 2:
                layers.append(_path_text(e.parts[1]))
        out.append({"name": item.name, "base_path": base, "routes": routes, "middleware": layers})


def handlers(items: list[Item], out: list[dict]) -> None:
    """Functions that return what a handler returns, with their parameters (E-10 to E-13)."""
    for item in items:
        handlers(item.items if item.kind == "mod" else [], out)
        if item.kind != "fn":
            continue
        returns = item.extra["returns"]
        if not (returns is None or returns == "( )" or any(w in returns for w in K.HANDLER_RETURNS)):
            continue
        params = []
        for p in item.extra["params"]:
            name, colon, _ = p.partition(" : ")
            if colon and name.replace("mut ", "").isidentifier():
                params.append({"name": name.replace("mut ", ""), "ty": p, "is_extractor": any(x in p for x in K.EXTRACTORS)})
        docs = [a.text.strip() for a in item.attributes if a.path == "doc" and not a.inner]
        out.append({
            "name": item.name, "is_async": item.extra["is_async"], "return_type": returns or "()", "parameters": params, "extractors": [p["ty"] for p in params if p["is_extractor"]],
            "documentation": "\n".join(docs) if docs else None,
        })


def analyse(source: str, observed: bool, first: int = 1) -> dict:
    _, items, tokens = parse(source, first)
    v = Visitor(observed)
    v.items(items)
    out: dict = {"functions": v.functions, "elements": v.elements, "modules": v.modules, "nodes": [], "imports": [], "traced": [], "endpoints": [], "routers": [], "handlers": []}
    definitions(items, [], out["nodes"], out["imports"])
    trace(items, out["traced"])
    web_endpoints(items, [], out["endpoints"])
    routers(items, out["routers"])
    handlers(items, out["handlers"])
    out["tokens"] = tokens
    return out


def _pieces(size: int):
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.int64()), ("source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((file, n, line, text) for file in tree.each_file(batches) for n, (line, text) in enumerate(cut_items(tree.text_of(file), size)))
        return tree.batched(rows, schema, lambda row: 100 + len(row[3]))

    return run


def source_pieces(files: DataFrame, size: int = 1 << 15) -> DataFrame:
    """file, at, line, source of pieces of files of any size, cut between items; line is the first one of a piece (F-8)."""
    return map_arrow(tree.dealt(files.select("file")), _pieces(size), "file string, at bigint, line bigint, source string")


def _parse(observed: bool, keys: list[str], parts: list[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(20_000)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                cut = batch.slice(lo, 64)
                ok, why, told, tokens = [], [], [], []
                lines = cut.column("line").to_pylist() if "line" in cut.schema.names else [1] * cut.num_rows
                for source, line in zip(cut.column("source").to_pylist(), lines):
                    try:
                        found = analyse(source, observed, line) if source is not None else None
                        ok.append(found is not None)
                        why.append(None if found else "no source")
                        text = found.pop("tokens") if found else None
                        tokens.append(text if parts is None else None)
                        told.append(json.dumps({k: v for k, v in found.items() if parts is None or k in parts}, ensure_ascii=False) if found else None)
                    except (SyntaxFault, IndexError) as fault:
                        ok.append(False)
                        why.append(str(fault))
                        told.append(None)
                        tokens.append(None)
                yield pa.record_batch([*[cut.column(k) for k in keys], pa.array(ok), pa.array(why, pa.string()), pa.array(told, pa.string()), pa.array(tokens, pa.string())], [*keys, "parse_ok", "parse_error", "told", "tokens_text"])

    return run


def parse_files(files: DataFrame, observed: bool = True) -> DataFrame:
    """file, parse_ok, parse_error, ast, tokens_text of each file (F-3, H-6, Y-1); a file that fails has no ast."""
    rows = map_arrow(files.select("file", "source"), _parse(observed, ["file"]), "file string, parse_ok boolean, parse_error string, told string, tokens_text string")
    return rows.withColumn("ast", F.from_json("told", SCHEMA)).drop("told")


def parse_pieces(pieces: DataFrame, observed: bool = True, parts: list[str] | None = None) -> DataFrame:
    """What parse_files has for each of source_pieces, and at, its place in the file; lines are those of the file, ids of elements count within a piece.

    With parts, ast has these alone and there are no token texts: all of them are some 15 times the source.
    """
    rows = map_arrow(tree.dealt(pieces.select("file", "at", "line", "source")), _parse(observed, ["file", "at"], parts), "file string, at bigint, parse_ok boolean, parse_error string, told string, tokens_text string")
    return rows.withColumn("ast", F.from_json("told", SCHEMA)).drop("told")


def parsed_or_fail(parsed: DataFrame) -> DataFrame:
    """parsed, with an error at the first file that does not parse (F-8)."""
    return parsed.withColumn("parse_ok", F.when(F.col("parse_ok"), True).otherwise(F.raise_error(F.concat("file", F.lit(": "), "parse_error")).cast("boolean"))).filter("parse_ok")


def _exploded(parsed: DataFrame, part: str) -> DataFrame:
    keys = [c for c in ("file", "at") if c in parsed.columns]
    return parsed.filter("parse_ok").select(*keys, F.explode(f"ast.{part}").alias("x")).select(*keys, "x.*")


def functions(parsed: DataFrame) -> DataFrame:
    """A row for each function and method (Y-2, Y-3, Y-5 to Y-9, A-8)."""
    return _exploded(parsed, "functions")


def elements(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "elements")  # Y-4


def modules(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "modules")  # Y-10


def imports(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "imports")  # C-7


def web_routes(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "endpoints")  # E-8


def web_routers(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "routers")  # E-9


def web_handlers(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "handlers")  # E-10 to E-13


def is_extractor(ty: Column) -> Column:
    """Whether a type's text holds an extractor's name (E-11)."""
    return contains_any(ty, K.EXTRACTORS)


def fn_nodes(parsed: DataFrame) -> DataFrame:
    """Nodes of free functions, the first of equal ids by file and piece (C-1 to C-3, S-10, S-11)."""
    from .graph import first_nodes

    order = [c for c in ("file", "at") if c in parsed.columns]
    rows = _exploded(parsed, "nodes").withColumn("module_path", F.concat(module_path(F.col("file")), "inline"))
    rows = rows.select(
        F.array_join(F.array_append("module_path", F.col("name")), "::").alias("id"), "name", "module_path", node_kind(F.col("name"), F.col("paths")).alias("kind"), "file", F.lit(0).alias("line"),
        "signature", "is_async", "is_unsafe", "generics", "attributes", "is_public", *order[1:],
    )
    return first_nodes(rows, order).drop("at")


def call_edges(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind, flags of calls that resolve to nodes or outside (C-4 to C-6, C-8, C-10).

    Symbols are the short names of functions, as their registration leaves
    the modules out; an edge between modules survives only where its target is
    a node id, or lies outside.
    """
    from .graph import resolve_calls

    calls = _exploded(parsed, "traced").filter("not is_method").withColumn("src", F.array_join(F.array_append(module_path(F.col("file")), F.col("caller")), "::"))
    calls = calls.withColumn("call_id", F.xxhash64("file", "caller", "path")).withColumn("module", F.array().cast("array<string>"))
    symbols = nodes.select(F.col("name").alias("full_path")).distinct()
    once = calls.select("call_id", "module", "path").dropDuplicates(["call_id"])
    found = resolve_calls(once, symbols, imports(parsed).select("local_name", "full_path").groupBy("local_name").agg(F.max("full_path").alias("full_path")))
    out = calls.join(found.select("call_id", "full_path", "is_external"), "call_id").filter("full_path is not null")
    kind = F.when(~F.col("is_external") & (F.col("full_path") == F.col("src")), "Recursive").otherwise("Direct")
    edges = out.select("src", F.col("full_path").alias("dst"), kind.alias("kind"), "is_conditional", "is_in_loop", "is_external")
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    inside = kept.filter("not is_external").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.unionByName(kept.filter("is_external")).select("src", "dst", "kind", "is_conditional", "is_in_loop")


def token_matches(parsed: DataFrame, pattern_set: list | None = None) -> DataFrame:
    """doc (file and function), grp, pattern, weight, matched over token texts (P-6).

    Names meet the name patterns, attributes theirs and whole functions the
    rest.  Tokens stand apart by spaces, so patterns such as `#[test]` or
    `assert!` cannot match there.
    """
    from .patterns import match_patterns

    pattern_set = K.PATTERNS if pattern_set is None else pattern_set
    f = functions(parsed).select(F.concat_ws("#", "file", "full_path").alias("doc"), "name", "attributes", "tokens")
    of = lambda *groups: [p for p in pattern_set if p[0] in groups or ("framework" in groups and p[0].startswith("framework:"))]
    names = match_patterns(f.select("doc", F.col("name").alias("text")), of("function_names"))
    attributes = match_patterns(f.select("doc", F.explode("attributes").alias("text")), of("attributes"))
    bodies = match_patterns(f.select("doc", F.col("tokens").alias("text")), of("assertions", "error_handling", "framework"))
    return names.unionByName(attributes).unionByName(bodies).drop("ord")
