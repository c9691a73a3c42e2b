"""A light parser of Rust sources: tokens, items and expressions, enough to walk functions.

Types, patterns and macro bodies stay token runs.  A source that does not
parse raises SyntaxFault; nothing is recovered from.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


class SyntaxFault(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # ident, life, lit, punct, open, close, doc, inner_doc, end
    text: str
    start: tuple[int, int]
    end: tuple[int, int]


_TOKEN = re.compile(
    r"""(?P<space>\s+)
  | (?P<inner_doc>//![^\n]*) | (?P<doc>///(?!/)[^\n]*) | (?P<comment>//[^\n]*)
  | (?P<raw>(?:br|cr|r)(?P<hash>\#*)"(?:.|\n)*?"(?P=hash))
  | (?P<text>[bc]?"(?:[^"\\]|\\(?:.|\n))*")
  | (?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|.))')
  | (?P<life>'[A-Za-z_]\w*)
  | (?P<number>\d[\w]*(?:\.(?!\.|[A-Za-z_])[\w]*)?(?:(?<=[eE])[+-]\d[\w]*)?)
  | (?P<ident>r\#[A-Za-z_]\w*|[A-Za-z_\u0080-\U0010ffff][\w]*)
  | (?P<open>[(\[{]) | (?P<close>[)\]}])
  | (?P<punct><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%^!&|=<>@.,;:\#$?~_])""",
    re.X,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_COMMENT = re.compile(r"/\*|\*/")


def tokenize(source: str, first: int = 1) -> list[Token]:
    """The tokens of a source, or of a piece of it that begins on line `first`."""
    out: list[Token] = []
    stack: list[str] = []
    at, line, column = 0, first, 0

    def advance(text: str) -> tuple[int, int]:
        n = text.count("\n")
        return (line + n, len(text) - text.rfind("\n") - 1) if n else (line, column + len(text))

    if first == 1 and source.startswith("#!") and not re.match(r"#!\s*\[", source):
        at = source.find("\n") if "\n" in source else len(source)
        column = at
    while at < len(source):
        if source.startswith("/*", at):
            depth, i = 1, at + 2
            while depth:
                m = _COMMENT.search(source, i)
                if not m:
                    raise SyntaxFault(f"line {line}: a comment is not closed")
                depth += 1 if m.group() == "/*" else -1
                i = m.end()
            line, column = advance(source[at:i])
            at = i
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise SyntaxFault(f"line {line}: unexpected {source[at]!r}")
        text, kind = m.group(), m.lastgroup
        if kind == "hash":
            kind = "raw"
        end = advance(text)
        if kind in ("raw", "text", "char", "number"):
            kind = "lit"
        if kind == "open":
            stack.append(_PAIRS[text])
        elif kind == "close" and (not stack or stack.pop() != text):
            raise SyntaxFault(f"line {line}: unmatched {text!r}")
        if kind not in ("space", "comment"):
            out.append(Token(kind, text, (line, column), end))
        line, column = end
        at = m.end()
    if stack:
        raise SyntaxFault(f"{stack[-1]!r} is missing")
    out.append(Token("end", "", (line, column), (line, column)))
    return out


@dataclass(slots=True)
class Node:
    """An expression, block, statement or arm; parts are its children in order."""

    kind: str
    start: tuple[int, int]
    end: tuple[int, int]
    parts: list = field(default_factory=list)
    text: str = ""
    name: str = ""
    at: tuple = ()
    extra: dict = field(default_factory=dict)


@dataclass(slots=True)
class Attribute:
    path: str
    text: str
    inner: bool = False


@dataclass(slots=True)
class Item:
    kind: str
    name: str
    attributes: list[Attribute]
    public: bool
    at: tuple
    items: list = field(default_factory=list)
    body: Node | None = None
    extra: dict = field(default_factory=dict)


def render(tokens: list[Token]) -> str:
    return " ".join(t.text for t in tokens)


_ITEM_WORDS = {"fn", "mod", "use", "struct", "enum", "union", "trait", "impl", "const", "static", "type", "extern", "macro_rules", "pub", "unsafe", "async", "auto", "default"}
_BINARY = {
    "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
_BLOCKLIKE = {"If", "Match", "Loop", "While", "For", "Block", "Unsafe", "Async"}


class Parser:
    def __init__(self, source: str, first: int = 1):
        self.tokens = tokenize(source, first)
        self.i = 0

    # -------------------------------------------------------------- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def is_(self, *texts: str) -> bool:
        return self.now.kind != "lit" and self.now.text in texts

    def next(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def take(self, text: str) -> bool:
        if self.is_(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.is_(text):
            raise SyntaxFault(f"line {self.now.start[0]}: {text!r} expected, not {self.now.text!r}")
        return self.next()

    def ident(self) -> Token:
        if self.now.kind != "ident":
            raise SyntaxFault(f"line {self.now.start[0]}: a name expected, not {self.now.text!r}")
        return self.next()

    def group(self) -> list[Token]:
        """The tokens inside the bracket that opens here; past its end after."""
        depth, begin = 0, self.i + 1
        while True:
            t = self.next()
            depth += (t.kind == "open") - (t.kind == "close")
            if not depth:
                return self.tokens[begin : self.i - 1]
            if t.kind == "end":
                raise SyntaxFault("a bracket is not closed")

    def run(self, stops: set[str], angles: bool = True) -> list[Token]:
        """Tokens up to one of stops outside all brackets."""
        depth = angle = 0
        begin = self.i
        while True:
            t = self.now
            if t.kind == "end":
                return self.tokens[begin : self.i]
            if not depth and angle <= 0 and t.kind != "lit" and t.text in stops:
                return self.tokens[begin : self.i]
            if t.kind == "close" and not depth:
                return self.tokens[begin : self.i]
            depth += (t.kind == "open") - (t.kind == "close")
            if angles and t.kind == "punct" and not depth:
                angle += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(t.text, 0)
            self.i += 1

    # -------------------------------------------------------------- items
    def file(self) -> tuple[list[Attribute], list[Item]]:
        inner = self.inner_attributes()
        return inner, self.items(None)

    def inner_attributes(self) -> list[Attribute]:
        """Attributes and docs of what encloses them, which stand first."""
        out = []
        while self.now.kind == "inner_doc" or (self.is_("#") and self.peek().text == "!"):
            before = self.i
            out += self.attributes(inner=True, most=1)
            if self.i == before:
                break
        return out

    def attributes(self, inner: bool = False, most: int = 0) -> list[Attribute]:
        out: list[Attribute] = []
        while not most or len(out) < most:
            t = self.now
            if t.kind == "inner_doc" and inner:
                out.append(Attribute("doc", t.text[3:], True))
                self.i += 1
            elif t.kind == "doc":
                out.append(Attribute("doc", t.text[3:]))
                self.i += 1
            elif self.is_("#") and (self.peek().text == "[" or (inner and self.peek().text == "!" and self.peek(2).text == "[")):
                begin = self.i
                is_inner = self.peek().text == "!"
                self.i += 2 if is_inner else 1
                body = self.group()
                path = []
                for x in body:
                    if x.kind == "ident" or x.text == "::":
                        path.append(x.text)
                    else:
                        break
                out.append(Attribute("".join(path), render(self.tokens[begin : self.i]), is_inner))
            else:
                break
        return out

    def items(self, close: str | None) -> list[Item]:
        out = []
        while True:
            attributes = [a for a in self.attributes(inner=True) if not a.inner]
            if self.now.kind == "end":
                if close:
                    raise SyntaxFault(f"{close!r} is missing")
                return out
            if close and self.is_(close):
                self.i += 1
                return out
            out.append(self.item(attributes))

    def visibility(self) -> bool:
        if not self.take("pub"):
            return False
        if self.is_("(") and self.peek().text in ("crate", "super", "self", "in"):
            self.group()
        return True

    def item(self, attributes: list[Attribute]) -> Item:
        public = self.visibility()
        begin = self.i
        words = set()
        while self.is_("async", "unsafe", "default", "const", "extern", "auto") and self.peek().text in ("fn", "async", "unsafe", "extern", "const", "impl", "trait", "auto") or (self.is_("extern") and self.peek().kind == "lit" and self.peek(2).text == "fn"):
            words.add(self.next().text)
            if self.now.kind == "lit":
                self.i += 1
        t = self.now
        if t.kind != "ident":
            raise SyntaxFault(f"line {t.start[0]}: an item expected, not {t.text!r}")
        made = lambda kind, name, at=None, **k: Item(kind, name, attributes, public, at or (t.start, t.end), **k)
        if t.text == "fn":
            return self.function(attributes, public, words, begin)
        if t.text == "mod":
            self.i += 1
            name = self.ident()
            if self.take(";"):
                return made("mod", name.text, (name.start, name.end))
            self.need("{")
            return made("mod", name.text, (name.start, name.end), items=self.items("}"), extra={"inline": True})
        if t.text == "use":
            self.i += 1
            self.take("::")
            tree = self.use_tree()
            self.need(";")
            return made("use", "", extra={"tree": tree})
        if t.text in ("impl", "trait"):
            self.i += 1
            head = self.run({"{", ";"}, angles=False)
            if self.take(";"):
                return made(t.text, render(head))
            self.need("{")
            return made(t.text, render(head), items=self.members())
        if t.text in ("struct", "enum", "union"):
            self.i += 1
            name = self.ident()
            self.run({"{", "(", ";"}, angles=False)
            if self.is_("{"):
                self.group()
            else:
                if self.is_("("):
                    self.group()
                    self.run({";"}, angles=False)
                self.need(";")
            return made(t.text, name.text)
        if t.text in ("const", "static"):
            self.i += 1
            self.take("mut")
            name = self.next()
            self.need(":")
            self.run({"=", ";"})
            value = self.expr() if self.take("=") else None
            self.need(";")
            return made("const", name.text, body=value)
        if t.text == "type":
            self.run({";"}, angles=False)
            self.need(";")
            return made("type", "")
        if t.text == "extern":
            self.i += 1
            if self.take("crate"):
                self.run({";"})
                self.need(";")
            else:
                if self.now.kind == "lit":
                    self.i += 1
                if not self.is_("{"):
                    raise SyntaxFault(f"line {self.now.start[0]}: a block expected")
                self.group()
            return made("extern", "")
        return self.macro_item(made)

    def macro_item(self, made) -> Item:
        while self.now.kind == "ident" or self.is_("::"):
            self.i += 1
        self.need("!")
        if self.now.kind == "ident":
            self.i += 1
        if self.now.kind != "open":
            raise SyntaxFault(f"line {self.now.start[0]}: a macro's body expected")
        brace = self.is_("{")
        self.group()
        if not brace:
            self.need(";")
        return made("macro", "")

    def use_tree(self) -> dict:
        if self.is_("{"):
            self.i += 1
            out = []
            while not self.take("}"):
                self.take("::")
                out.append(self.use_tree())
                if not self.take(","):
                    self.need("}")
                    break
            return {"kind": "group", "of": out}
        if self.take("*"):
            return {"kind": "glob"}
        name = self.ident().text
        if self.take("::"):
            return {"kind": "path", "name": name, "of": self.use_tree()}
        if self.take("as"):
            return {"kind": "rename", "name": name, "as": self.next().text}
        return {"kind": "name", "name": name}

    def members(self) -> list[Item]:
        out = []
        while True:
            attributes = [a for a in self.attributes(inner=True) if not a.inner]
            if self.take("}"):
                return out
            if self.now.kind == "end":
                raise SyntaxFault("'}' is missing")
            out.append(self.item(attributes))

    def function(self, attributes: list[Attribute], public: bool, words: set[str], begin: int) -> Item:
        self.need("fn")
        name = self.ident()
        generics: list[str] = []
        if self.is_("<"):
            generics = self.generics()
        if not self.is_("("):
            raise SyntaxFault(f"line {self.now.start[0]}: parameters expected")
        inside = self.group()
        params = _split(inside)
        returns = self.run({"{", ";", "where"}) if self.take("->") else None
        if self.is_("where"):
            self.run({"{", ";"}, angles=False)
        signature = render(self.tokens[begin : self.i])
        body = None
        if not self.take(";"):
            body = self.block()
        extra = {
            "is_async": "async" in words, "is_unsafe": "unsafe" in words, "generics": generics, "params": [render(p) for p in params], "returns": render(returns) if returns is not None else None, "signature": signature,
        }
        return Item("fn", name.text, attributes, public, (name.start, name.end), body=body, extra=extra)

    def generics(self) -> list[str]:
        depth, begin = 0, self.i + 1
        while True:
            t = self.next()
            depth += {"<": 1, ">": -1, ">>": -2}.get(t.text, 0) if t.kind == "punct" else 0
            if depth <= 0:
                return [render(p) for p in _split(self.tokens[begin : self.i - 1])]
            if t.kind == "end":
                raise SyntaxFault("'>' is missing")

    # -------------------------------------------------------------- statements
    def block(self) -> Node:
        start = self.need("{")
        begin = self.i
        out = []
        self.inner_attributes()
        while not self.is_("}"):
            if self.now.kind == "end":
                raise SyntaxFault("'}' is missing")
            if self.take(";"):
                continue
            out.append(self.statement())
        text = render(self.tokens[begin : self.i])
        end = self.next()
        return Node("Block", start.start, end.end, out, text=text)

    def statement(self) -> Node:
        attributes = self.attributes()
        t = self.now
        if self.is_("let"):
            self.i += 1
            pattern = self.run({"=", ":", ";"}, angles=False)
            if self.take(":"):
                self.run({"=", ";"})
            parts = []
            if self.take("="):
                parts.append(self.expr())
                if self.take("else"):
                    parts.append(self.block())
            end = self.need(";")
            return Node("Local", t.start, end.end, parts, text=render(pattern))
        if self.starts_item():
            item = self.item(attributes)
            return Node("Item", t.start, self.tokens[self.i - 1].end, [item])
        if self.macro_ahead():
            begin = self.i
            node = self.postfix(self.primary(True), blocklike=False) if not self.brace_macro() else self.primary(True)
            if node.kind == "Macro" and (self.take(";") or self.brace_end(begin)):
                return Node("MacroStmt", t.start, self.tokens[self.i - 1].end, [])
            if node.kind == "Macro" and self.is_("}"):
                return Node("Stmt", t.start, node.end, [node])
            node = self.binary_rest(self.postfix(node))
        else:
            node = self.expr(statement=True)
        if not self.take(";") and not self.is_("}") and node.kind not in _BLOCKLIKE:
            raise SyntaxFault(f"line {self.now.start[0]}: ';' expected, not {self.now.text!r}")
        return Node("Stmt", t.start, node.end, [node])

    def starts_item(self) -> bool:
        t, n = self.now, self.peek()
        if t.kind != "ident" or t.text not in _ITEM_WORDS:
            return False
        if t.text == "unsafe":
            return n.text in ("fn", "impl", "trait", "extern")
        if t.text == "async":
            return n.text in ("fn", "unsafe")
        if t.text == "const":
            return n.text not in ("{", "|", "||", "move")
        if t.text in ("union", "auto", "default"):
            return n.kind == "ident" and self.peek(2).text in ("{", "<", "trait", "fn")
        if t.text == "macro_rules":
            return n.text == "!"
        if t.text == "extern":
            return True
        return True

    def macro_ahead(self) -> bool:
        i = self.i
        if self.tokens[i].kind != "ident":
            return False
        while self.tokens[i].kind == "ident" and self.tokens[i + 1].text == "::":
            i += 2
        return self.tokens[i].kind == "ident" and self.tokens[i + 1].text == "!" and self.tokens[i + 2].kind == "open"

    def brace_macro(self) -> bool:
        i = self.i
        while self.tokens[i].text != "!":
            i += 1
        return self.tokens[i + 1].text == "{"

    def brace_end(self, begin: int) -> bool:
        return self.tokens[self.i - 1].text == "}" and not self.is_(".", "?")

    # -------------------------------------------------------------- expressions
    def expr(self, structs: bool = True, statement: bool = False, least: int = 0) -> Node:
        self.attributes()
        t = self.now
        if self.is_("..", "..="):
            self.i += 1
            parts = [] if self.at_end(structs) else [self.expr(structs, least=2)]
            return Node("Range", t.start, parts[0].end if parts else t.end, parts)
        left = self.unary(structs, statement)
        if statement and left.kind in _BLOCKLIKE and not self.is_(".", "?"):
            return left
        return self.binary_rest(left, structs, least)

    def at_end(self, structs: bool) -> bool:
        return self.now.kind in ("close", "end") or self.is_(",", ";", "=>") or (not structs and self.is_("{"))

    def binary_rest(self, left: Node, structs: bool = True, least: int = 0) -> Node:
        while True:
            t = self.now
            if t.kind == "ident" and t.text == "as":
                self.i += 1
                self.cast_type()
                left = Node("Cast", left.start, self.tokens[self.i - 1].end, [left])
                continue
            if t.kind != "punct":
                return left
            if t.text in _BINARY and _BINARY[t.text] >= max(least, 1):
                self.i += 1
                right = self.expr_operand(structs, _BINARY[t.text] + 1)
                left = Node("Binary", left.start, right.end, [left, right], name=t.text)
            elif t.text in ("..", "..=") and least <= 1:
                self.i += 1
                parts = [left] if self.at_end(structs) else [left, self.expr_operand(structs, 2)]
                left = Node("Range", left.start, parts[-1].end, parts)
            elif t.text in _ASSIGN and least <= 0:
                self.i += 1
                right = self.expr(structs)
                kind = "Assign" if t.text == "=" else "Binary"
                left = Node(kind, left.start, right.end, [left, right], name=t.text, at=(t.start, t.end))
            else:
                return left

    def expr_operand(self, structs: bool, least: int) -> Node:
        return self.binary_rest(self.unary(structs, False), structs, least)

    def cast_type(self) -> None:
        while self.is_("&", "&&", "*", "mut", "const", "dyn", "impl"):
            self.i += 1
        if self.now.kind == "open":
            self.group()
            return
        self.take("::")
        while self.now.kind == "ident":
            self.i += 1
            if self.is_("<"):
                self.generics()
            if not self.take("::"):
                return

    def unary(self, structs: bool, statement: bool) -> Node:
        t = self.now
        if self.is_("-", "!", "*"):
            self.i += 1
            inner = self.unary(structs, False)
            return Node("Unary", t.start, inner.end, [inner], name=t.text)
        if self.is_("&", "&&"):
            self.i += 1
            if self.is_("raw") and self.peek().text in ("const", "mut"):
                self.i += 1
            self.take("mut") or (self.is_("const") and self.peek().text != "{" and self.take("const"))
            inner = self.unary(structs, False)
            return Node("Reference", t.start, inner.end, [inner])
        node = self.primary(structs)
        if statement and node.kind in _BLOCKLIKE and not self.is_(".", "?"):
            return node
        return self.postfix(node)

    def postfix(self, node: Node, blocklike: bool = True) -> Node:
        while True:
            t = self.now
            if self.is_("?"):
                self.i += 1
                node = Node("Try", node.start, t.end, [node])
            elif self.is_("("):
                args = self.arguments()
                node = Node("Call", node.start, self.tokens[self.i - 1].end, [node, *args])
            elif self.is_("["):
                args = self.arguments("]")
                node = Node("Index", node.start, self.tokens[self.i - 1].end, [node, *args])
            elif self.is_("."):
                self.i += 1
                name = self.next()
                if name.text == "await":
                    node = Node("Await", node.start, name.end, [node])
                    continue
                if name.kind not in ("ident", "lit"):
                    raise SyntaxFault(f"line {name.start[0]}: a field or method expected, not {name.text!r}")
                if self.is_("::"):
                    self.i += 1
                    self.generics()
                if self.is_("(") and name.kind == "ident":
                    args = self.arguments()
                    node = Node("MethodCall", node.start, self.tokens[self.i - 1].end, [node, *args], name=name.text, at=(name.start, name.end))
                else:
                    node = Node("Field", node.start, name.end, [node], name=name.text)
            else:
                return node

    def arguments(self, close: str = ")") -> list[Node]:
        self.i += 1
        out = []
        while not self.take(close):
            out.append(self.expr())
            if not self.take(",") and not self.is_(close):
                raise SyntaxFault(f"line {self.now.start[0]}: ',' expected, not {self.now.text!r}")
        return out

    def primary(self, structs: bool) -> Node:
        t = self.now
        if t.kind == "lit":
            self.i += 1
            return Node("Lit", t.start, t.end, text=t.text)
        if t.kind == "life":
            self.i += 1
            self.need(":")
            node = self.primary(structs)
            node.start = t.start
            return node
        if t.text == "(":
            parts = self.arguments()
            return Node("Tuple", t.start, self.tokens[self.i - 1].end, parts)
        if t.text == "[":
            self.i += 1
            parts = []
            while not self.take("]"):
                parts.append(self.expr())
                if not (self.take(",") or self.take(";")) and not self.is_("]"):
                    raise SyntaxFault(f"line {self.now.start[0]}: ']' expected, not {self.now.text!r}")
            return Node("Array", t.start, self.tokens[self.i - 1].end, parts)
        if t.text == "{":
            block = self.block()
            return Node("Block", block.start, block.end, [block])
        bar = 0
        while self.peek(bar).kind == "ident" and self.peek(bar).text in ("move", "static", "async"):
            bar += 1
        if self.peek(bar).kind == "punct" and self.peek(bar).text in ("|", "||"):
            return self.closure(structs)
        if t.kind == "ident":
            word = t.text
            if word == "if":
                return self.if_(structs)
            if word == "match":
                return self.match()
            if word in ("loop", "unsafe", "async", "const") and (self.peek().text == "{" or self.peek(2).text == "{" and self.peek().text == "move"):
                self.i += 1
                self.take("move")
                block = self.block()
                return Node({"loop": "Loop", "unsafe": "Unsafe", "async": "Async", "const": "Block"}[word], t.start, block.end, [block], at=(t.start, t.end))
            if word == "while":
                self.i += 1
                condition = self.condition()
                block = self.block()
                return Node("While", t.start, block.end, [condition, block], at=(t.start, t.end))
            if word == "for" and self.peek().text != "<":
                self.i += 1
                self.run({"in"}, angles=False)
                self.need("in")
                over = self.expr(structs=False)
                block = self.block()
                return Node("For", t.start, block.end, [over, block], at=(t.start, t.end))
            if word in ("return", "break", "continue", "yield"):
                self.i += 1
                if word in ("break", "continue") and self.now.kind == "life":
                    self.i += 1
                parts = [] if self.at_end(structs) else [self.expr(structs)]
                return Node("Return" if word == "return" else "Jump", t.start, parts[0].end if parts else t.end, parts, at=(t.start, t.end))
            if word == "let":
                return self.condition()
            return self.path(structs)
        if t.text in ("<", "::"):
            return self.path(structs)
        if t.text == "_":
            self.i += 1
            return Node("Path", t.start, t.end, text="_")
        raise SyntaxFault(f"line {t.start[0]}: an expression expected, not {t.text!r}")

    def path(self, structs: bool) -> Node:
        begin, start = self.i, self.now.start
        if self.is_("<"):
            self.generics()
            self.need("::")
        self.take("::")
        names = []
        while True:
            if self.is_("<"):
                self.generics()
            else:
                names.append(self.ident().text)
            if not self.take("::"):
                break
        text, end = render(self.tokens[begin : self.i]), self.tokens[self.i - 1].end
        if self.is_("!") and self.peek().kind == "open":
            self.i += 1
            self.group()
            return Node("Macro", start, self.tokens[self.i - 1].end, name="::".join(names))
        if structs and self.is_("{") and self.struct_ahead():
            self.i += 1
            parts = []
            while not self.take("}"):
                self.attributes()
                if self.take(".."):
                    if not self.is_("}"):
                        parts.append(self.expr())
                    continue
                field_ = self.next()
                if self.take(":"):
                    parts.append(self.expr())
                else:
                    parts.append(Node("Path", field_.start, field_.end, text=field_.text, extra={"names": [field_.text]}))
                if not self.take(",") and not self.is_("}"):
                    raise SyntaxFault(f"line {self.now.start[0]}: ',' expected, not {self.now.text!r}")
            return Node("Struct", start, self.tokens[self.i - 1].end, parts)
        return Node("Path", start, end, text=text, extra={"names": names})

    def struct_ahead(self) -> bool:
        a, b = self.peek(), self.peek(2)
        return a.text == "}" or a.text == ".." or a.text == "#" or ((a.kind == "ident" or a.kind == "lit") and b.text in (":", ",", "}"))

    def condition(self) -> Node:
        """A condition, with `let` patterns as plain parts of && chains."""
        t = self.now
        if not self.is_("let"):
            left = self.expr(structs=False, least=3 if self.let_later() else 0)
        else:
            self.i += 1
            self.run({"="}, angles=False)
            self.need("=")
            value = self.expr_operand(False, 4)
            left = Node("Let", t.start, value.end, [value])
        while self.is_("&&"):
            self.i += 1
            right = self.condition_part()
            left = Node("Binary", left.start, right.end, [left, right], name="&&")
        return left

    def let_later(self) -> bool:
        depth = 0
        for t in self.tokens[self.i :]:
            if t.kind == "open":
                if t.text == "{" and not depth:
                    return False
                depth += 1
            depth -= t.kind == "close"
            if depth < 0 or t.kind == "end":
                return False
            if not depth and t.kind == "ident" and t.text == "let":
                return True
        return False

    def condition_part(self) -> Node:
        t = self.now
        if self.take("let"):
            self.run({"="}, angles=False)
            self.need("=")
            value = self.expr_operand(False, 4)
            return Node("Let", t.start, value.end, [value])
        return self.expr_operand(False, 4)

    def if_(self, structs: bool) -> Node:
        t = self.next()
        condition = self.condition()
        block = self.block()
        parts = [condition, block]
        if self.take("else"):
            if self.is_("if"):
                parts.append(self.if_(structs))
            else:
                other = self.block()
                parts.append(Node("Block", other.start, other.end, [other]))
        return Node("If", t.start, parts[-1].end, parts, at=(t.start, t.end))

    def match(self) -> Node:
        begin = self.i
        t = self.next()
        over = self.expr(structs=False)
        self.need("{")
        self.inner_attributes()
        arms = []
        while not self.is_("}"):
            self.attributes()
            self.take("|")
            first = self.now
            pattern = self.run({"=>", "if"}, angles=False)
            if not pattern:
                raise SyntaxFault(f"line {self.now.start[0]}: a pattern expected")
            guard = self.expr(structs=True) if self.take("if") and not self.is_("let") else (self.condition() if self.is_("let") else None)
            self.need("=>")
            body = self.expr(statement=self.is_("{"))
            arms.append(Node("Arm", first.start, pattern[-1].end, [body], extra={"guard": guard}))
            if not self.take(",") and not self.is_("}") and body.kind not in _BLOCKLIKE:
                raise SyntaxFault(f"line {self.now.start[0]}: ',' expected, not {self.now.text!r}")
        end = self.next()
        return Node("Match", t.start, end.end, [over, *arms], text=render(self.tokens[begin : self.i]), at=(t.start, t.end))

    def closure(self, structs: bool) -> Node:
        t = self.now
        while self.is_("move", "static", "async"):
            self.i += 1
        bar = self.now
        if not self.take("||"):
            self.need("|")
            self.run({"|"}, angles=False)
            self.need("|")
        if self.take("->"):
            self.run({"{"})
            block = self.block()
            body = Node("Block", block.start, block.end, [block])
        else:
            body = self.expr(structs)
        return Node("Closure", t.start, body.end, [body], at=(bar.start, (bar.start[0], bar.start[1] + 1)))


def _split(tokens: list[Token]) -> list[list[Token]]:
    """Token runs between the commas that lie outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "open" or (t.kind == "punct" and t.text == "<"):
            depth += 1
        elif t.kind == "close" or (t.kind == "punct" and t.text == ">"):
            depth -= 1
        elif t.kind == "punct" and t.text == ">>":
            depth -= 2
        if t.text == "," and depth <= 0 and t.kind == "punct":
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


#: Characters that no token but texts, raw texts and comments reaches past its beginning.
_AHEAD = 40


def _comment_end(text: str, at: int) -> int:
    """Past the comment that opens at `at`; -1 if it is not closed."""
    depth, i = 1, at + 2
    while depth:
        m = _COMMENT.search(text, i)
        if not m:
            return -1
        depth += 1 if m.group() == "/*" else -1
        i = m.end()
    return i


def cut_items(parts: Iterable[str], size: int) -> Iterator[tuple[int, str]]:
    """(line, text) of pieces of a source that comes in parts; each parses by itself and all together have the items of the source.

    A piece ends where the line of an item begins, outside all brackets, once
    it has `size` characters, so what is held is a part and the longest item.
    After a closing brace an item begins at a word, attribute or doc that
    nothing in an open item can go on with.  A piece with a fault in its
    tokens is the last one: it does not parse, nor does the source.
    """
    parts = iter(parts)
    text, line, at, stack = "", 1, 0, []
    last = faulty = False
    after = ""  # what ended an item, until the next token
    while not (last or faulty):
        part = next(parts, None)
        last = part is None
        text += part or ""
        begin, sure = 0, len(text) if last else len(text) - _AHEAD
        if line == 1 and at == 0 and text.startswith("#!") and not re.match(r"#!\s*\[", text):
            if (len(text) < _AHEAD or "\n" not in text) and not last:
                continue
            at = text.find("\n") if "\n" in text else len(text)
        while at < sure:
            if text.startswith("/*", at):
                if (end := _comment_end(text, at)) < 0:
                    break
                at = end
                continue
            m = _TOKEN.match(text, at)
            if not m:
                # A text that goes on, or a fault.
                faulty = text[at] != '"'
                break
            kind, word, end = m.lastgroup, m.group(), m.end()
            if end > sure or (not last and kind == "ident" and word in ("r", "br", "cr", "b", "c") and text[end] in "\"#'"):
                break
            if kind == "open":
                stack.append(_PAIRS[word])
            elif kind == "close" and (not stack or stack.pop() != word):
                faulty = True
                break
            if kind not in ("space", "comment"):
                if after and at - begin >= size and (kind == "doc" or (word == "#" and re.match(r"#\s*\[", text[at : at + _AHEAD])) or (kind == "ident" and (after == ";" or word in _ITEM_WORDS))):
                    cut = text.rfind("\n", begin, at) + 1
                    if cut and not text[cut:at].strip():
                        yield line, text[begin:cut]
                        line += text.count("\n", begin, cut)
                        begin = cut
                after = word if not stack and (word == "}" or word == ";") else ""
            at = end
        text, at = text[begin:], at - begin
    yield line, text


def parse(source: str, first: int = 1) -> tuple[list[Attribute], list[Item], str]:
    """(inner attributes, items, all tokens in one line) of a file, or of a piece of it that begins on line `first`, or SyntaxFault."""
    p = Parser(source, first)
    try:
        inner, items = p.file()
    except RecursionError as deep:
        raise SyntaxFault("nested too deep") from deep
    return inner, items, render([t for t in p.tokens if t.kind not in ("end", "doc", "inner_doc")])
