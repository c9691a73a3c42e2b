"""Detectors from outside, as a table function over the lines of files (V-1, V-5 to V-7, W-6).

A detector is a class named `module:Class` that tasks can import.  It says what
columns it gives, sees the lines of one file after the other, in order, and
gives rows; what it keeps between lines is its own.  The table function asks
the class for its columns before a query runs, so each detector has its own.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.ship import ship


class LineDetector:
    """What a detector answers; one object for each file."""

    #: Its columns, besides file.
    columns = StructType([StructField("line", IntegerType())])

    def see(self, line: int, raw: str) -> Iterator[tuple]:
        """Rows that a line gives."""
        return iter(())

    def close(self) -> Iterator[tuple]:
        """Rows that the end of a file gives."""
        return iter(())


def load(name: str) -> type[LineDetector]:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


@udtf
class DetectorTable:
    """TABLE(lines) partitioned by file and ordered by line, and a detector's name, to the detector's rows."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, detector: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or {"file", "line", "raw"} - set(lines.dataType.fieldNames()):
            raise ValueError("the first argument is a table of file, line and raw")
        if not isinstance(detector.value, str):
            raise ValueError("the second argument is a detector's name, as module:Class")
        return AnalyzeResult(schema=StructType([StructField("file", StringType()), *load(detector.value).columns]))

    def __init__(self):
        self.own = self.file = None

    def eval(self, row, detector: str):
        if self.own is None:
            self.own, self.file = load(detector)(), row["file"]
        for found in self.own.see(row["line"], row["raw"]):
            yield self.file, *found

    def terminate(self):
        if self.own is not None:
            for found in self.own.close():
                yield self.file, *found


def detect(lines: DataFrame, detector: str) -> DataFrame:
    """file and the detector's columns, from lines (file, line, raw); null files and lines are left out."""
    ship(lines.sparkSession)
    rows = lines.select("file", "line", "raw").filter("file is not null and line is not null")
    return DetectorTable(rows.asTable().partitionBy("file").orderBy("line"), F.lit(detector))


_HEAD = re.compile(r"\b(mod|fn)\s+([A-Za-z_][A-Za-z0-9_]*)")
_TOKEN = re.compile(r"""(?P<line>//.*)|(?P<open>/\*)|r(?P<hash>\#*)"|(?P<text>b?")|(?P<char>'(?:\\.[^']*|[^\\'])')|(?P<head>\b(?:mod|fn)\s+[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[{};])""")


class Contexts(LineDetector):
    """The modules and the function that a line lies in, headers counting for their own line (W-6).

    Braces are followed through strings, raw strings, characters and nested
    comments, which may go on over lines.  What is kept is the stack of open
    braces, however long a file is.
    """

    columns = StructType([StructField("line", IntegerType()), StructField("module_path", ArrayType(StringType())), StructField("function", StringType()), StructField("depth", IntegerType())])

    def __init__(self):
        self.stack: list[tuple[str, str] | None] = []
        self.head: tuple[str, str] | None = None
        self.until: str | None = None  # the end of a string that goes on
        self.comments = 0

    def see(self, line: int, raw: str) -> Iterator[tuple]:
        before = list(self.stack)
        opened = list(self._pass(raw))
        named = next((s for s in [*before, *opened][::-1] if s and s[0] == "fn"), None) if opened else next((s for s in before[::-1] if s and s[0] == "fn"), None)
        modules = [s[1] for s in before if s and s[0] == "mod"] + [s[1] for s in opened if s[0] == "mod"]
        yield line, modules, named and named[1], len(before)

    def _pass(self, raw: str) -> Iterator[tuple[str, str]]:
        """Follow a line; the modules and functions whose braces open in it."""
        at = 0
        while at < len(raw):
            if self.comments:
                m = re.compile(r"/\*|\*/").search(raw, at)
                if not m:
                    return
                self.comments += 1 if m[0] == "/*" else -1
                at = m.end()
            elif self.until is not None:
                m = re.compile(re.escape(self.until) if self.until != '"' else r'\\.|"').search(raw, at)
                if not m:
                    return
                at = m.end()
                if m[0] == self.until:
                    self.until = None
            else:
                m = _TOKEN.search(raw, at)
                if not m or m["line"]:
                    return
                at = m.end()
                if m["open"]:
                    self.comments = 1
                elif m["hash"] is not None:
                    self.until = '"' + m["hash"]
                elif m["text"]:
                    self.until = '"'
                elif m["head"]:
                    self.head = _HEAD.match(m["head"]).groups()
                elif m["mark"] == "{":
                    self.stack.append(self.head)
                    if self.head:
                        yield self.head
                    self.head = None
                elif m["mark"] == "}":
                    if self.stack:
                        self.stack.pop()
                elif m["mark"] == ";":
                    self.head = None
