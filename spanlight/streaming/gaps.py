"""Gaps kept up as findings change: state for each file, and a row whenever a gap opens or closes (A-2, J-1, G-6).

Findings arrive as changes: a point or an existing instrumentation appears at a
line or goes.  The state of a file holds its points and how often each line has
an instrumentation, so a change touches the lines next to it alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.ship import ship
from ..sources.tables import new_folder, setting

CHANGES = "file string, seq bigint, what string, line int, name string, added boolean"
EVENTS = "file string, seq bigint, line int, name string, opened boolean"


#: What a file's state holds: instrumentation by line, and points by line and name, with how often each is there.
STATE = "lines array<int>, counts array<int>, at array<int>, names array<string>, times array<int>"


class Findings:
    """The findings of one file while its changes are worked off: existing by line, points by line and name."""

    def __init__(self, held: tuple | None = None):
        lines, counts, at, names, times = held or ((),) * 5
        self.existing: dict[int, int] = dict(zip(lines, counts))
        self.points: dict[int, dict[str, int]] = {}
        for line, name, n in zip(at, names, times):
            self.points.setdefault(line, {})[name] = n

    def held(self) -> tuple:
        points = [(line, name, n) for line, names in self.points.items() for name, n in names.items()]
        return list(self.existing), list(self.existing.values()), [p[0] for p in points], [p[1] for p in points], [p[2] for p in points]

    def _covered(self, line: int) -> bool:
        """Whether an instrumentation lies within a line of a point; no line is before 0."""
        return line in self.existing or line + 1 in self.existing or (line > 0 and line - 1 in self.existing)

    def point(self, line: int, name: str, added: bool) -> list[tuple[int, str, bool]]:
        names = self.points.setdefault(line, {})
        before = names.get(name, 0)
        after = max(before + (1 if added else -1), 0)
        if after:
            names[name] = after
        else:
            names.pop(name, None)
            if not names:
                del self.points[line]
        return [] if (before > 0) == (after > 0) or self._covered(line) else [(line, name, after > 0)]

    def instrumented(self, line: int, added: bool) -> list[tuple[int, str, bool]]:
        before = self.existing.get(line, 0)
        after = max(before + (1 if added else -1), 0)
        if (before > 0) == (after > 0):
            if after:
                self.existing[line] = after
            return []
        near = [x for x in range(max(line - 1, 0), line + 2) if x in self.points]
        was = [self._covered(x) for x in near]
        if after:
            self.existing[line] = after
        else:
            del self.existing[line]
        return [(x, name, covered) for x, covered in zip(near, was) if covered != self._covered(x) for name in sorted(self.points[x])]


class GapKeeper(StatefulProcessor):
    """Keyed by file; rows of CHANGES give rows (file, seq, line, name, opened).

    A file's findings are one value, read and written once a micro-batch: each
    call to the store is a round trip, which costs more than many changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("findings", STATE)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        from pyspark.sql import Row

        file, before = key[0], self.state.get()
        found, out = Findings(before), Row("file", "seq", "line", "name", "opened")
        for _, seq, what, line, name, added in sorted(rows, key=itemgetter(1)):
            for x, n, opened in found.point(line, name, added) if what == "point" else found.instrumented(line, added):
                yield out(file, seq, x, n, opened)
        after = found.held()
        if after[0] or after[2]:
            self.state.update(after)
        elif before is not None:
            self.state.clear()

    def close(self) -> None:
        pass


def gap_events(changes: DataFrame) -> DataFrame:
    """A stream of EVENTS from a stream of CHANGES.

    Changes of a file count in the order of seq within a micro-batch, and of
    batches as they come.  A point that is added twice is there until it is
    taken away twice; what is taken away without being there changes nothing.
    """
    ship(changes.sparkSession)
    # Rows are taken apart by place.
    changes = changes.select(*[c.split()[0] for c in CHANGES.split(", ")])
    return changes.groupBy("file").transformWithState(statefulProcessor=GapKeeper(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def drained(events: DataFrame, name: str = "gap-events") -> DataFrame:
    """All that a stream gives from what is there now, as a table; it stops then."""
    spark = events.sparkSession
    out, marks = new_folder(spark, name), new_folder(spark, name + "-marks")
    # Typed state needs this store.
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def open_gaps(events: DataFrame) -> DataFrame:
    """file, line, name of the gaps that are open after all events."""
    last = events.groupBy("file", "line", "name").agg(F.sum(F.when(F.col("opened"), 1).otherwise(-1)).alias("n"))
    return last.filter("n > 0").select("file", "line", "name")
