"""Trees of files that are walked and read in tasks, so neither a listing nor a large file is in one place (F-1, F-4, F-8).

Folders of a level are listed by tasks and go on as rows.  Files lie where all
executors reach them, in a store that Arrow knows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_EXCLUDES
from ..functions.ship import map_arrow
from .rewrite import _store
from .tables import Growing

BLOCK = 1 << 20
#: Bytes of texts after which a batch of rows is handed on.
BATCH = 2 << 20


def known(path: str) -> bool:
    """Whether Arrow has the store of a path; what it hasn't is read by Spark alone."""
    try:
        _store(path)
        return True
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False


def batched(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 100) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some BATCH bytes, a row's bytes being its size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def blocks(path: str) -> Iterator[bytes]:
    store, at = _store(path)
    with store.open_input_stream(at, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def text_of(path: str) -> Iterator[str]:
    """The text of a file in pieces; what is not UTF-8 is an error."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for block in blocks(path):
            yield decoder.decode(block)
        yield decoder.decode(b"", final=True)
    except UnicodeDecodeError as broken:
        raise ValueError(f"{path} is no UTF-8: {broken.reason}") from broken


# ---------------------------------------------------------------- listing


def _passed_over(name: str) -> bool:
    """Names that Spark's file index leaves out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _lister(exclude: list[str], suffix: str):
    def found(folder: str) -> Iterator[tuple[str, bool]]:
        store, at = _store(folder)
        head = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        for x in store.get_file_info(fs.FileSelector(at)):
            path, is_folder = head + x.path, x.type == fs.FileType.Directory
            if not _passed_over(x.base_name) and not any(w in path for w in exclude) and (is_folder or (x.size and path.endswith(suffix))):
                yield path, is_folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for folder in each_file(batches) for row in found(folder))
        return batched(rows, pa.schema([("file", pa.string()), ("is_folder", pa.bool_())]))

    return run


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def list_files(spark: SparkSession, paths: list[str], exclude: list[str] | None = None, suffix: str = ".rs") -> DataFrame:
    """file of every source below each path, as `files.scan_files` finds them (F-1).

    A level of folders is listed in tasks and is the next round's input; what
    lies below an excluded text is not looked at.  The names in one folder are
    held by one task.
    """
    exclude = DEFAULT_EXCLUDES if exclude is None else exclude
    given = [re.sub("^file:(//)?", "", p) for p in paths]
    found = Growing(spark, "file string, is_folder boolean", "tree")
    front = spark.createDataFrame([(p,) for p in given if not p.endswith(suffix)], "file string")
    while True:
        rows, told = found.add(map_arrow(dealt(front), _lister(exclude, suffix), "file string, is_folder boolean"), n=F.count_if("is_folder"))
        if not told["n"]:
            break
        front = rows.filter("is_folder").select("file")
    single = spark.createDataFrame([(p,) for p in given if p.endswith(suffix)], "file string")
    return found.all().filter("not is_folder").select("file").unionByName(single)


# ---------------------------------------------------------------- reading


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashed(path: str) -> tuple[str, str]:
        digest = hashlib.sha256()
        for text in text_of(path):
            digest.update(text.encode("utf-8"))
        return path, digest.hexdigest()

    return batched(map(hashed, each_file(batches)), pa.schema([("file", pa.string()), ("content_hash", pa.string())]), lambda row: 200)


def hash_files(files: DataFrame) -> DataFrame:
    """file, content_hash: SHA-256 of the text of files of any size, of which a task holds a block (F-4)."""
    return map_arrow(dealt(files.select("file")), _hasher, "file string, content_hash string")
