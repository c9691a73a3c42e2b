"""Sources written back in tasks, with backups (K-7, K-8).

A file is written beside itself and then moved into place, so no reader sees
half of it; a file that has its new text already is left alone, so a task that
runs again changes nothing and never takes a new text for the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..functions.ship import map_arrow

WRITTEN = "file string, n_bytes bigint, is_changed boolean, has_backup boolean"
SUFFIX = ".bak"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URL, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _held(store: fs.FileSystem, path: str) -> bytes | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return f.read()


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".new") as f:
        f.write(content)
    store.move(path + ".new", path)


def _writer(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _store(file)
                content, before = source.encode("utf-8"), _held(store, path)
                if before != content:
                    if keep and before is not None:
                        _put(store, path + SUFFIX, before)
                    _put(store, path, content)
                rows.append((file, len(content), before != content, _held(store, path + SUFFIX) is not None))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[c.split()[0] for c in WRITTEN.split(", ")])

    return run


def _restorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column(0).to_pylist()
        done = []
        for file in files:
            store, path = _store(file)
            before = _held(store, path + SUFFIX)
            if before is not None:
                _put(store, path, before)
                store.delete_file(path + SUFFIX)
            done.append(before is not None)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(done, pa.bool_())], names=["file", "is_restored"])


def rewrite_files(sources: DataFrame, keep: bool = False) -> DataFrame:
    """Write each source (file, source) to its file; file, n_bytes, is_changed, has_backup, once it is evaluated.

    keep puts the text before beside the file, under SUFFIX.  Rows with a null
    file or source are left out; a file should have one row.  Files lie where
    all executors reach them.
    """
    rows = sources.select("file", "source").filter("file is not null and source is not null")
    return map_arrow(rows, _writer(keep), WRITTEN)


def restore_files(files: DataFrame) -> DataFrame:
    """Put the backups of files back and remove them; file, is_restored, once it is evaluated."""
    return map_arrow(files.select("file").filter("file is not null"), _restorer, "file string, is_restored boolean")
