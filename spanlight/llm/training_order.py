"""Token ids in training order: a keyed Feistel permutation of all sequences.

Documents are tokenised once into sequences of `length` ids, which are dealt to
ranges of a hash of document and position.  The rank of a sequence in that
order, its range's start plus its place within, is a dense number in
0 .. N - 1 that follows from the data alone.  A Feistel network keyed by the
seed permutes the smallest even number of bits that holds N; numbers that land
at N or above walk on until they fall below, so every sequence gets its own
slot of a gapless range without sorting by slot or any table.  Slots are dealt to
shards of SHARD_SEQUENCES in ranges and sorted within, so that shard s holds
slots s * SHARD_SEQUENCES onwards at a fixed stride and a reader resumes at
any slot by arithmetic.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow
from . import scratch, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
LENGTH = 512
SHARD_SEQUENCES = 4096
#: Shards of a task at most: what one task sorts and writes stays within 128 MB at 512 ids.
SHARDS_A_TASK = 32
ROUNDS = 6
#: White space that the tokenizer's own pattern can't pass in one piece.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_U = np.uint64
_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once for each Python process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("spanlight", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode(tokenizer, text: str) -> list[int]:
    """The ids of a text.

    A run of white space is cut off before its last character, where the
    pattern cuts it as well, and is one piece of its own; the pattern would
    overflow its stack on a long one.  What is not valid Unicode is replaced.
    """
    text = text.encode("utf-8", "replace").decode("utf-8")
    out, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += tokenizer.encode_ordinary(text[at : m.start()])
        out += tokenizer._encode_single_piece(text[m.start() : end])
        at = end
    return out + tokenizer.encode_ordinary(text[at:])


def feistel(number: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n - 1, chosen by seed, applied to an array of numbers."""
    half = _U(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = _U((1 << int(half)) - 1)
    keys = words.mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (words.mix(right ^ k) & mask)
        return (left << half) | right

    x = once(number.astype(_U))
    outside = np.flatnonzero(x >= _U(n))
    while len(outside):
        x[outside] = once(x[outside])
        outside = outside[x[outside] >= _U(n)]
    return x.astype(np.int64)


def _tokenise(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path)
        try:
            for batch in batches:
                column = batch.column("text")
                for lo, hi in words.slices(column, 1 << 22):
                    rows, no, n, ids = [], [], [], []
                    for r, text in enumerate(column.slice(lo, hi - lo).to_pylist(), lo):
                        if text is None:
                            continue
                        own = np.array([*encode(tokenizer, text), end], np.uint16)
                        for k in range(0, len(own), length):
                            piece = own[k : k + length]
                            rows.append(r)
                            no.append(k // length)
                            n.append(len(piece))
                            ids.append(piece.tobytes())
                    yield pa.record_batch(
                        [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "tid")), pa.array(no, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())],
                        ["doc_id", "tid", "seq", "n_tokens", "ids"],
                    )
        finally:
            _encodings.clear()  # some 100 MB that an idle worker would keep

    return run


def _place(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(batch.column("number").to_numpy(), n, seed)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "seq", "n_tokens", "ids")), pa.array(slot)], ["doc_id", "seq", "n_tokens", "ids", "slot"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with nth, their place within their part; the rows of a part follow each other."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        at = np.arange(len(part))
        head = np.ones(len(part), bool)
        head[1:] = part[1:] != part[:-1]
        nth = at - np.maximum.accumulate(np.where(head, at, 0))
        if part[0] == last:
            nth[part == last] += held
        last, held = part[-1], int(nth[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(nth)], [*batch.schema.names, "nth"])


def numbered(sequences: DataFrame) -> tuple[DataFrame, int]:
    """sequences with number, the rank by a hash of doc_id, text and seq; and how many there are.

    Hashes are dealt evenly to ranges by their upper bits.  Only the ranges'
    counts, one number for each shuffle partition, are summed in one place.
    """
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64("doc_id", "tid", "seq")
    part = F.least((F.shiftrightunsigned(place, 33) * parts / (1 << 31)).cast("int"), F.lit(parts - 1))
    order = ["place", "doc_id", "tid", "seq"]
    dealt = sequences.withColumns({"place": place, "part": part}).repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order)
    dealt = scratch.written(map_arrow(dealt.drop("place"), _count, T.StructType([*sequences.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])), "sequences")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = scratch.written(counts.select(F.col("part").alias("b_part"), base.alias("base"), "n"), "sequence-bases")
    n = bases.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # One row for each shuffle partition is broadcast.
    out = dealt.join(F.broadcast(bases.drop("n")), F.col("part") == F.col("b_part"))
    return out.select(*sequences.columns, (F.col("base") + F.col("nth")).alias("number")), n


def training_order(docs: DataFrame, seed: int = 17, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, vocabulary: str = VOCABULARY, end: int = END_OF_TEXT) -> DataFrame:
    """slot, shard, shard_row, doc_id, seq, n_tokens, ids of every sequence, in slot order within partitions.

    A text's tokens and one `end` are cut into sequences of `length`; ids holds
    little-endian 16-bit ids, padded with `end` to the fixed stride 2 * length;
    n_tokens counts those before the padding, the closing `end` included.
    Slots are 0 .. N - 1, each once, and follow from seed and data however the
    input is partitioned; of equal rows each gets its own.  A null text gives
    no sequence, an empty one a sequence of `end` alone; an empty table gives
    no rows.
    """
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    fields = [id_field, T.StructField("seq", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    cut = map_arrow(scratch.keyed(docs), _tokenise(vocabulary, length, end), T.StructType([fields[0], T.StructField("tid", T.LongType()), *fields[1:]]))
    sequences, n = numbered(cut)
    placed = map_arrow(sequences, _place(n, seed), T.StructType([*fields, T.StructField("slot", T.LongType())]))
    shards = max(1, -(-n // shard_sequences))
    parts = max(-(-shards // SHARDS_A_TASK), min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_sequences).cast("bigint"))
    ranged = placed.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    pad = F.unhex(F.lit(end.to_bytes(2, "little").hex() * length))
    stride = 2 * length
    return ranged.select(
        "slot", "shard", (F.col("slot") - F.col("shard") * shard_sequences).cast("int").alias("shard_row"), "doc_id", "seq", "n_tokens",
        F.substring(F.concat("ids", pad), 1, stride).alias("ids"),
    )


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder: a URI of any store that Arrow knows, or a local path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        shard, rows, first, out, temporary = None, 0, 0, None, ""

        def close():
            out.close()
            store.move(temporary, f"{base}/shard-{shard:08d}.bin")
            return pa.record_batch([pa.array([shard]), pa.array([first]), pa.array([rows])], ["shard", "first_slot", "rows"])

        for batch in batches:
            for slot, s, ids in zip(batch.column("slot").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                if s != shard:
                    if out:
                        yield close()
                    shard, rows, first = s, 0, slot
                    temporary = f"{base}/.{s:08d}-{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(temporary)
                if len(ids) != stride or slot != first + rows:
                    raise ValueError(f"slot {slot} is out of place")
                out.write(ids)
                rows += 1
        if out:
            yield close()

    return run


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Write training_order's rows as `shard-<number>.bin` files; shard, first_slot, rows of each.

    folder is a path that every executor mounts or a URI of a store.  A file
    appears under its name only when it is whole, so a retried task just
    writes it again.
    """
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    rows = ordered.select("slot", "shard", "ids")
    return scratch.written(map_arrow(rows, _write(folder, 2 * length), "shard bigint, first_slot bigint, rows bigint"), "shards")


def read_slots(folder: str, start: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The sequences from slot `start` on, in order, read by seeking."""
    store, base = _store(folder)
    shard, row = divmod(start, shard_sequences)
    while store.get_file_info(path := f"{base}/shard-{shard:08d}.bin").type == fs.FileType.File:
        with store.open_input_file(path) as f:
            f.seek(row * 2 * length)
            while piece := f.read(2 * length):
                yield np.frombuffer(piece, np.uint16)
        shard, row = shard + 1, 0
