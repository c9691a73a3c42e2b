"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its words with A-Z in lower case.  Its k-mers
(K words in a row) are labelled by their occurrence number, so that repeats
count.  For each of SKETCHES random orders the ELL least labelled k-mers are
taken and kept in text order; their hash is one bucket key.  Unlike plain
MinHash, documents whose k-mers agree but stand in another order fall apart.

Short texts have too few k-mers for that, so those of at most SHORT words are
also cut into one piece more than the edits that their length allows.  One
piece stays whole in any text within that distance, at a place that bounds
tell, so pairs of which one text has under SHORT words and the other
at most `longest_short` share a bucket for certain.

Documents with equal word sequences share one node, named by a digest of the
sequence, so that nothing depends on where a row is read.  In each bucket every
node is first a candidate with the bucket's least node, which is linear in the
bucket however large it is and links most of what is alike.  A candidate pair is verified by an exact
edit distance over words in a band of the greatest allowed distance; pairs
that a lower bound from word histograms rules out need no text.  A histogram
has as many bins as its text has words, so the bound is as sharp for long texts.  Pairs inside
one component that is already linked are redundant, so the best candidate of
each node is verified first and only the pairs that still join two components
follow.

A bucket that still holds several components is then compared as a whole, one
of more than BLOCK nodes in bands of length and blocks of a bounded size, so
that of any two nodes of a bucket either both are linked or their distance is
known to be too great.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow
from . import scratch, words

K = 5
ELL = 2
SKETCHES = 64
#: Texts of at most so many words have so many more sets of SKETCHES: of few k-mers, chance takes more.
FEW_WORDS = {50: 2, 150: 1}
SIMILARITY = 0.8
#: Least and most bins of a word histogram.
HISTOGRAM, HISTOGRAM_MAX = 128, 4096
#: Texts of fewer words find all that is similar to them, however few k-mers are left.
SHORT = 30
#: Nodes of a block of a bucket (16 MB of histograms at most); every two blocks of a bucket are one piece of work.
BLOCK = 4096

_U = np.uint64
_FACTORS = words.mix(np.arange(1, 4097, dtype=_U) * _U(0x9E6C63D0876A9A47)) | _U(1)


def labelled_kmers(found: words.Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of the k-mer and its occurrence number) in text order; a shorter text is one k-mer."""
    many = np.diff(found.ptr)
    n = np.where(many >= k, many - k + 1, np.minimum(many, 1))
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + found.ptr[row]
    prefix = words.prefix_hashes(found.hash)
    kmer = words.range_hash(prefix, start, np.minimum(start + k, found.ptr[row + 1]))
    placed = words.mix(kmer + row.astype(_U) * _U(0xD1342543DE82EF95))
    order = np.argsort(placed, kind="stable")
    ranked = placed[order]
    head = np.ones(len(row), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(row))
    nth = np.empty(len(row), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    return row, words.mix(kmer + nth.astype(_U) * _U(0xDA942042E4DD58B5))


def sketches(row: np.ndarray, labelled: np.ndarray, rows: int, n: int = SKETCHES, ell: int = ELL, first_order: int = 0) -> np.ndarray:
    """rows x n bucket keys: for each order the ell least labelled k-mers, hashed in text order; a row without k-mers has zeros."""
    keys = np.zeros((rows, n), _U)
    if not len(row):
        return keys
    head = np.flatnonzero(np.diff(row, prepend=-1))
    own = row[head]
    sizes = np.diff(np.append(head, len(row)))
    group = np.repeat(np.arange(len(head)), sizes)
    top = _U(2**64 - 1)
    for j in range(first_order, first_order + n):
        value = labelled * _FACTORS[j]
        value ^= value >> _U(29)
        picks = []
        for _ in range(ell):
            least = np.minimum.reduceat(value, head)
            spot = np.flatnonzero(value == least[group])
            first = spot[np.diff(group[spot], prepend=-1) != 0]
            picks.append(np.where(least == top, len(row), first))
            value[first] = top
        places = np.sort(np.stack(picks), axis=0)
        key = np.full(len(head), _U(j + 1) * _U(0xF1357AEA2E62A9C5 >> 8), _U)
        padded = np.append(labelled, _U(0))
        for p in places:
            key = words.mix(key * _U(0xAEF17502108EF2D9) + padded[p])
        keys[own, j - first_order] = key
    return keys


def all_sketches(found: words.Words, k: int, n: int, ell: int) -> list[np.ndarray]:
    """The bucket keys of each row: n, and more for a text of few words."""
    row, labelled = labelled_kmers(found, k)
    many = np.diff(found.ptr)
    keys = list(sketches(row, labelled, len(many), n, ell))
    extra = np.select([many <= m for m in FEW_WORDS], list(FEW_WORDS.values()), 0) * (many > 0)
    for turn in range(1, extra.max(initial=0) + 1):
        few = np.flatnonzero(extra >= turn)
        place = np.full(len(many), -1)
        place[few] = np.arange(len(few))
        some = place[row] >= 0
        for r, more in zip(few, sketches(place[row[some]], labelled[some], len(few), n, ell, n * turn)):
            keys[r] = np.concatenate([keys[r], more])
    return keys


def longest_short(similarity: float) -> int:
    """The most words of a text that can be similar to one of fewer than SHORT words."""
    n = SHORT - 1
    while n + 1 - allowed(n + 1, similarity) < SHORT:
        n += 1
    return n


def piece_template(m: int, similarity: float) -> np.ndarray:
    """(n, piece, start, length) of what a text of m words shows of the pieces of texts of n >= m words.

    A text of n words allows d edits and has d + 1 pieces.  The first piece i up to whose end there are at
    most i edits has none, i edits before it and at most d - i after it, which bounds how far it has moved.
    """
    rows = []
    for n in range(m, longest_short(similarity) + 1):
        d = allowed(n, similarity)
        if not d or n - m > d:
            continue
        cuts = [n * i // (d + 1) for i in range(d + 2)]
        for i, (p, end) in enumerate(zip(cuts, cuts[1:])):
            for at in range(max(0, p - i, p + m - n - (d - i)), min(m - (end - p), p + i, p + m - n + (d - i)) + 1):
                rows.append((n, i, at, end - p))
    return np.array(rows, np.int64).reshape(-1, 4)


def piece_keys(found: words.Words, similarity: float) -> list[np.ndarray]:
    """The bucket keys of the pieces of each row; a row too long has none."""
    many, longest = np.diff(found.ptr), longest_short(similarity)
    prefix = words.prefix_hashes(found.hash)
    templates = {int(m): piece_template(int(m), similarity) for m in np.unique(many[many <= longest]) if m}
    keys = []
    for first, m in zip(found.ptr[:-1], many.tolist()):
        t = templates.get(m)
        if t is None or not len(t):
            keys.append(np.zeros(0, _U))
            continue
        start = first + t[:, 2]
        name = words.mix((t[:, 0] * 1024 + t[:, 1] + 1).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        keys.append(np.unique(words.mix(words.range_hash(prefix, start, start + t[:, 3]) + name)))
    return keys


def histograms(found: words.Words) -> pa.Array:
    """How often each row's words fall into each bin, 255 at most: one byte for each of a power of two of bins, not under the number of words."""
    n = np.clip(np.diff(found.ptr), HISTOGRAM, HISTOGRAM_MAX)
    bins = np.left_shift(1, np.ceil(np.log2(n)).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bins)])
    row = found.row
    counts = np.bincount(ends[row] + (found.hash >> _U(40)).astype(np.int64) % bins[row], minlength=ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.minimum(counts, 255).astype(np.uint8))])


def folded(held: pa.Array, bins: int) -> np.ndarray:
    """Histograms of `bins` bins or more as a matrix of just `bins`; counts stay at 255 at most, which moves none by more than before."""
    sizes = pc.binary_length(held).to_numpy(zero_copy_only=False)
    out = np.zeros((len(held), bins), np.uint8)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        some = np.frombuffer(b"".join(held.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), size // bins, bins)
        out[at] = some[:, 0] if size == bins else np.minimum(some.sum(1, dtype=np.uint32), 255)
    return out


def least_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of each row's texts: what the greater histogram does not share with the other."""
    total = lambda h: h.sum(1, dtype=np.int64)
    return np.maximum(total(x), total(y)) - total(np.minimum(x, y))


def _sketch(k: int, n: int, ell: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("text")
            for lo, hi in words.slices(column):
                part = column.slice(lo, hi - lo)
                found = words.scan(part, words.WHITE, words.FOLD)
                keys = all_sketches(found, k, n, ell)
                n_words = np.diff(found.ptr)
                digests = np.frombuffer(b"".join(found.digests(found.ptr[:-1], found.ptr[1:])), np.int64).reshape(-1, 2)
                pieces = piece_keys(found, similarity)
                ends = np.cumsum([0] + [len(x) + len(p) for x, p in zip(keys, pieces)])
                flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.signed(np.concatenate([x for row_keys in zip(keys, pieces) for x in row_keys]))))
                numbers = pa.array(np.arange(base, base + hi - lo))
                base += hi - lo
                yield pa.record_batch(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tid")), numbers, pa.array(n_words), pa.array(digests[:, 0]), pa.array(digests[:, 1]), histograms(found), flat],
                    ["doc_id", "tid", "nth", "n_words", "node", "check", "histogram", "keys"],
                )

    return run


def alignment_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two symbol sequences, or limit + 1 if it is greater.

    Bit-parallel over a band: only cells within `limit` of the diagonal exist,
    as bits of two integers that slide down one row with each column.
    """
    if len(a) > len(b):
        a, b = b, a
    same = a == b[: len(a)]
    lead = len(a) if same.all() else int(np.argmin(same))
    a, b = a[lead:], b[lead:]
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        trail = len(a) if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - trail], b[: len(b) - trail]
    m, n = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    limit = min(limit, n)
    width = 2 * limit + 1
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    # Before column j, bit r of plus and minus tells whether cell (j - limit + r, j - 1) is one more
    # or one less than the cell above it; rows up to 0 are all equal.
    plus, minus = full & ~((1 << limit) - 1), 0
    score = limit  # value at the band's lowest cell, row j + limit
    low = 1 << (width - 1)
    for j, y in enumerate(b.tolist(), 1):
        eq = where.get(y, 0)
        shift = j - limit - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        across_plus = (minus | ~(diag | plus)) & full
        across_minus = diag & plus
        score += 0 if diag & low else 1
        down = diag >> 1
        plus = (across_minus | ~(down | across_plus)) & full
        minus = down & across_plus
    # Rows beyond m never match, so the lowest cell lies (n + limit - m) rows below cell (m, n).
    for r in range(width - 2, width - 2 - (n + limit - m), -1):
        score -= (plus >> r) & 1
        score += (minus >> r) & 1
    return min(score, limit + 1)


def allowed(longest: int, similarity: float) -> int:
    """The greatest distance at which 1 - distance / longest is still `similarity`."""
    return int(np.floor((1 - similarity) * longest + 1e-9))


def _plausible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.minimum(*(pc.binary_length(batch.column(c)).to_numpy() for c in ("hx", "hy")))
            least = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(bins):
                for at in np.array_split(rows := np.flatnonzero(bins == n), len(rows) // 4096 + 1):
                    least[at] = least_distance(*(folded(batch.column(c).take(pa.array(at)), int(n)) for c in ("hx", "hy")))
            longest = np.maximum(batch.column("nx").to_numpy(), batch.column("ny").to_numpy())
            ok = least <= np.floor((1 - similarity) * longest + 1e-9)
            yield pa.record_batch([batch.column(c) for c in ("x", "y", "hits")], ["x", "y", "hits"]).filter(pa.array(ok))

    return run


def _across(similarity: float):
    """(x, y, hits) of the pairs of two components in each run of equal (key, band, p, q) that length and histogram allow."""

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, n_words, own, mult = (t.column(c).to_numpy() for c in ("node", "comp", "n_words", "own", "mult"))
        histogram = t.column("histogram").combine_chunks()
        size = pc.binary_length(histogram).to_numpy()
        edges = _run_starts(t)
        found, held = [], 0

        def batch() -> pa.RecordBatch:
            x, y, hits = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            return pa.record_batch([pa.array(x), pa.array(y), pa.array(hits)], ["x", "y", "hits"])

        for lo, hi in zip(edges, np.append(edges[1:], t.num_rows)):
            p, q = t.column("p")[lo].as_py(), t.column("q")[lo].as_py()
            left, right = (lo + np.flatnonzero(own[lo:hi] == c) for c in (p, q))
            # Within a block nothing of its largest component meets its like.
            kinds, many = np.unique(comp[left], return_counts=True)
            main = kinds[many.argmax()] if p == q and len(kinds) else None
            left = left if main is None else left[comp[left] != main]
            bins = {}  # where each row stands in a matrix of so many bins
            for at in range(0, len(left), max(1, 65536 // max(len(right), 1))):
                some = left[at : at + max(1, 65536 // max(len(right), 1))]
                a, b = np.repeat(some, len(right)), np.tile(right, len(some))
                ok = comp[a] != comp[b]
                if p == q:
                    ok &= (b > a) | (comp[b] == main)
                a, b = a[ok], b[ok]
                limit = np.floor((1 - similarity) * np.maximum(n_words[a], n_words[b]) + 1e-9)
                ok = np.abs(n_words[a] - n_words[b]) <= limit
                a, b, limit = a[ok], b[ok], limit[ok]
                fewer = np.minimum(size[a], size[b])
                for n in np.unique(fewer).tolist():
                    if n not in bins:
                        rows = lo + np.flatnonzero(size[lo:hi] >= n)
                        place = np.zeros(hi - lo, np.int64)
                        place[rows - lo] = np.arange(len(rows))
                        bins[n] = place, folded(histogram.take(pa.array(rows)), n)
                    place, matrix = bins[n]
                    of = np.flatnonzero(fewer == n)
                    for chunk in np.array_split(of, len(of) * n // (1 << 22) + 1):
                        i, j = a[chunk], b[chunk]
                        near = least_distance(matrix[place[i - lo]], matrix[place[j - lo]]) <= limit[chunk]
                        found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), mult[i]])[:, near])
                        held += found[-1].shape[1]
                if held > 100_000:
                    yield batch()
                    found, held = [], 0
        yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            last = int(_run_starts(t)[-1])
            if last:
                yield from pairs_of(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from pairs_of(held)

    return run


def _run_starts(t: pa.Table) -> np.ndarray:
    """Where the rows of another (key, band, p, q) begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("key", "band", "p", "q"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _uncompared(members: DataFrame, known: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """x, y, hits of the plausible pairs of members (key, node) of one bucket that comps does not link, as a written table.

    A bucket whose nodes are all linked has nothing to compare, and of groups
    of the same nodes one is compared for all.  A bucket of at most BLOCK nodes
    is one group and each of its nodes is dealt once.  In a larger one nodes go
    to bands of length, of which two near nodes share one, and bands are cut
    into blocks, those of the largest component apart, as it has nothing to
    compare within.
    """
    info = known.join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").select("node", "n_words", "histogram", F.coalesce("comp", "node").alias("comp"))
    light = members.join(info.select("node", "comp", "n_words"), "node")
    name = lambda n: F.xxhash64("node", F.lit(n))
    by_comp = light.groupBy("key", "comp").agg(F.count("*").alias("n"), *[F.bit_xor(name(i)).alias(f"s{i}") for i in (0, 1)])
    parted = by_comp.groupBy("key").agg(F.count("*").alias("n_comps"), F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in ("s0", "s1")]).filter("n_comps > 1")
    parted = scratch.written(parted.select("key", "n", "s0", "s1"), "parted")
    small = parted.filter(F.col("n") <= BLOCK).groupBy("n", "s0", "s1").agg(F.min("key").alias("g_key"), F.count("*").alias("mult"))
    small = scratch.written(small.select("g_key", "mult"), "groups")
    whole, _ = scratch.split_by_ids(light, small.withColumnRenamed("g_key", "key"), "key")
    zero = F.lit(0).cast("bigint")
    dealt = whole.join(small, F.col("key") == F.col("g_key")).select("key", zero.alias("band"), zero.alias("p"), zero.alias("q"), zero.alias("own"), "mult", "node")
    large = parted.filter(F.col("n") > BLOCK).select("key")
    if not large.isEmpty():
        some, _ = scratch.split_by_ids(light, large, "key")
        dealt = dealt.unionByName(_in_blocks(some.join(large, "key", "left_semi"), similarity))
    runs = dealt.join(info, "node").repartition("key", "band", "p", "q").sortWithinPartitions("key", "band", "p", "q")
    long = T.LongType()
    met = map_arrow(runs, _across(similarity), T.StructType([T.StructField(c, long) for c in ("x", "y", "hits")]))
    return scratch.written(met.groupBy("x", "y").agg(F.sum("hits").alias("hits")), "uncompared")


def _in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """key, band, p, q, own, mult, node: (key, node, comp, n_words) of large buckets dealt to pairs (p, q) of blocks of bands of length."""
    width = max(-math.log(similarity), 1e-6) * (1 + 1e-9)
    light = members.withColumn("b", F.floor(F.log("n_words") / width))
    light = light.select("key", "node", "comp", "b", F.explode(F.array("b", F.col("b") + 1)).alias("band"))
    own = F.col("b") == F.col("band")
    name = lambda n: F.xxhash64("node", F.lit(n))
    by_comp = light.groupBy("key", "band", "comp").agg(
        F.count("*").alias("n"), F.count_if(own).alias("n_own"), *[F.bit_xor(name(i)).alias(f"s{i}") for i in (0, 1)], *[F.bit_xor(F.when(own, name(i))).alias(f"o{i}") for i in (0, 1)]
    )
    # Pairs of the band below are met there; nodes of that band whose component is that of all nodes of this band meet nobody here.
    here = F.col("n_own") > 0
    groups = by_comp.groupBy("key", "band").agg(
        F.count("*").alias("n_comps"), F.count_if(here).alias("n_here"), F.max(F.when(here, F.col("comp"))).alias("lone"),
        *[F.struct(F.sum(n).alias("n"), F.bit_xor(s0).alias("s0"), F.bit_xor(s1).alias("s1"), F.max(F.struct(n.alias("n"), "comp")).alias("main")).alias(c) for c, n, s0, s1 in (
            ("whole", F.col("n"), F.col("s0"), F.col("s1")),
            ("less", F.when(here, F.col("n_own")).otherwise(F.col("n")), F.when(here, F.col("o0")).otherwise(F.col("s0")), F.when(here, F.col("o1")).otherwise(F.col("s1"))),
        )],
    )
    groups = groups.filter("n_comps > 1 and n_here > 0").select("key", "band", F.when(F.col("n_here") == 1, F.col("lone")).alias("lone"), F.when(F.col("n_here") == 1, F.col("less")).otherwise(F.col("whole")).alias("g"))
    groups = groups.groupBy("g", "lone").agg(F.min(F.struct("key", "band")).alias("at"), F.count("*").alias("mult"))
    groups = scratch.written(groups.select("at.key", "at.band", "lone", "g.n", F.col("g.main.n").alias("n_main"), F.col("g.main.comp").alias("main"), "mult"), "groups")
    # Nodes of a group's largest component are linked: they meet the blocks of the others, never their own.
    others, mains = F.ceil((F.col("n") - F.col("n_main")) / BLOCK), F.ceil(F.col("n_main") / BLOCK)
    inside = F.col("comp") == F.col("main")
    place = F.xxhash64("node", F.lit(2))
    of = groups.withColumnsRenamed({"key": "g_key", "band": "g_band"})
    met = (F.col("key") == F.col("g_key")) & (F.col("band") == F.col("g_band")) & (own | F.col("lone").isNull() | (F.col("comp") != F.col("lone")))
    dealt = light.join(of, met).withColumn("own", F.when(inside, others + F.pmod(place, mains)).otherwise(F.pmod(place, others)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(inside, others - 1).otherwise(others + mains - 1))))
    return dealt.select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "mult", "node")


def _align(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in words.slices(batch.column("text_x")):
                x, y = (words.scan(batch.column(c).slice(lo, hi - lo), words.WHITE, words.FOLD) for c in ("text_x", "text_y"))
                names_x, names_y = words.codes(x, y)
                n_names = 1 + max(names_x.max(initial=-1), names_y.max(initial=-1))
                for r in range(hi - lo):
                    a, b = names_x[x.ptr[r] : x.ptr[r + 1]], names_y[y.ptr[r] : y.ptr[r + 1]]
                    limit = allowed(max(len(a), len(b)), similarity)
                    # Words that the other text lacks are edits wherever they stand, and told far sooner.
                    shared = np.minimum(np.bincount(a, minlength=n_names), np.bincount(b, minlength=n_names)).sum()
                    ok[lo + r] = max(len(a), len(b)) - shared <= limit and alignment_distance(a, b, limit) <= limit
            yield pa.record_batch([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(ok))

    return run


def _row_key():
    """A hash of doc_id and text: what finds a row again without its text."""
    return F.xxhash64("doc_id", "tid")


def _texts(pairs: DataFrame, sources: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the nodes in pairs, as a written table; only rows that may be wanted are shuffled."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    maybe, _ = scratch.split_by_ids(sources, wanted, "node")
    chosen = scratch.written(maybe.select("node", F.col("doc_id").alias("c_id"), F.col("tid").alias("c_tid"), _row_key().alias("row_key")), "chosen")
    some, _ = scratch.split_by_ids(docs.withColumn("row_key", _row_key()), chosen, "row_key")
    once = some.repartition("row_key").dropDuplicates(["row_key", "doc_id", "tid"])
    found = once.join(chosen, "row_key").filter(F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tid") == F.col("c_tid")))
    return scratch.written(found.select("node", "text"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of nodes whose texts align, as a written table."""
    left = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")), "x")
    both = left.join(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y").select("x", "y", "text_x", "text_y")
    return scratch.written(map_arrow(both, _align(similarity), pairs.select("x", "y").schema), "links")


def _best(pairs: DataFrame) -> DataFrame:
    """x, y of the likeliest pair of each node."""
    ends = pairs.select("x", "y", "hits", F.explode(F.array("x", "y")).alias("node"))
    return ends.groupBy("node").agg(F.max_by(F.struct("x", "y"), F.struct("hits", -F.col("x"), -F.col("y"))).alias("p")).select("p.x", "p.y").distinct()


def _parted(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """x, y of the pairs whose ends (id, comp) does not put together."""
    at = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias("c" + c))
    both = pairs.join(at("x"), "x", "left").join(at("y"), "y", "left")
    return both.filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")


def _components(links: DataFrame) -> DataFrame:
    """(id, comp) as a written table."""
    return scratch.written(scratch.connected_components(links.select(F.col("x").alias("src"), F.col("y").alias("dst")), "classes"), "comps")


def _hubs(links: DataFrame) -> DataFrame:
    """(id, comp) as a written table: the least of an end and what links join to it, which puts together only what is linked, in one pass."""
    ends = links.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("to")), F.struct(F.col("y").alias("id"), F.col("x").alias("to")))).alias("e"))
    return scratch.written(ends.groupBy("e.id").agg(F.min("e.to").alias("to")).select("id", F.least("id", "to").alias("comp")), "hubs")


def _joined(comps: DataFrame, links: DataFrame, joined_by: Callable[[DataFrame], DataFrame] = _components) -> DataFrame:
    """comps after more links, as joined_by puts them together: only what the links join is looked at again."""
    if links.isEmpty():
        return comps
    at = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias("c" + c))
    ends = links.join(at("x"), "x", "left").join(at("y"), "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    over = joined_by(ends.distinct()).select(F.col("id").alias("o_id"), F.col("comp").alias("o_comp"))
    moved = comps.join(over, F.col("comp") == F.col("o_id"), "left").select("id", F.coalesce("o_comp", "comp").alias("comp"))
    fresh = over.join(comps.select(F.col("comp").alias("o_id")).distinct(), "o_id", "left_anti").select(F.col("o_id").alias("id"), F.col("o_comp").alias("comp"))
    return scratch.written(moved.unionByName(fresh), "comps")


def _settled(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketched with a node for each word sequence, and (node, first, n) of the nodes of several rows.

    Nodes are halves of 128-bit digests.  Where two sequences share a half,
    all but one of them are named anew.
    """
    draw = 0
    while True:
        draw += 1
        groups = sketched.filter("n_words > 0").groupBy("node").agg(F.min("nth").alias("first"), F.count("*").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        same = scratch.written(groups.filter("n > 1"), "same")
        clash = same.filter("c0 < c1").select(F.col("node").alias("k_node"), "c0")
        if clash.isEmpty():
            return sketched, same.select(F.col("node").alias("s_node"), "first", "n")
        some, others = scratch.split_by_ids(sketched, clash.withColumnRenamed("k_node", "node"), "node")
        moved = some.join(clash, F.col("node") == F.col("k_node"), "left")
        moved = moved.withColumn("node", F.when(F.col("check") != F.col("c0"), F.xxhash64("node", "check", F.lit(draw))).otherwise(F.col("node")))
        sketched = scratch.written(others.unionByName(moved.select(*sketched.columns)), "sketches")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, n_sketches: int = SKETCHES, ell: int = ELL) -> DataFrame:
    """doc_id, tid, class_id, n_class, is_kept of every row of docs.

    class_id is the least doc_id of the component that links documents of
    edit similarity 1 - distance / longer length >= `similarity` over words;
    n_class counts its rows and is_kept marks one row of each class, the one
    with the least doc_id (of equal ids the least text hash; equal rows keep
    one).  A text without words, null included, is a class of its own.  A null
    doc_id takes part, sorts last and is kept only if no other row is there.
    An empty table gives no rows.
    """
    rows = scratch.keyed(docs)
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *(T.StructField(c, long) for c in ("tid", "nth", "n_words", "node", "check")),
            T.StructField("histogram", T.BinaryType()),
            T.StructField("keys", T.ArrayType(long)),
        ]
    )
    sketched = scratch.written(map_arrow(rows, _sketch(k, n_sketches, ell, similarity), schema), "sketches")
    sketched, same = _settled(sketched)
    # Rows with one word sequence are one node; all but their first row leave here.
    maybe, alone = scratch.split_by_ids(sketched.filter("n_words > 0"), same.select(F.col("s_node").alias("node")), "node")
    firsts = maybe.join(same.select("s_node", "first"), F.col("node") == F.col("s_node"), "left").filter("first is null or nth = first")
    reps = alone.unionByName(firsts.select(*alone.columns))

    buckets = reps.select("node", F.explode("keys").alias("key"))
    ends = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    ends = scratch.written(ends, "ends")
    met = buckets.join(ends, "key").select("node", F.col("lo").alias("other")).filter("node <> other")
    pairs = scratch.written(
        met.groupBy(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).agg(F.count("*").alias("hits")), "pairs"
    )
    # What is known of each node without its text rules out most pairs that only share a passage.
    known, _ = scratch.split_by_ids(reps.select("node", "n_words", "histogram"), pairs.select(F.explode(F.array("x", "y")).alias("node")), "node")
    side = lambda c: known.select(F.col("node").alias(c), F.col("n_words").alias("n" + c), F.col("histogram").alias("h" + c))
    sized = pairs.join(side("x"), "x").join(side("y"), "y").filter((1 - similarity) * F.greatest("nx", "ny") + 1e-9 >= F.abs(F.col("nx") - F.col("ny")))
    pairs = scratch.written(map_arrow(sized.select("x", "y", "hits", "nx", "ny", "hx", "hy"), _plausible(similarity), pairs.schema), "plausible")
    texts = _texts(pairs, reps.select("node", "doc_id", "tid"), rows)

    # The likeliest partner of each node first; what that links needs no other check.
    best = scratch.written(_best(pairs), "best")
    links = _verified(best, texts, similarity)
    rest = _parted(pairs.join(best, ["x", "y"], "left_anti"), _hubs(links))
    links = links.unionByName(_verified(scratch.written(rest, "rest"), texts, similarity))
    comps = _components(links)

    # Buckets of three nodes or more have pairs without the least node.
    crowded = ends.filter("n > 2")
    inner, _ = scratch.split_by_ids(buckets, crowded, "key")
    inner = scratch.written(inner.join(crowded, "key").filter("node <> lo").select("key", "node"), "inner")
    left = _uncompared(inner, known, comps, similarity).join(pairs, ["x", "y"], "left_anti")
    left = scratch.written(left, "left")
    if not left.isEmpty():
        texts = _texts(left, reps.select("node", "doc_id", "tid"), rows)
        best = scratch.written(_best(left), "best")
        links = _verified(best, texts, similarity)
        rest = _parted(left.join(best, ["x", "y"], "left_anti"), _joined(comps, links, _hubs))
        comps = _joined(comps, links.unionByName(_verified(scratch.written(rest, "rest"), texts, similarity)))

    # A text without words is alone; aggregates are written before they are joined, so that AQE can split a large class.
    slim = sketched.select("doc_id", "tid", "nth", "node", F.when(F.col("n_words") == 0, F.col("nth")).otherwise(-1).alias("lone"))
    slim = slim.join(comps, F.col("node") == F.col("id"), "left")
    named = scratch.written(slim.select("doc_id", "tid", "nth", "lone", F.coalesce("comp", "node").alias("comp")), "named")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tid", "nth")
    classes = scratch.written(named.groupBy("comp", "lone").agg(F.min(order).alias("first"), F.count("*").alias("n_class")), "class-sizes")
    return named.join(classes, ["comp", "lone"]).select(
        "doc_id", "tid", F.col("first.doc_id").alias("class_id"), "n_class", (F.col("nth") == F.col("first.nth")).alias("is_kept")
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; only rows that may go are joined."""
    judged = near_duplicates(docs, **options).groupBy("doc_id", "tid").agg(F.max("is_kept").alias("kept"), F.count("*").alias("n"))
    judged = scratch.written(judged.filter("not kept or n > 1").select(F.col("doc_id").alias("j_id"), F.col("tid").alias("j_tid"), "kept"), "judged")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), scratch.text_id().alias("r_tid"))
    some, others = scratch.split_by_ids(rows, judged.select(F.col("j_tid").alias("r_tid")), "r_tid")
    gone = judged.filter("not kept")
    left = some.join(gone, F.col("r_id").eqNullSafe(F.col("j_id")) & (F.col("r_tid") == F.col("j_tid")), "left_anti").dropDuplicates(["r_id", "r_tid"])
    return left.select("row.*").unionByName(others.select("row.*"))
