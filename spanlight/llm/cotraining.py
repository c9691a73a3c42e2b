"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic models look at one document through different columns: the text
model at hashed words and coarse shares of its characters, the metadata model
at source, language and length only.  For each target (low quality, toxic)
they are fitted on a bounded sample of labelled rows.  Then, round by round,
each view labels every document outside the sample, in one pass over the
corpus, and what it is confident of teaches the other view: the pass returns
sums by feature (documents, positives, gradient and curvature of the loss at
the weights at hand), whose number does not depend on the corpus, and the next
fit adds that quadratic to the labelled rows' own loss.  Both views are
calibrated on held-out labelled rows, combined on others, and the combined
model scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import map_arrow
from . import scratch, words

#: Bounds of the labelled sample, in rows and in text features; rows of least hashed id are taken.
LABELLED_MAX, FEATURES_MAX = 12_000, 8_000_000
#: What all pseudo-labels weigh together at most, as a share of the labelled rows.
TAUGHT_SHARE = 0.3
MIN_ROWS = 5
ROUNDS = 3
CONFIDENT = 0.97
REJECT_AT = 0.5
WORD_BITS, META_BITS = 20, 12
TARGETS = ("low_quality", "toxic")
#: Standard errors by which a feature's rate must differ to be used: junk shows in shares, toxicity in single words.
EVIDENCE = {"low_quality": 6.0, "toxic": 3.0}

_EDGES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85])
_SHARES = 6  # symbols, upper case, digits, bars, distinct words, repeated neighbours
_U = np.uint64
_CLASS = np.zeros((4, 256), bool)
_CLASS[0, [ord(c) for c in "#*$%&<>!@^~\\{}"]] = True
_CLASS[1, 0x41:0x5B] = True
_CLASS[2, 0x30:0x3A] = True
_CLASS[3, ord("|")] = True


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(indices, ptr): the binary text features of each row, a CSR matrix of ones."""
    rows = len(column)
    found = words.scan(column, words.NOT_ALNUM, words.FOLD)
    data, offsets = words.raw(column)
    size = np.maximum(np.diff(offsets), 1)
    shares = np.zeros((rows, _SHARES))
    for i, members in enumerate(_CLASS):
        total = np.concatenate([[0], np.cumsum(members[data])])
        shares[:, i] = np.diff(total[offsets]) / size
    row = found.row
    many = np.maximum(np.diff(found.ptr), 1)
    index = (found.hash >> _U(64 - WORD_BITS)).astype(np.int64)
    distinct = np.unique(row * (1 << WORD_BITS) + index)
    d_row = distinct >> WORD_BITS
    shares[:, 4] = 1 - np.bincount(d_row, minlength=rows) / many
    same = np.flatnonzero((found.hash[1:] == found.hash[:-1]) & (row[1:] == row[:-1])) if len(row) else np.zeros(0, int)
    shares[:, 5] = np.bincount(row[same], minlength=rows) / many
    bins = np.searchsorted(_EDGES, shares) + np.arange(_SHARES) * (len(_EDGES) + 1) + (1 << WORD_BITS)
    all_row = np.concatenate([d_row, np.repeat(np.arange(rows), _SHARES)])
    all_index = np.concatenate([distinct & ((1 << WORD_BITS) - 1), bins.ravel()])
    order = np.lexsort((all_index, all_row))
    return all_index[order], np.concatenate([[0], np.cumsum(np.bincount(all_row, minlength=rows))])


TEXT_SIZE = (1 << WORD_BITS) + _SHARES * (len(_EDGES) + 1)
META_SIZE = 1 << META_BITS


def meta_features(columns: list[pa.Array], length: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for the metadata view: each column, all columns together, and the length's power of two."""
    values = [[str(x) for x in c.to_pylist()] for c in columns]
    out = []
    sizes = [int(x or 0).bit_length() for x in length.to_pylist()]
    for r, n in enumerate(sizes):
        own = [v[r] for v in values]
        keys = [f"{i}={x}" for i, x in enumerate(own)] + ["all=" + "\x00".join(own), f"size={n}"]
        out.append(sorted({zlib.crc32(k.encode("utf-8", "surrogatepass")) % META_SIZE for k in keys}))
    return np.array([x for o in out for x in o], np.int64), np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)


def _sums(weights: np.ndarray, index: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[index])])
    return total[ptr[1:]] - total[ptr[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """A CSR matrix of ones with row selection."""

    def __init__(self, index: np.ndarray, ptr: np.ndarray):
        self.index, self.ptr = index, ptr

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.ptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - self.ptr[rows], sizes)
        return Rows(self.index[at], ptr)


class Linear:
    """Weights of the features in use, and a bias."""

    def __init__(self, size: int, features: np.ndarray, weights: np.ndarray, bias: float):
        self.size, self.features, self.weights, self.bias = size, features, weights, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, x: Rows) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(self.size)
            self._dense[self.features] = self.weights
        return _sums(self._dense, x.index, x.ptr) + self.bias


_FIXED = 1 << 20  # gradients are summed as whole numbers, so that no order of additions matters


class Taught:
    """What the other view's confident labels say about one view, by feature; the last feature is the bias."""

    def __init__(self, features: np.ndarray, sums: np.ndarray, before: Linear):
        self.features, self.before = features, before
        self.n, self.positive, self.error, self.curve = sums.astype(float)

    def weight(self, rows: int) -> float:
        return min(1.0, TAUGHT_SHARE * rows / max(self.n[-1], 1.0))


def fit_logistic(x: Rows, y: np.ndarray, size: int, evidence: float, taught: Taught | None = None, steps: int = 150, rate: float = 0.5, ridge: float = 0.3) -> Linear:
    """Logistic regression by Adagrad on the whole sample, and on the quadratic of what was taught.

    A feature is left out if fewer than MIN_ROWS rows have it or if its share
    of positive rows is less than `evidence` standard errors from the overall
    one.
    """
    rows = np.bincount(x.index, minlength=size)
    seen, positive, total, true = rows.astype(float), np.bincount(x.index, weights=np.repeat(y, np.diff(x.ptr)), minlength=size), float(len(y)), float(y.sum())
    if taught is not None:
        scale = taught.weight(len(y))
        seen[taught.features] += scale * taught.n[:-1]
        positive[taught.features] += scale * taught.positive[:-1]
        total, true = total + scale * taught.n[-1], true + scale * taught.positive[-1]
    share = true / max(total, 1e-9)
    z = np.abs(positive - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    use = (rows >= MIN_ROWS) & (z > evidence)
    features = np.flatnonzero(use)
    keep = use[x.index]
    ptr = np.concatenate([[0], np.cumsum(keep)])[x.ptr]
    index = np.searchsorted(features, x.index[keep])
    w, n = np.zeros(len(features)), len(features)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    slope, curve, start = (np.zeros(size + 1) for _ in range(3))
    if taught is not None:
        spots = np.append(taught.features, size)
        slope[spots], curve[spots] = scale * taught.error / _FIXED, scale * taught.curve / 4
        start[taught.before.features], start[size] = taught.before.weights, taught.before.bias
    spots = np.append(features, size)
    slope, curve, start = slope[spots], curve[spots], start[spots]
    g2, gb2 = np.full(n, 1e-8), 1e-8
    counts = np.diff(ptr)
    for _ in range(steps):
        error = _sigmoid(_sums(w, index, ptr) + bias) - y
        g = np.bincount(index, weights=np.repeat(error, counts), minlength=n)[:n] + ridge * w + slope[:-1] + curve[:-1] * (w - start[:-1])
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = error.sum() + slope[-1] + curve[-1] * (bias - start[-1])
        gb2 += gb * gb
        bias -= rate * gb / np.sqrt(gb2)
    return Linear(size, features, w, bias)


def score(model: Linear, x: Rows) -> np.ndarray:
    return model.score(x)


def fit_dense(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a few dense columns and a bias, drawn to `prior`."""
    x = np.column_stack([x, np.ones(len(y))])
    w = prior.astype(float).copy()
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * (w - prior))
        w -= np.clip(step, -2, 2)
    return w


def teach(views: list[Rows], fitted: dict, features: list[np.ndarray], confident: float = CONFIDENT) -> list[np.ndarray]:
    """For each view the sums (documents, positives, error, curvature) by feature, and for the bias, over the rows the other view is sure of."""
    out = [np.zeros((4, len(f) + 1), np.int64) for f in features]
    if "constant" in fitted:
        return out
    raw = [m.score(v) for m, v in zip(fitted["models"], views)]
    for taught, other in ((0, 1), (1, 0)):
        c = fitted["calibrations"][other]
        p = _sigmoid(c[0] * raw[other] + c[1])
        rows = np.flatnonzero((p >= confident) | (p <= 1 - confident))
        if not len(rows):
            continue
        label = (p[rows] >= 0.5).astype(np.int64)
        error = np.round((_sigmoid(raw[taught][rows]) - label) * _FIXED).astype(np.int64)
        x = views[taught].take(rows)
        own = features[taught]
        spot = np.minimum(np.searchsorted(own, x.index), max(len(own) - 1, 0))
        held = own[spot] == x.index if len(own) else np.zeros(len(x.index), bool)
        many = np.diff(np.concatenate([[0], np.cumsum(held)])[x.ptr])
        values = np.stack([np.ones_like(label), label, error, many + 1])
        spot, of = spot[held], np.repeat(np.arange(len(rows)), np.diff(x.ptr))[held]
        for total, v in zip(out[taught], values):
            total[:-1] += np.bincount(spot, weights=v[of], minlength=len(own)).astype(np.int64)[: len(own)]
            total[-1] += v.sum()
    return out


def known_features(views: list[Rows], sizes: list[int], train: np.ndarray) -> list[np.ndarray]:
    """The features that MIN_ROWS training rows have: all that a model can weigh."""
    return [np.flatnonzero(np.bincount(v.take(train).index, minlength=s) >= MIN_ROWS) for v, s in zip(views, sizes)]


def co_train(views: list[Rows], sizes: list[int], targets: list[np.ndarray], hold: np.ndarray, passed: Callable, rounds: int = ROUNDS, evidence: list[float] = (3.0,)) -> list[dict]:
    """Models, calibrations and the combination for each target; targets and hold are over labelled rows.

    passed(fitted, features) returns `teach` of all other documents, for each
    target.  Of the rows held out one half calibrates and the other combines.
    """
    train, held = np.flatnonzero(hold == 0), [np.flatnonzero(hold == i) for i in (1, 2)]
    features = known_features(views, sizes, train)
    taught: list[list[Taught | None]] = [[None] * len(views)] * len(targets)
    fitted: list[dict] = []
    for k in range(rounds):
        fitted = []
        for y, given, proof in zip(targets, taught, evidence):
            if not len(train) or not all(map(len, held)) or y[train].min() == y[train].max():
                fitted.append({"constant": float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0})
                continue
            models = [fit_logistic(v.take(train), y[train], s, proof, t) for v, s, t in zip(views, sizes, given)]
            calibrations = [fit_dense(score(m, v.take(held[0]))[:, None], y[held[0]], np.array([1.0, 0.0])) for m, v in zip(models, views)]
            fitted.append({"models": models, "calibrations": calibrations})
        if k + 1 < rounds and any("models" in f for f in fitted):
            sums = passed(fitted, features)
            taught = [[Taught(x, t, m) for x, t, m in zip(features, told, f["models"])] if "models" in f else given for told, f, given in zip(sums, fitted, taught)]
    for y, f in zip(targets, fitted):
        if "models" in f:
            scores = np.column_stack([c[0] * score(m, v.take(held[1])) + c[1] for m, c, v in zip(f["models"], f["calibrations"], views)])
            f["combined"] = fit_dense(scores, y[held[1]], np.array([1.0, 0.3, 0.0]))
    return fitted


def probability(fitted: dict, views: list[Rows]) -> np.ndarray:
    n = len(views[0].ptr) - 1
    if "constant" in fitted:
        return np.full(n, fitted["constant"])
    z = np.full(n, fitted["combined"][-1])
    for m, c, v, w in zip(fitted["models"], fitted["calibrations"], views, fitted["combined"]):
        z += w * (c[0] * score(m, v) + c[1])
    return np.round(_sigmoid(z), 9)


def _views(batch: pa.RecordBatch, lo: int, hi: int) -> list[Rows]:
    cut = lambda c: batch.column(c).slice(lo, hi - lo)
    return [Rows(*text_features(cut("text"))), Rows(*meta_features([cut("source"), cut("lang")], pc.utf8_length(cut("text"))))]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in words.slices(batch.column("text")):
            packed = [[v.index[a:b].astype(np.int32).tobytes() for a, b in zip(v.ptr[:-1], v.ptr[1:])] for v in _views(batch, lo, hi)]
            yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tid")), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "tid", "text_view", "meta_view"])


def _teach(fitted: list[dict], features: list[np.ndarray]):
    """(target, view, feature, and the four sums) of a task; feature counts places in `features`, the last is the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros((4, len(f) + 1), np.int64) for f in features] for _ in fitted]
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                views = _views(batch, lo, hi)
                for sums, f in zip(total, fitted):
                    for t, own in zip(sums, teach(views, f, features)):
                        t += own
        for t, sums in enumerate(total):
            for v, own in enumerate(sums):
                some = np.flatnonzero(own[0])
                fixed = [pa.array(np.full(len(some), x, np.int32)) for x in (t, v)]
                yield pa.record_batch([*fixed, pa.array(some), *(pa.array(x[some]) for x in own)], ["target", "view", "feature", *_SUMS])

    return run


_SUMS = ["n", "positive", "error", "curve"]


def _score(fitted: list[dict], reject_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                views = _views(batch, lo, hi)
                p = [probability(f, views) for f in fitted]
                kept = (p[0] < reject_at) & (p[1] < reject_at)
                yield pa.record_batch([batch.column("row").slice(lo, hi - lo), *(pa.array(x) for x in p), pa.array(kept)], ["row", *(f"p_{t}" for t in TARGETS), "kept"])

    return run


def _unpack(column: pa.ChunkedArray) -> Rows:
    """The matrix whose rows are packed 32-bit indices, without a copy of them."""
    held = column.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    if not len(held):
        return Rows(np.zeros(0, np.int32), np.zeros(1, np.int64))
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(held.buffers()[2], np.int32)
    return Rows(data[offsets[0] // 4 : offsets[-1] // 4], (offsets - offsets[0]) // 4)


def _inputs(docs: DataFrame) -> DataFrame:
    """text, source and lang as strings; a column that the table lacks is null."""
    has = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", scratch.text_id(has("text")).alias("tid"), *[has(c).alias(c) for c in ("text", "source", "lang")])


def fit(docs: DataFrame, labels: DataFrame, labelled_max: int = LABELLED_MAX, features_max: int = FEATURES_MAX, rounds: int = ROUNDS) -> list[dict]:
    """The fitted targets, from a sample of labelled rows and all other documents."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") == 0).cast("double").alias("low_quality"), F.coalesce((F.max("toxic") == 1).cast("double"), F.lit(0.0)).alias("toxic")
    )
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = scratch.written(known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_max), "sample")
    # labelled_max rows at most are broadcast.
    sample = _inputs(docs).drop("row").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("tid", T.LongType()), T.StructField("text_view", T.BinaryType()), T.StructField("meta_view", T.BinaryType())])
    drawn = map_arrow(sample, _features, schema)
    # Of rows with one doc_id the one of the least text hash is fitted on.
    first = drawn.groupBy("doc_id").agg(F.min(F.struct("tid", "meta_view", "text_view")).alias("x"))
    rows = scratch.written(first.select("doc_id", "x.text_view", "x.meta_view", F.xxhash64("doc_id").alias("place")).join(F.broadcast(chosen), "doc_id"), "sample-features")
    upto = F.sum(F.octet_length("text_view")).over(Window.orderBy("place", "doc_id"))  # labelled_max rows at most
    table = rows.withColumn("upto", upto).filter(F.col("upto") <= 4 * features_max).drop("upto").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    views = [_unpack(table[v]) for v in ("text_view", "meta_view")]
    fold = np.array([zlib.crc32(str(d).encode()) for d in table["doc_id"].to_pylist()], np.int64)
    hold = np.where(fold % 5 == 0, 1 + fold // 5 % 2, 0)
    others = _inputs(docs).drop("row", "tid").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")

    def passed(fitted: list[dict], features: list[np.ndarray]) -> list[list[np.ndarray]]:
        told = map_arrow(others, _teach(fitted, features), "target int, view int, feature bigint, " + ", ".join(f"{c} bigint" for c in _SUMS))
        sums = told.groupBy("target", "view", "feature").agg(*[F.sum(c).alias(c) for c in _SUMS]).toArrow()  # no more rows than features
        out = [[np.zeros((4, len(f) + 1), np.int64) for f in features] for _ in fitted]
        column = {c: sums[c].to_numpy() for c in sums.column_names}
        for t, of in enumerate(out):
            for v, own in enumerate(of):
                here = (column["target"] == t) & (column["view"] == v)
                own[:, column["feature"][here]] = [column[c][here] for c in _SUMS]
        return out

    return co_train(views, [TEXT_SIZE, META_SIZE], [table[t].to_numpy() for t in TARGETS], hold, passed, rounds, [EVIDENCE[t] for t in TARGETS])


def classify(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, labelled_max: int = LABELLED_MAX, features_max: int = FEATURES_MAX, rounds: int = ROUNDS) -> DataFrame:
    """row, p_low_quality, p_toxic, kept of every row of docs; row is the whole input row.

    kept: both probabilities are below reject_at.  A null text has no words
    and is judged by its metadata and its shares, which are 0; null metadata
    is a value of its own.  Without labels of both kinds a target's
    probability is the smoothed rate of its labels (0 without any).  Rows that
    repeat score alike; an empty table gives no rows.
    """
    fitted = fit(docs, labels, labelled_max, features_max, rounds)
    rows = _inputs(docs)
    schema = T.StructType([rows.schema["row"], *(T.StructField(f"p_{t}", T.DoubleType()) for t in TARGETS), T.StructField("kept", T.BooleanType())])
    return map_arrow(rows.drop("doc_id", "tid"), _score(fitted, reject_at), schema)
