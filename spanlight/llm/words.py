"""Vectorised word scanning of Arrow string columns.

Words are found on the UTF-8 bytes of a whole slice of rows at once.  Each
word is named by a 64-bit hash of its bytes, and runs of words by a polynomial
of the names modulo the prime 2**61 - 1.  Names only find candidates: what
decides is compared by the bytes themselves, or by a 128-bit BLAKE2b digest of
them (`Words.digests`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; one longer text is taken whole.
SLICE_BYTES = 1 << 20

_U = np.uint64
PRIME = (1 << 61) - 1
_P, _M31, _M30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
_BASE = 0x12E15E35B500F16F % PRIME


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below PRIME."""
    a1, a0, b1, b0 = a >> _U(31), a & _M31, b >> _U(31), b & _M31
    mid = a0 * b1 + a1 * b0
    t = a1 * b1 * _U(2) + (mid >> _U(30)) + ((mid & _M30) << _U(31)) + a0 * b0
    t = (t & _P) + (t >> _U(61))
    return np.where(t >= _P, t - _P, t)


class _Powers:
    """base**i and base**-i modulo PRIME, grown on demand."""

    def __init__(self, base: int):
        self.base, self.pow, self.inv = base, np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.pow) < n:
            size = len(self.pow)
            for name, b in (("pow", self.base), ("inv", pow(self.base, -1, PRIME))):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, mulmod(a, np.full(size, pow(b, size, PRIME), _U))]))
        return self.pow[:n], self.inv[:n]


_words = _Powers(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Separators `[\x20\x09-\x0D]` and, with A-Z folded, all that `[^0-9a-z\x80-]` holds.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a slice of rows: ptr[r]:ptr[r + 1] for row r; word i is joined[at[i]:at[i + 1] - 1], and a space follows it."""

    joined: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def text(self, i: int) -> bytes:
        return self.joined[self.at[i] : self.at[i + 1] - 1].tobytes()

    def digests(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """A 128-bit digest of the words start[i]:end[i], joined by one space."""
        view = memoryview(self.joined)
        return [hashlib.blake2b(view[a : b - 1], digest_size=16).digest() for a, b in zip(self.at[start].tolist(), self.at[end].tolist())]

    def strings(self) -> pa.Array:
        """The words as an Arrow array."""
        return pc.binary_slice(_binary(self.joined, self.at), 0, -1).cast(pa.string())


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, one row at least."""
    if len(column) == 0:
        return
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, to
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(column: pa.Array, separators: np.ndarray = WHITE, fold: np.ndarray | None = None) -> Words:
    data, offsets = raw(column)
    if fold is not None:
        data = fold[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    ptr = np.searchsorted(start, offsets).astype(np.int64)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    joined = np.full(at[-1], 0x20, np.uint8)
    held = np.flatnonzero(inside[1:-1])
    joined[np.arange(len(held)) + np.repeat(np.arange(len(size)), size)] = data[held]
    return Words(joined, at, names(joined, at), ptr)


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
_LONG = 256


def names(joined: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word: its bytes, eight at a time, through a chain of `mix`.

    Words of one length of at most eight bytes can't share a name; words of
    over _LONG bytes are named by their digest.
    """
    start, size = at[:-1], np.diff(at) - 1
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(joined) + 1,), "<u8", padded, strides=(1,))
    name = mix(size.astype(_U) * _U(0xA24BAED4963EE407) + _U(1))
    left = np.flatnonzero(size <= _LONG)
    for j in range(0, _LONG, 8):
        left = left[size[left] > j]
        if not len(left):
            break
        lane = eight[start[left] + j] & _MASKS[np.minimum(size[left] - j, 8)]
        name[left] = mix(name[left] ^ (lane * _U(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(size > _LONG).tolist():
        name[i] = int.from_bytes(hashlib.blake2b(memoryview(joined)[at[i] : at[i + 1] - 1], digest_size=8).digest(), "little")
    return name


def codes(*found: Words) -> list[np.ndarray]:
    """A number for each word of each slice, equal for equal words and for no others."""
    own = pa.concat_arrays([_binary(f.joined, f.at) for f in found]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.split(own, np.cumsum([len(f.hash) for f in found])[:-1])


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Polynomials of all prefixes of 64-bit symbols, modulo PRIME."""
    power, _ = _words.upto(len(symbols) + 1)
    term = mulmod((symbols & _P) % _P, power[: len(symbols)])
    low, high = np.cumsum(term & _M31, dtype=_U), np.cumsum(term >> _U(31), dtype=_U)
    prefix = np.zeros(len(symbols) + 1, _U)
    prefix[1:] = (mulmod(high % _P, np.full(len(high), 1 << 31, _U)) + low % _P) % _P
    return prefix


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end] from prefix_hashes(symbols), equal for equal content."""
    _, inverse = _words.upto(len(prefix))
    held = mulmod((prefix[end] + (_P - prefix[start])) % _P, inverse[start])
    return mix(held + (end - start).astype(_U) * _U(0x9FB21C651E98DF25))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
