"""Vectors as whole numbers: what the two vector operators read, and how their tasks see it.

Components become integers once, so that distances, sums and means are exact
and no result depends on how rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Integer components beyond this have no sums of squares in 38 digits; their vectors are left out.
LARGEST = 1 << 56
#: The type of exact numbers that may pass 64 bits.
WIDE = "decimal(38,0)"
LONG_MAX = (1 << 63) - 1


def usable(vector: Column, scale: int = SCALE) -> Column:
    """True for a vector without null, non-finite or too large components."""
    limit = float(LARGEST) / scale
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < limit, F.lit(False))), F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as array<bigint>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def largest(vector: str) -> Column:
    """An aggregate: the largest magnitude of a component."""
    return F.max(F.array_max(F.transform(vector, F.abs)))


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A row for each vector of an Arrow list column; numbers are exact for dtype object."""
    flat = column.flatten()
    if pa.types.is_decimal(flat.type):
        flat = np.array([int(x) for x in flat.to_pylist()], object)
    else:
        flat = flat.to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(-1, width)


def lists(rows: np.ndarray, of: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    width = rows.shape[1]
    if pa.types.is_decimal(of):
        from decimal import Decimal

        flat = pa.array([Decimal(int(x)) for x in rows.ravel()], of)
    else:
        flat = pa.array(np.ascontiguousarray(rows.ravel()).astype(np.int64), pa.int64()).cast(of)
    return pa.ListArray.from_arrays(np.arange(0, width * len(rows) + 1, width, dtype=np.int32), flat)


def arrow_type(kind: str) -> pa.DataType:
    return pa.decimal128(38, 0) if kind == WIDE else pa.int64()


def as_long(number: Column) -> Column:
    """A sum as bigint, held at the largest one."""
    return F.least(number, F.lit(LONG_MAX).cast(WIDE)).cast("bigint")
