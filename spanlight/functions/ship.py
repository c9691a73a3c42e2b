"""Python operators on executors: ship the package once, then stream Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a worker and back, where the session keeps Spark's default of 64 MB:
#: executors hold several batches outside the heap for each running task.
BATCH_BYTES = "4194304b"
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="spanlight-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def _releasing(fn: Callable) -> Callable:
    """fn, giving memory back as it goes: workers live on between tasks and share their executor's memory."""

    def run(batches):
        import pyarrow as pa

        pool = pa.default_memory_pool()
        try:
            for n, out in enumerate(fn(batches), 1):
                yield out
                if n % 16 == 0:
                    pool.release_unused()
        finally:
            pool.release_unused()

    return run


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_LIMIT, _DEFAULT) == _DEFAULT:
        spark.conf.set(_LIMIT, BATCH_BYTES)
    return df.mapInArrow(_releasing(fn), schema)
