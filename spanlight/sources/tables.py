"""Tables in the shared folder: what several jobs read is written once, where every executor can read it again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset (local runs)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        holder = tempfile.TemporaryDirectory(prefix="spanlight-")
        atexit.register(holder.cleanup)
        _own[app] = holder.name
    return _own[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spanlight/{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: one computation, no lineage, and its shuffle files go once it is written."""
    return written_with(df, name)[0]


def written_with(df: DataFrame, name: str, **told: Column) -> tuple[DataFrame, dict]:
    """df as a written table, and aggregates of it that the writing job takes along."""
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{uuid.uuid4().hex}-{name}"
    seen = Observation(name)
    rows = df.observe(seen, *[c.alias(k) for k, c in told.items()]) if told else df
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if told else {}


def discard(df: DataFrame) -> None:
    """Delete a table that `written` returned and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this application and all that is below it."""
    if f"/spanlight/{spark.sparkContext.applicationId}/" not in f"{folder}/":
        raise ValueError(f"{folder} is no written table")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}" if folder.startswith("/") else folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Growing:
    """A table that rounds of a loop add rows to: each part is written once, and the whole is one scan however many there are."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema, self.root = spark, schema, new_folder(spark, name)
        self.parts: list[str] = []

    def add(self, df: DataFrame, **told: Column) -> tuple[DataFrame, dict]:
        """Add the rows of df; gives them back as they were written, with the aggregates that were asked for."""
        rows, seen = df, Observation("part")
        if told:
            rows = df.observe(seen, *[c.alias(k) for k, c in told.items()])
        self.parts.append(f"{self.root}/part-{len(self.parts):05d}")
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            rows.write.parquet(self.parts[-1])
        return self.spark.read.schema(self.schema).parquet(self.parts[-1]), seen.get if told else {}

    def all(self) -> DataFrame:
        """Every row that was added so far."""
        return self.spark.read.schema(self.schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], self.schema)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{_app_dir(spark)}/{uuid.uuid4().hex}-{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    return written(df)


def clean_up(spark: SparkSession) -> None:
    """Delete the tables that this application has written; results that still read them must be stored before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
