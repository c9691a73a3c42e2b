"""Project manifests as tables (F-6, F-10, D-6).

`scan_manifests` reads any number of them below a path, in tasks, from any
store that Spark reads; `read_manifest` is for one project at hand.
"""

from __future__ import annotations

import glob
import os
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import map_arrow
from .files import stored_path
from .tables import written

SCHEMA = "project string, package string, dep_name string, dep_kind string"
_TABLES = {"dependencies": "normal", "dev-dependencies": "dev", "build-dependencies": "build"}


def _load(path: str) -> dict:
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def _named(tables: dict, kinds: dict[str, str]) -> list[tuple[str, str]]:
    """(name, kind); a dependency that is renamed counts by its package."""
    out = []
    for table, kind in kinds.items():
        for name, spec in (tables.get(table) or {}).items():
            out.append((spec.get("package", name) if isinstance(spec, dict) else name, kind))
    return out


def manifest_rows(path: str) -> list[tuple[str, str, str, str]]:
    """Dependencies of a folder's or file's package and of all members of its workspace; none if there is no manifest."""
    path = os.path.join(path, "Cargo.toml") if os.path.isdir(path) else path
    root = _load(path)
    project = os.path.basename(os.path.dirname(os.path.abspath(path)))
    found = [root] if "package" in root else []
    workspace = root.get("workspace", {})
    skipped = {os.path.normpath(os.path.join(os.path.dirname(path), e)) for e in workspace.get("exclude", [])}
    for pattern in workspace.get("members", []):
        for folder in sorted(glob.glob(os.path.join(os.path.dirname(path), pattern))):
            if os.path.normpath(folder) not in skipped:
                found.append(_load(os.path.join(folder, "Cargo.toml")))
    rows = []
    for m in found:
        package = m.get("package", {}).get("name", "")
        own = _named(m, _TABLES)
        for target in m.get("target", {}).values():
            own += _named(target, _TABLES)
        rows += [(project, package, name, kind) for name, kind in own]
    return rows


PARSED = "folder string, readable boolean, package string, own array<struct<dep_name:string,dep_kind:string>>, members array<string>, skipped array<string>"
_OWN = pa.list_(pa.struct([("dep_name", pa.string()), ("dep_kind", pa.string())]))


def _member_pattern(folder: str, glob_: str) -> str:
    """A pattern for the whole path of a member's folder; `*` and `?` stay within a part of it."""
    whole = posixpath.normpath(f"{folder}/{glob_}")
    one = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(one.get(x) or re.escape(x) for x in re.split(r"(\*\*|\*|\?)", whole)) + "$"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            folder = posixpath.dirname(path)
            try:
                m = tomllib.loads(content.decode("utf-8"))
            except (UnicodeDecodeError, tomllib.TOMLDecodeError):
                rows.append((folder, False, None, [], [], []))
                continue
            own = _named(m, _TABLES)
            for target in m.get("target", {}).values():
                own += _named(target, _TABLES)
            workspace = m.get("workspace", {})
            package = m["package"].get("name", "") if "package" in m else None
            rows.append((folder, True, package, [{"dep_name": n, "dep_kind": k} for n, k in own], [_member_pattern(folder, g) for g in workspace.get("members", [])], [posixpath.normpath(f"{folder}/{g}") for g in workspace.get("exclude", [])]))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string(), pa.bool_(), pa.string(), _OWN, pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[c.split()[0] for c in PARSED.split(", ")])


def parsed_manifests(spark: SparkSession, path: str, name: str = "Cargo.toml") -> DataFrame:
    """folder, readable, package, own, members, skipped of every manifest of that name below a path; one that can't be parsed is not readable and has nothing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    return map_arrow(found.select(stored_path().alias("path"), "content"), _parse, PARSED)


def scan_manifests(spark: SparkSession, path: str, name: str = "Cargo.toml") -> DataFrame:
    """folder, package, dep_name, dep_kind of every manifest's project below a path (F-6).

    A project has the dependencies of its own package and of the members of
    its workspace: manifests in a folder below that a pattern of the workspace
    names and that it does not exclude.  Members are found by a join on the
    folders above them, not by listing folders.
    """
    found = written(parsed_manifests(spark, path, name).filter("readable"), "manifests")
    own = found.filter("package is not null").select("folder", "package", "own")
    roots = found.filter("size(members) > 0").select(F.col("folder").alias("root"), "members", "skipped")
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = found.select("folder", F.coalesce("package", F.lit("")).alias("package"), "own", F.explode(above).alias("root"))
    members = below.join(roots, "root").filter(F.exists("members", lambda m: F.rlike("folder", m)) & ~F.array_contains("skipped", F.col("folder")))
    rows = own.unionByName(members.select(F.col("root").alias("folder"), "package", "own"))
    return rows.select("folder", "package", F.explode("own").alias("d")).select("folder", "package", "d.dep_name", "d.dep_kind")


def probed(manifests: DataFrame, crate: str) -> DataFrame:
    """folder, detected: whether a project's manifests name a crate among dependencies or those of tests (F-10, D-6)."""
    return manifests.groupBy("folder").agg(F.bool_or((F.col("dep_name") == crate) & F.col("dep_kind").isin("normal", "dev")).alias("detected"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """project, package, dep_name, dep_kind (F-6)."""
    return spark.createDataFrame(manifest_rows(path), SCHEMA)


def has_axum(path: str) -> bool:
    """Whether the manifest itself names axum among its dependencies or those of its tests (F-10)."""
    m = _load(os.path.join(path, "Cargo.toml") if os.path.isdir(path) else path)
    return any("axum" in (m.get(t) or {}) for t in ("dependencies", "dev-dependencies"))


def detected_frameworks(path: str, detectors: dict | None = None) -> list[str]:
    """Names of the registered detectors that find their framework (D-6, V-1)."""
    return [name for name, probe in ({"axum": has_axum} if detectors is None else detectors).items() if probe(path)]
