"""Configuration and pattern files in TOML (F-7, V-6)."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from dataclasses import asdict, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.ship import map_arrow
from ..operators.patterns import Pattern
from ..operators.rules import NamingRules
from ..plans.analyze import Config
from .files import stored_path


def load_config(path: str) -> Config:
    """A file's settings over the defaults; unknown keys are passed over."""
    with open(path, "rb") as f:
        return _config(tomllib.load(f))


def _config(data: dict) -> Config:
    rules = data.pop("naming_rules", {})
    known = {f.name for f in fields(Config)}
    config = Config(**{k: v for k, v in data.items() if k in known})
    config.naming_rules = NamingRules(**{k: v for k, v in rules.items() if k in {f.name for f in fields(NamingRules)}})
    return config


SETTINGS = "path string, readable boolean, threshold double, framework string, max_depth int, endpoint_prefix string, exclude_patterns array<string>, source_dirs array<string>"


def _settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                c, ok = _config(tomllib.loads(content.decode("utf-8"))), True
            except (UnicodeDecodeError, tomllib.TOMLDecodeError):
                c, ok = Config(), False
            rows.append((path, ok, c.threshold, c.framework, c.max_depth, c.naming_rules.endpoint_prefix, c.exclude_patterns, c.source_dirs))
        columns = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SETTINGS.split(", ")])


def scan_configs(spark: SparkSession, path: str, name: str = "*.toml") -> DataFrame:
    """A row of settings for every file of that name below a path, read in tasks; what can't be parsed has the defaults and is not readable; files of no bytes are passed over (F-7)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    return map_arrow(found.select(stored_path().alias("path"), "content"), _settings, SETTINGS)


def save_config(config: Config, path: str) -> None:
    """Every setting that is not null, tables last."""
    data = asdict(config)
    rules = data.pop("naming_rules")
    line = lambda k, v: f"{k} = {json.dumps(v, ensure_ascii=False)}\n"  # noqa: E731  JSON scalars and lists are TOML's
    text = "".join(line(k, v) for k, v in data.items() if v is not None)
    text += "\n[naming_rules]\n" + "".join(line(k, v) for k, v in rules.items() if v is not None)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def load_patterns(path: str) -> list[Pattern]:
    """Patterns of a file's [[patterns]] tables: category, regex or pattern, confidence (V-6)."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    out = []
    for p in data.get("patterns", []):
        out.append((p.get("category", "custom"), p.get("regex", p.get("pattern", "")), float(p.get("confidence", 0.5)), "regex" in p))
    return out
