"""Books of datasets: YAML that names groups of files, read into one frame of events.

Any format that Spark reads works by its name; others are registered as plugins, objects whose ``open(spark, paths)``
gives a frame. Every dataset's rows are tagged with its name and event type; the frames are united by column name, and
what a dataset lacks is null.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.expressions import compile_expression
from eventloom.operators.base import ALIVE, DATASET, EVENTTYPE, Context
from eventloom.operators.skim import FILE


class SourcePlugin(Protocol):
    def open(self, spark: SparkSession, paths: list[str]) -> DataFrame: ...


class SparkSource:
    """A format of Spark's own, or of a data source that is registered with the session."""

    def __init__(self, format: str = "parquet", **options: Any) -> None:  # noqa: A002
        self.format, self.options = format, options

    def open(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).load(paths)


_plugins: dict[str, Callable[..., SourcePlugin]] = {n: functools.partial(SparkSource, n) for n in ("parquet", "orc", "json", "csv", "text", "avro")}


def register_source(name: str, plugin: Callable[..., SourcePlugin]) -> None:
    _plugins[name] = plugin


def unregister_source(name: str) -> None:
    _plugins.pop(name, None)


def get_source(name: str, config: dict[str, Any] | str | None = None) -> SourcePlugin:
    """A plugin by name; ``config`` holds its options, or names a YAML file of them."""
    if name not in _plugins:
        raise ValueError(f"no source {name!r}; there are {', '.join(sorted(_plugins))}")
    if isinstance(config, str):
        if not os.path.exists(config):
            raise RuntimeError(f"source configuration {config!r} does not exist")
        config = load_yaml(config)
    return _plugins[name](**(config or {}))


@dataclass
class Dataset:
    name: str
    files: list[str]
    eventtype: str = "mc"
    format: str = "parquet"
    options: dict[str, Any] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    #: ``column`` (of integers), ``start`` and ``stop``: reads these rows only, see ``row_range``.
    rows: dict[str, Any] | None = None


def load_yaml(path: str) -> dict:
    with open(path) as f:
        return yaml.safe_load(f) or {}


def _checked_rows(item: dict) -> dict[str, Any] | None:
    rows = item.get("rows")
    if rows is not None and (not isinstance(rows, dict) or "column" not in rows or set(rows) - {"column", "start", "stop"}):
        raise ValueError(f"dataset {item.get('name')!r}: rows are a column with start and stop, not {rows!r}")
    return rows


def read_datasets(path: str) -> list[Dataset]:
    """Reads a book: ``datasets`` (list), ``defaults``, ``import`` (other books, ``{this_dir}`` is the book's folder)."""
    held, here = load_yaml(path), os.path.dirname(os.path.abspath(path))
    out = []
    for other in held.get("import", []):
        out += read_datasets(os.path.join(here, other.format(this_dir=here)))
    defaults = held.get("defaults", {})
    for item in held.get("datasets", []):
        item = defaults | ({"name": item} if isinstance(item, str) else item)
        files = item.get("files", [])
        prefix = item.get("prefix", "")
        files = [prefix + f.format(this_dir=here) for f in ([files] if isinstance(files, str) else files)]
        files = [f if "://" in f or os.path.isabs(f) else os.path.join(here, f) for f in files]
        if not files:
            raise ValueError(f"dataset {item.get('name')!r} has no files")
        out.append(Dataset(item["name"], files, item.get("eventtype", "mc"), item.get("format", "parquet"), item.get("options", {}), item.get("aliases", {}), _checked_rows(item)))
    if len({d.name for d in out}) < len(out):
        raise ValueError("two datasets have one name")
    return out


def as_events(spark: SparkSession, datasets: list[Dataset], source: SourcePlugin | None = None, most: int | None = None) -> Context:
    """All datasets as one frame; ``most`` limits the events read of each, for trials."""
    frames = []
    # Names that stand for the same column everywhere stay names; others become columns of each dataset.
    aliases = {k: v for d in datasets for k, v in d.aliases.items() if all(o.aliases.get(k) == v for o in datasets)}
    for d in datasets:
        df = (source or get_source(d.format, d.options)).open(spark, d.files)
        if d.rows:
            df = row_range(df, d.rows["column"], d.rows.get("start", 0), d.rows.get("stop", -1))
        own = {k: v for k, v in d.aliases.items() if k not in aliases}
        if taken := own.keys() & set(df.columns):
            raise ValueError(f"dataset {d.name!r}: {sorted(taken)} are columns as well as aliases")
        df = df.select("*", *[compile_expression(v, df.schema, {}).column.alias(k) for k, v in own.items()])
        df = df.select("*", F.lit(d.name).alias(DATASET), F.lit(d.eventtype).alias(EVENTTYPE), F.lit(True).alias(ALIVE), F.input_file_name().alias(FILE))
        frames.append(df.limit(most) if most is not None else df)
    united = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Context(united, aliases, tuple(d.name for d in datasets))


def row_range(df: DataFrame, order: str, start: int = 0, stop: int = -1) -> DataFrame:
    """Rows of a range of the integer column ``order``, [start, stop), stop -1 for all: a filter that reaches the scan."""
    held = df.where(F.col(order) >= start) if start else df
    return held if stop == -1 else held.where(F.col(order) < stop)
