"""What a stage sees and what it may give."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.expressions import compile_expression, quoted, variables
from eventloom.functions.types import Typed

#: Columns that every event has beside its variables.
DATASET, EVENTTYPE, ALIVE = "dataset", "eventtype", "__alive"


@dataclass(frozen=True)
class Context:
    """The events (with ``dataset``, ``eventtype`` and ``__alive``), and names that stand for other columns."""

    df: DataFrame
    aliases: dict[str, str] = field(default_factory=dict)
    datasets: tuple[str, ...] = ()

    def compile(self, text: str) -> Typed:
        return compile_expression(text, self.df.schema, self.aliases)

    def columns_of(self, texts: list[str]) -> list[str]:
        """The columns that expressions read, in order."""
        out = []
        for text in texts:
            for name in variables(text):
                out += variables(self.aliases.get(name, name), self.df.schema)
        return list(dict.fromkeys(out))

    def with_column(self, name: str, column: Column) -> Context:
        """A new variable; redefining one is an error, for dotted names too."""
        if name in self.df.columns:
            raise ValueError(f"variable {name!r} exists already")
        return replace(self, df=self.df.select("*", column.alias(name)))

    def with_frame(self, df: DataFrame) -> Context:
        return replace(self, df=df)


def events(df: DataFrame, dataset: str | Column = "events", eventtype: str | Column = "mc", aliases: dict[str, str] | None = None) -> Context:
    """A frame as events: adds the columns that stages rely on where they are missing."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    more = [as_column(v).alias(n) for n, v in ((DATASET, dataset), (EVENTTYPE, eventtype), (ALIVE, F.lit(True))) if n not in df.columns]
    return Context(df.select("*", *more), aliases or {})


def alive() -> Column:
    return F.col(ALIVE)


def is_mc() -> Column:
    return F.col(EVENTTYPE) == "mc"


class Stage:
    """A stage: ``apply`` changes the events, ``collect`` gives a table from the events as they were before it.

    ``keeps_rows`` says that ``apply`` drops no event, repeats none and changes no column but ``__alive``; ``needs`` names
    the columns that ``collect`` reads. Tables of stages that say both can be made from one copy of the events.
    """

    keeps_rows = False

    def __init__(self, name: str, out_dir: str = ".", **config: Any) -> None:
        self.name, self.out_dir = name, out_dir

    def apply(self, ctx: Context) -> Context:
        return ctx

    def collect(self, ctx: Context) -> DataFrame | None:
        return None

    def needs(self, ctx: Context) -> list[str] | None:
        return None

    def file_name(self) -> str | None:
        return None


def single_pair(item: Any, what: str) -> tuple[str, Any]:
    if not isinstance(item, dict) or len(item) != 1:
        raise RuntimeError(f"{what}: each item must be a dictionary of one key, not {item!r}")
    return next(iter(item.items()))


__all__ = ["ALIVE", "Context", "DATASET", "EVENTTYPE", "Stage", "alive", "events", "is_mc", "quoted", "single_pair"]
