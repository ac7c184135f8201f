"""Row-level export of the events that are left."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import DATASET, Context, Stage, alive, quoted
from .explode import explode_events

#: The column a source puts the input file's name in.
FILE = "__file"


class EventByEventDataframe(Stage):
    """``collections``: variables to keep; ``mask``: a further selection; ``flatten``: one row an element."""

    keeps_rows = True

    def __init__(self, name: str, out_dir: str = ".", collections: Any = None, mask: str | None = None, flatten: bool = True) -> None:
        super().__init__(name, out_dir)
        self.collections, self.mask, self.flatten = [collections] if isinstance(collections, str) else list(collections or []), mask, flatten

    def file_name(self) -> str:
        return f"df_{self.name}"

    def needs(self, ctx: Context) -> list[str]:
        return ctx.columns_of([*self.collections, *([self.mask] if self.mask else [])]) + [c for c in (FILE,) if c in ctx.df.columns]

    def collect(self, ctx: Context) -> DataFrame:
        df = ctx.df.where(alive())
        if self.mask:
            df = df.where(ctx.compile(self.mask).column)
        hashed = [F.xxhash64(F.col(FILE)).alias("hashed_filename")] if FILE in df.columns else []
        df = df.select(DATASET, *hashed, *[ctx.compile(c).column.alias(c) for c in self.collections])
        return explode_events(df) if self.flatten else df
