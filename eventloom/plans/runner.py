"""Running a sequence: stages fold over one lazy frame; each result table is a job of its own, over one copy of the events if asked."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.base import ALIVE, DATASET, EVENTTYPE, Context, Stage, alive, quoted
from eventloom.operators.binned import BinnedDataframe, BuildAghast
from eventloom.operators.cutflow import CutFlow
from eventloom.operators.skim import EventByEventDataframe
from eventloom.sources import sinks


def run(stages: Iterable[Stage], ctx: Context, write: bool = False, shared: str | None = None) -> dict[str, DataFrame]:
    """The result table of each stage that has one, by stage name; ``write`` also writes them to the stages' folders.

    User stages need ``apply(ctx)``; ``collect(ctx)`` sees the events as they were before the stage. Instead of
    ``collect`` one may have ``partial``, ``schema`` and ``merge`` (see ``merged``). With ``shared``, a folder that all
    executors see, the source is read once (see ``from_one_pass``); what is put there goes when tables were written, else
    it is the caller's to remove.
    """
    seen, made = visits(list(stages), ctx), []
    if shared:
        seen, made = from_one_pass(seen, shared)
    results: dict[str, DataFrame] = {}
    for stage, before in seen:
        table = collected(stage, before)
        if table is not None:
            results[stage.name] = table
            if write:
                write_result(stage, table)
    if write:
        for path in made:
            _remove(ctx.df.sparkSession, path)
    return results


def visits(stages: list[Stage], ctx: Context) -> list[tuple[Stage, Context]]:
    """Each stage with the events as they are before it."""
    out = []
    for stage in stages:
        out.append((stage, ctx))
        ctx = stage.apply(ctx) if hasattr(stage, "apply") else ctx
    return out


def collected(stage: Stage, ctx: Context) -> DataFrame | None:
    if hasattr(stage, "partial"):
        return merged(stage, ctx)
    return stage.collect(ctx) if hasattr(stage, "collect") else None


def merged(stage: Stage, ctx: Context) -> DataFrame:
    """A user's aggregate: ``partial`` makes rows of ``schema`` from each batch of events that are left, as a pandas frame
    of ``needs(ctx)`` (all columns if it has none) with dataset and event type; ``merge`` makes the table from the frame
    of all batches' rows, so what each batch leaves decides what is shuffled."""
    names = stage.needs(ctx) if hasattr(stage, "needs") else None
    taken = ctx.df.columns if names is None else list(dict.fromkeys([DATASET, EVENTTYPE, *names]))
    partial = stage.partial
    rows = ctx.df.where(alive()).select(*[quoted(n) for n in taken])
    return stage.merge(rows.mapInPandas(lambda batches: map(partial, batches), stage.schema))


def from_one_pass(seen: list[tuple[Stage, Context]], folder: str) -> tuple[list[tuple[Stage, Context]], list[str]]:
    """The same visits with contexts that read a copy of the events, and the copies' paths.

    Stages that keep rows only add columns and change ``__alive``, so the events after the last of a run of them hold all
    that its tables need. Of each run with two tables or more those columns are written once, with each table's own
    ``__alive``; the source's scan, joins and expressions are paid once and each table scans its columns of the copy.
    """
    out, made, at = list(seen), [], 0
    while at < len(seen):
        end = at + 1
        while end < len(seen) and getattr(seen[end - 1][0], "keeps_rows", not hasattr(seen[end - 1][0], "apply")):
            end += 1
        tables = {i: names for i in range(at, end) if hasattr(seen[i][0], "needs") and (names := seen[i][0].needs(seen[i][1])) is not None}
        if len(tables) > 1:
            path = f"{folder.rstrip('/')}/events-{uuid.uuid4().hex}"
            marks, last = {}, seen[at][1]
            for i in range(at, max(tables) + 1):
                if i in tables:
                    marks[i] = f"{ALIVE}{i}"
                    last = last.with_frame(last.df.withColumn(marks[i], alive()))
                if i < max(tables):
                    last = seen[i][0].apply(last) if hasattr(seen[i][0], "apply") else last
            names = list(dict.fromkeys([DATASET, EVENTTYPE, *[n for held in tables.values() for n in held if n != ALIVE]]))
            last.df.select(*[quoted(n) for n in names], *marks.values()).write.parquet(path)
            made.append(path)
            copy = last.df.sparkSession.read.parquet(path)
            for i, mark in marks.items():
                out[i] = (seen[i][0], seen[i][1].with_frame(copy.select(*[quoted(n) for n in names], F.col(mark).alias(ALIVE))))
        at = end
    return out, made


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def final_events(stages: Iterable[Stage], ctx: Context) -> Context:
    """The events after all stages."""
    for stage in stages:
        ctx = stage.apply(ctx)
    return ctx


def write_result(stage: Stage, table: DataFrame) -> list[str]:
    name = stage.file_name() or stage.name if hasattr(stage, "file_name") else stage.name
    if isinstance(stage, EventByEventDataframe):
        return sinks.write_events(table, stage.out_dir, name)
    if isinstance(stage, CutFlow):
        return sinks.write_table(table, stage.out_dir, name)
    made = sinks.write_table(table, stage.out_dir, name, getattr(stage, "file_format", None))
    if isinstance(stage, BuildAghast):
        made += sinks.write_json(stage.axes(), stage.out_dir, f"{name}.axes.json")
    return made


__all__ = ["BinnedDataframe", "final_events", "run", "write_result"]
