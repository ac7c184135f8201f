"""Stages over a stream of events.

All elementwise stages are narrow, so they work on a streaming frame as they are. A binned table of a stream is the
sparse aggregate in complete mode: ``start_table`` keeps the newest table, bins named and ordered, in memory or in a
sink of one's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.base import Context, Stage
from eventloom.operators.binned import BinnedDataframe
from eventloom.plans.runner import final_events


def streaming_table(stages: Iterable[Stage], table: BinnedDataframe, ctx: Context) -> DataFrame:
    """The observed bins of a stream, after the stages."""
    return table.sparse(final_events(stages, ctx))


def start_table(stages: Iterable[Stage], table: BinnedDataframe, ctx: Context, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``sink`` with the whole named table after each batch; ``checkpoint`` is where a restart goes on from."""
    counts = streaming_table(stages, table, ctx)
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: sink(table.named(df), number)).start()
