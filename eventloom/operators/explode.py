"""Arrays of an event to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import quoted


def _kept(array: Column, held: str | None) -> list[Column]:
    """``held`` where there are elements."""
    return [] if held is None else [(F.col(held) & (F.coalesce(F.size(array), F.lit(0)) > 0)).alias(held)]


def explode_events(df: DataFrame, held: str | None = None) -> DataFrame:
    """One row for each innermost element: arrays advance together, everything else is repeated.

    All arrays of an event must have equal lengths at each depth, else the query fails; events whose arrays are empty
    or null have no rows. Strings are values. ``held``, a boolean column, keeps events without elements as one row each
    where it becomes false.
    """
    explode = F.explode if held is None else F.explode_outer
    while arrays := [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]:
        others = [quoted(n) for n in df.columns if n not in arrays and n != held]
        if len(arrays) == 1:
            zipped = quoted(arrays[0])
            exploded = df.select(*others, *_kept(zipped, held), explode(zipped).alias(arrays[0]))
        else:
            uneven = F.lit(False)
            for other in arrays[1:]:
                uneven = uneven | (F.size(quoted(arrays[0])) != F.size(quoted(other)))
            zipped = F.arrays_zip(*[quoted(n).alias(f"z{i}") for i, n in enumerate(arrays)])
            even = F.when(uneven, F.raise_error(F.lit("arrays of an event have different jaggedness"))).otherwise(zipped)
            rows = df.select(*others, *_kept(zipped, held), explode(even).alias("__zip"))
            names = rows.schema["__zip"].dataType.names
            exploded = rows.select(*others, *[F.col("__zip").getField(x).alias(n) for x, n in zip(names, arrays, strict=True)])
        df = exploded.select(*[quoted(n) for n in df.columns])
    return df
