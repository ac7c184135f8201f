"""Array primitives for stages of one's own, on columns with the kind and depth that the compiler gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import elementwise
from .reductions import reduce_event
from .types import BOOL, Typed, kind_of, sql_type


def _innermost(value: Typed, work) -> Typed:
    def walk(a: Column, depth: int) -> Column:
        return work(a) if depth == 1 else F.transform(a, lambda x: walk(x, depth - 1))

    return Typed(walk(value.column, value.depth), value.kind, value.depth)


def counts(value: Typed) -> Typed:
    """Valid elements of the innermost arrays."""
    return reduce_event(value, "counts")


def pad(value: Typed, length: int) -> Typed:
    """Innermost arrays filled with nulls at the end up to a length."""
    return _innermost(value, lambda a: F.concat(a, F.array_repeat(F.lit(None).cast(sql_type(value.kind, 0)), F.greatest(F.lit(length) - F.size(a), F.lit(0)))))


def flatten(value: Typed) -> Typed:
    """One dimension less by concatenation; an array of one dimension stays."""
    return value if value.depth < 2 else Typed(F.flatten(value.column), value.kind, value.depth - 1)


def fill_none(value: Typed, fill: float | bool | str) -> Typed:
    """Nulls, at any depth of elements, become a value."""
    return Typed(elementwise(lambda x: F.coalesce(x, F.lit(fill).cast(sql_type(value.kind, 0))), [(value.column, value.depth)]), value.kind, value.depth)


def values_as_type(value: Typed, kind: str) -> Typed:
    return Typed(value.column.cast(sql_type(kind, value.depth)), kind, value.depth)


def valid_entry_mask(value: Typed) -> Typed:
    """Whether an event has a value at all."""
    return Typed(value.column.isNotNull(), BOOL)


def only_valid_entries(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def filtered_len(df: DataFrame, name: str) -> int:
    """How many events have a value."""
    return only_valid_entries(df.select(name), name).count()


def is_bool(data_type: T.DataType) -> bool:
    return kind_of(data_type)[0] == BOOL


def dtype(data_type: T.DataType) -> str:
    """The kind of the innermost elements."""
    return kind_of(data_type)[0]
