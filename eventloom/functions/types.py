"""What the compiler knows of a column: its kind, and how many array dimensions it has inside an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INT, FLOAT, STRING, OTHER = "bool", "int", "float", "string", "other"


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    depth: int = 0


def kind_of(data_type: T.DataType) -> tuple[str, int]:
    depth = 0
    while isinstance(data_type, T.ArrayType):
        data_type, depth = data_type.elementType, depth + 1
    if isinstance(data_type, T.BooleanType):
        return BOOL, depth
    if isinstance(data_type, T.IntegralType):
        return INT, depth
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return FLOAT, depth
    return (STRING if isinstance(data_type, T.StringType) else OTHER), depth


def sql_type(kind: str, depth: int) -> str:
    return "array<" * depth + {BOOL: "boolean", INT: "bigint", FLOAT: "double", STRING: "string"}[kind] + ">" * depth


def widened(column: Column, data_type: T.DataType) -> Typed:
    """Integers become bigint and fractions double, so that arithmetic neither overflows early nor changes type."""
    kind, depth = kind_of(data_type)
    inner = data_type
    while isinstance(inner, T.ArrayType):
        inner = inner.elementType
    exact = isinstance(inner, (T.LongType, T.DoubleType, T.BooleanType)) or kind in (STRING, OTHER)
    return Typed(column if exact else column.cast(sql_type(kind, depth)), kind, depth)


def as_float(x: Column, kind: str) -> Column:
    return x if kind == FLOAT else x.cast("int").cast("double") if kind == BOOL else x.cast("double")


def is_nan(x: Column, kind: str) -> Column:
    return F.isnan(x) if kind == FLOAT else F.lit(False)
