"""Per-event reductions of the innermost array dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import BOOL, FLOAT, INT, Typed, as_float, sql_type


class BadReduction(ValueError):
    pass


def _numbers(a: Column, kind: str) -> Column:
    """Elements that are neither null nor NaN: what extremes are taken of."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)) if kind == FLOAT else F.filter(a, lambda x: x.isNotNull())


def _fold(a: Column, kind: str, start: float, work) -> Column:
    plain = INT if kind == BOOL else kind
    value = lambda x: F.coalesce(x.cast("int").cast("bigint") if kind == BOOL else x, F.lit(start).cast(sql_type(plain, 0)))
    return F.aggregate(a, F.lit(start).cast(sql_type(plain, 0)), lambda acc, x: work(acc, value(x)))


def _place(a: Column, kind: str, extreme) -> Column:
    best = extreme(_numbers(a, kind))
    return F.when(best.isNotNull(), (F.array_position(a, best) - 1).cast("bigint"))


def _truth(x: Column, kind: str) -> Column:
    return F.coalesce(x if kind == BOOL else x != 0, F.lit(False))


#: Reductions by name: (column of an array, kind of its elements) -> (column, kind).
NAMED = {
    "sum": lambda a, k: (_fold(a, k, 0, lambda x, y: x + y), INT if k == BOOL else k),
    "prod": lambda a, k: (_fold(a, k, 1, lambda x, y: x * y), INT if k == BOOL else k),
    "any": lambda a, k: (F.coalesce(F.exists(a, lambda x: _truth(x, k)), F.lit(False)), BOOL),
    "all": lambda a, k: (F.coalesce(F.forall(a, lambda x: _truth(x, k)), F.lit(True)), BOOL),
    "count_nonzero": lambda a, k: (F.size(F.filter(a, lambda x: _truth(x, k))).cast("bigint"), INT),
    "count_zero": lambda a, k: (F.size(F.filter(a, lambda x: x.isNotNull() & ~_truth(x, k))).cast("bigint"), INT),
    "counts": lambda a, k: (F.size(F.filter(a, lambda x: x.isNotNull())).cast("bigint"), INT),
    "max": lambda a, k: (F.array_max(_numbers(a, k)), k),
    "min": lambda a, k: (F.array_min(_numbers(a, k)), k),
    "argmax": lambda a, k: (_place(a, k, F.array_max), INT),
    "argmin": lambda a, k: (_place(a, k, F.array_min), INT),
}


def _inner(value: Typed, work) -> Column:
    def walk(a: Column, depth: int) -> Column:
        return work(a) if depth == 1 else F.transform(a, lambda x: walk(x, depth - 1))

    return walk(value.column, value.depth)


def reduce_event(value: Typed, how: str | int, fill_missing: float | bool | None = math.nan) -> Typed:
    """One dimension less: ``how`` names a reduction or is an index, negative ones counted from the end.

    An index gives double values with ``fill_missing`` where an event is too short; with True or False it gives
    booleans. Index ``-k`` takes element ``max(length, k) - k``, so ``-2`` of a single element is that element.
    Extremes skip NaN; of nothing they are null, as are their places. Sums and counts of nothing are zero.
    """
    if isinstance(how, bool) or not isinstance(how, (str, int)):
        raise BadReduction(f"{how!r} is not a string or an int")
    if isinstance(how, str) and how.lstrip("-").isdigit():
        how = int(how)
    if isinstance(how, str) and how not in NAMED:
        raise BadReduction(f"Unknown method {how!r}; there are {', '.join(NAMED)}")
    if value.depth < 1:
        raise BadReduction(f"{how!r} needs an array, this is one value an event")
    if isinstance(how, str):
        kind = NAMED[how](F.array(), value.kind)[1]
        return Typed(_inner(value, lambda a: NAMED[how](a, value.kind)[0]), kind, value.depth - 1)
    logical = isinstance(fill_missing, bool)

    def nth(a: Column) -> Column:
        at = F.lit(how) if how >= 0 else F.greatest(F.size(a), F.lit(-how)) - F.lit(-how)
        x = F.get(a, at)
        if logical:
            return F.coalesce(x if value.kind == BOOL else x != 0, F.lit(fill_missing))
        return F.coalesce(as_float(x, value.kind), F.lit(fill_missing).cast("double"))

    return Typed(_inner(value, nth), BOOL if logical else FLOAT, value.depth - 1)


def keep_elements(value: Typed, mask: Typed) -> Typed:
    """The elements whose mask is true; a value of less depth is first repeated to the mask's shape."""
    if mask.kind != BOOL or mask.depth < 1:
        raise ValueError("an element mask must be a jagged boolean")
    from .expressions import elementwise

    if value.depth < mask.depth:
        value = Typed(elementwise(lambda v, m: v, [(value.column, value.depth), (mask.column, mask.depth)]), value.kind, mask.depth)
    if value.depth > mask.depth:
        return Typed(F.filter(value.column, lambda x, i: F.coalesce(F.get(mask.column, i), F.lit(False))) if mask.depth == 1 else _masked(value.column, mask.column, mask.depth), value.kind, value.depth)
    return Typed(_masked(value.column, mask.column, mask.depth), value.kind, value.depth)


def _masked(a: Column, m: Column, depth: int) -> Column:
    uneven = F.raise_error(F.lit("cannot broadcast: mask and value have different jaggedness"))
    if depth > 1:
        return F.when(F.size(a) != F.size(m), uneven).otherwise(F.zip_with(a, m, lambda x, y: _masked(x, y, depth - 1)))
    return F.when(F.size(a) != F.size(m), uneven).otherwise(F.filter(a, lambda x, i: F.coalesce(F.get(m, i), F.lit(False))))
