"""Nested selections with a table of cut efficiencies.

Every count of a table is a condition that is known at planning time, so one pass with conditional sums, grouped by
dataset, fills the whole table. Events that fail are kept with ``__alive`` false: later stages skip them, but totals of
a following cut flow still count them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.reductions import reduce_event
from eventloom.functions.types import BOOL, as_float

from .base import ALIVE, DATASET, Context, Stage, alive, is_mc

COUNTERS = ("passed_only_cut", "passed_incl", "totals_incl")
UNWEIGHTED = "unweighted"


class BadCutflow(ValueError):
    pass


@dataclass
class Cut:
    """A node of the selection: its place, its label, and its children if it combines others."""

    id: str
    depth: int
    label: str
    formula: Any = None
    children: list[Cut] = field(default_factory=list)

    def flat(self) -> list[Cut]:
        return [self, *[x for c in self.children for x in c.flat()]]


def parse_selection(config: Any, path: str = "0", depth: int = 0) -> Cut:
    """A string, ``{reduce, formula}``, or ``{All: [...]}`` / ``{Any: [...]}`` of such."""
    if isinstance(config, str):
        return Cut(path, depth, config, config)
    if isinstance(config, dict) and len(config) == 2:
        if set(config) != {"reduce", "formula"}:
            raise RuntimeError(f"a cut of two keys needs 'reduce' and 'formula', not {sorted(config)}")
        return Cut(path, depth, str(config), config)
    if isinstance(config, dict) and len(config) == 1:
        how, parts = next(iter(config.items()))
        if how not in ("All", "Any"):
            raise RuntimeError(f"a selection is 'All' or 'Any', not {how!r}")
        if not isinstance(parts, list):
            raise RuntimeError(f"{how} needs a list")
        return Cut(path, depth, how, None, [parse_selection(c, f"{path},{i}", depth + 1) for i, c in enumerate(parts)])
    raise RuntimeError(f"cannot read selection {config!r}")


def weight_names(weights: Any) -> dict[str, str]:
    if weights is None:
        return {}
    if isinstance(weights, str):
        weights = {weights: weights}
    if isinstance(weights, (list, tuple)):
        weights = {w: w for w in weights}
    if not isinstance(weights, dict) or not all(isinstance(x, str) for pair in weights.items() for x in pair):
        raise BadCutflow(f"weights must be names of variables, not {weights!r}")
    return dict(weights)


class Counts:
    """Conditions of each node's three counters, and each node's mask. A total of None counts every event.

    With ``projected`` they refer to columns of the cuts' own booleans, ``leaves``, which are to be projected first: what
    is counted then grows with the number of cuts and not with their expressions.
    """

    def __init__(self, ctx: Context, selection: Cut, projected: bool = False) -> None:
        self.ctx, self.rows, self.projected, self.leaves = ctx, [], projected, []
        self.mask = self._visit(selection, None, None)
        self.rows[0] = (selection, self.mask, self.mask, None)

    def _own(self, cut: Cut) -> Column:
        if isinstance(cut.formula, dict):
            value = reduce_event(self.ctx.compile(cut.formula["formula"]), cut.formula["reduce"], False)
        else:
            value = self.ctx.compile(cut.formula)
        if value.kind != BOOL or value.depth:
            raise BadCutflow(f"cut {cut.label!r} is not one boolean an event")
        own = F.coalesce(value.column, F.lit(False)) & alive()
        if not self.projected:
            return own
        self.leaves.append(own.alias(f"__cut{len(self.leaves)}"))
        return F.col(f"__cut{len(self.leaves) - 1}")

    def _visit(self, cut: Cut, current: Column | None, within: str | None) -> Column:
        """``current`` is the mask that an enclosing All has reached; it narrows what an Any's children count."""
        at = len(self.rows)
        self.rows.append(None)
        if cut.formula is not None:
            mask = self._own(cut)
        elif cut.label == "All":
            mask = None
            for child in cut.children:
                before = mask
                where = mask if current is None else current if mask is None else mask & current
                place = len(self.rows)
                own = self._visit(child, where, "All")
                mask = own if mask is None else mask & own
                self.rows[place] = (child, own, mask, before)
            mask = alive() if mask is None else mask
        else:
            mask = None
            for child in cut.children:
                place = len(self.rows)
                own = self._visit(child, current, within)
                mask = own if mask is None else mask | own
                self.rows[place] = (child, own, mask if current is None else mask & current, current)
            mask = F.lit(False) if mask is None else mask
        self.rows[at] = (cut, mask, mask, None)
        return mask


class CutFlow(Stage):
    """Applies a selection to all later stages and tables how many events, and which weights, pass each cut.

    The table has ``dataset, depth, cut`` (and ``unique_id`` if asked for) and each counter for ``unweighted`` and each
    weight's label. For data, weighted counters are the unweighted ones.
    """

    keeps_rows = True

    def __init__(self, name: str, out_dir: str = ".", selection: Any = None, selection_file: str | None = None, keep_unique_id: bool = False, weights: Any = None, counter: bool = True) -> None:
        super().__init__(name, out_dir)
        if (selection is None) == (selection_file is None):
            raise BadCutflow(f"{name}: give one of selection and selection_file")
        if not counter:
            raise NotImplementedError("a cut flow without counters")
        if selection_file is not None:
            import yaml

            with open(selection_file) as f:
                selection = yaml.safe_load(f)
        self.selection, self.weights, self.keep_unique_id = parse_selection(selection), weight_names(weights), keep_unique_id

    def file_name(self) -> str:
        return f"cuts_{self.name}-{'.'.join([UNWEIGHTED, *self.weights])}.csv" if self.weights else f"cuts_{self.name}-{UNWEIGHTED}.csv"

    def needs(self, ctx: Context) -> list[str]:
        formulas = [c.formula["formula"] if isinstance(c.formula, dict) else c.formula for c in self.selection.flat() if c.formula is not None]
        return ctx.columns_of([*formulas, *self.weights.values()])

    def mask(self, ctx: Context) -> Column:
        return Counts(ctx, self.selection).mask

    def apply(self, ctx: Context) -> Context:
        others = [c for c in ctx.df.columns if c != ALIVE]
        return ctx.with_frame(ctx.df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in others], self.mask(ctx).alias(ALIVE)))

    def collect(self, ctx: Context) -> DataFrame:
        counts = Counts(ctx, self.selection, projected=True)
        rows = counts.rows
        labels = [UNWEIGHTED, *self.weights]
        weights = {}
        for label, variable in self.weights.items():
            value = ctx.compile(variable)
            number = as_float(value.column, value.kind)
            weights[label] = F.when(is_mc(), F.when(alive() & ~F.isnan(number), number).otherwise(0.0)).otherwise(1.0)
        events = ctx.df.select(DATASET, ALIVE, *counts.leaves, *[w.alias(f"__w{i}") for i, w in enumerate(weights.values())])
        weights = {label: F.col(f"__w{i}") for i, label in enumerate(weights)}
        sums = []
        for i, (_, *conditions) in enumerate(rows):
            for counter, condition in zip(COUNTERS, conditions, strict=True):
                counted = F.lit(1) if condition is None else F.when(condition, 1)
                sums.append(F.count(counted).alias(f"c{i}_{counter}_{UNWEIGHTED}"))
                for label, weight in weights.items():
                    sums.append(F.coalesce(F.sum(weight if condition is None else F.when(condition, weight)), F.lit(0.0)).alias(f"c{i}_{counter}_{label}"))
        sums_of = events.groupBy(DATASET).agg(*sums)
        lines = []
        for i, (cut, *_) in enumerate(rows):
            values = [F.col(f"`c{i}_{counter}_{label}`").alias(f"{counter}_{label}") for counter in COUNTERS for label in labels]
            lines.append(F.struct(F.lit(i).alias("place"), F.lit(cut.id).alias("unique_id"), F.lit(cut.depth).alias("depth"), F.lit(cut.label).alias("cut"), *values))
        table = sums_of.select(DATASET, F.explode(F.array(*lines)).alias("row")).select(DATASET, "row.*")
        names = [DATASET, "depth", "cut", *(["unique_id"] if self.keep_unique_id else []), *[f"{c}_{x}" for c in COUNTERS for x in labels]]
        return table.orderBy(DATASET, "place").select(*[F.col(f"`{n}`") for n in names])


class SelectPhaseSpace(CutFlow):
    """The same, but the selection becomes the boolean variable ``region_name`` and no event is dropped."""

    def __init__(self, name: str, out_dir: str = ".", region_name: str = "", **config: Any) -> None:
        super().__init__(name, out_dir, **config)
        if not region_name:
            raise BadCutflow(f"{name}: region_name is missing")
        self.region_name = region_name

    def apply(self, ctx: Context) -> Context:
        return ctx.with_column(self.region_name, self.mask(ctx))


