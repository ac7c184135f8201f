"""Binned tables: counts, sums of weights and of their squares, sparse or dense."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.expressions import compile_expression, quoted
from eventloom.functions.types import FLOAT, as_float

from .base import ALIVE, DATASET, EVENTTYPE, Context, Stage, alive, is_mc
from .binning import Dimension, dimensions, weights_of
from .explode import explode_events


#: Bins of one dataset, at most, in a dense table with keys that have no bins.
MOST_BINS = 10_000_000


class BinnedDataframe(Stage):
    """``binning``: a list of ``{in, out, bins}``; ``weights``: variables to sum.

    Arrays are exploded raw and expressions evaluated on the exploded values, so the whole pass up to the partial
    aggregation is generated code; bins are grouped by number and named afterwards. Rows: the observed bins with
    ``observed``; else the product of all bins and the observed keys with zeros; with ``pad_missing`` the same product
    with nulls. Weights count for simulated events only unless ``weight_data``.
    """

    keeps_rows = True

    def __init__(self, name: str, out_dir: str = ".", binning: Any = None, weights: Any = None, dataset_col: bool = True, pad_missing: bool = False, file_format: Any = None, observed: bool = False, weight_data: bool = False) -> None:
        super().__init__(name, out_dir)
        self.dims, self.weights = dimensions(binning), weights_of(weights)
        self.dataset_col, self.pad_missing, self.file_format, self.observed, self.weight_data = dataset_col, pad_missing, file_format, observed, weight_data

    def file_name(self) -> str:
        return f"tbl_{'dataset.' if self.dataset_col else ''}{'.'.join(d.out for d in self.dims)}--{self.name}"

    def needs(self, ctx: Context) -> list[str]:
        return ctx.columns_of([*[d.expression for d in self.dims], *self.weights.values()])

    def numbers(self) -> list[str]:
        return ["n", *[f"{w}:sumw" for w in self.weights], *[f"{w}:sumw2" for w in self.weights]]

    def _keys(self) -> list[str]:
        return [DATASET] if self.dataset_col else []

    def sparse(self, ctx: Context) -> DataFrame:
        """Observed bins only; binned dimensions as numbers ``__bin<i>``, others as ``__key<i>``."""
        return self._grouped(ctx, False)

    def _grouped(self, ctx: Context, every: bool) -> DataFrame:
        """``every`` also groups what is in no bin, with null dimensions, and adds ``__mc``: whether any event is simulated."""
        names = self.needs(ctx)
        taken = [quoted(n) for n in names if n not in (DATASET, EVENTTYPE)]
        if every:
            rows = explode_events(ctx.df.select(DATASET, EVENTTYPE, F.coalesce(alive(), F.lit(False)).alias(ALIVE), *taken), ALIVE)
        else:
            rows = explode_events(ctx.df.where(alive()).select(DATASET, EVENTTYPE, *taken))
        compile_ = lambda text: compile_expression(text, rows.schema, ctx.aliases)
        keys, present = [], []
        for i, dim in enumerate(self.dims):
            value = compile_(dim.expression)
            if dim.edges:
                keys.append(dim.bin_of(as_float(value.column, value.kind)).alias(f"__bin{i}"))
                present.append(F.col(f"__bin{i}").isNotNull())
            else:
                keys.append(value.column.alias(f"__key{i}"))
                present.append(F.col(f"__key{i}").isNotNull() & (~F.isnan(f"__key{i}") if value.kind == FLOAT else F.lit(True)))
        first = compile_(names[0]) if names else None
        counted = F.lit(1) if first is None else F.when(first.column.isNotNull() & (~F.isnan(first.column) if first.kind == FLOAT else F.lit(True)), 1)
        held = [counted.alias("__one")]
        for i, text in enumerate(self.weights.values()):
            value = compile_(text)
            x = as_float(value.column, value.kind)
            known = F.when(~F.isnan(x), x).otherwise(0.0) if value.kind == FLOAT else x
            held.append((F.coalesce(known, F.lit(0.0)) if self.weight_data else F.when(is_mc(), F.coalesce(known, F.lit(0.0)))).alias(f"__w{i}"))
        binned = rows.select(*[F.col(k) for k in self._keys()], *keys, *held, *([ALIVE, is_mc().alias("__mc")] if every else []))
        sums = [F.count("__one").alias("n"), *[F.sum(f"__w{i}").alias(f"{w}:sumw") for i, w in enumerate(self.weights)], *[F.sum(F.col(f"__w{i}") * F.col(f"__w{i}")).alias(f"{w}:sumw2") for i, w in enumerate(self.weights)]]
        if every:
            here = F.col(ALIVE)
            for condition in present:
                here = here & condition
            binned = binned.withColumn("__here", here)
            binned = binned.select(*self._keys(), "__mc", *[F.when(F.col("__here"), F.col(c)).alias(c) for c in [*self._dims(), *[c for c in binned.columns if c == "__one" or c.startswith("__w")]]])
            sums.append(F.max("__mc").alias("__mc"))
        else:
            for condition in present:
                binned = binned.where(condition)
        return binned.groupBy(*self._keys(), *self._dims()).agg(*sums)

    def _dims(self) -> list[str]:
        return [f"__bin{i}" if d.edges else f"__key{i}" for i, d in enumerate(self.dims)]

    def dense(self, ctx: Context, zeros: bool) -> DataFrame:
        """The product of all bins with each dataset's observed keys, from one pass over the events.

        Of each dataset's groups the first also stands for all its empty bins. Keys without bins multiply with each
        other; beyond MOST_BINS of a dataset that is an error.
        """
        dims, groups = self._dims(), W.partitionBy(*(self._keys() or [F.lit(0)]))
        held = self._grouped(ctx, True)
        first = F.row_number().over(groups.orderBy(*dims)) == 1
        sets = [F.collect_set(d).over(groups).alias(f"__all{i}") for i, (d, dim) in enumerate(zip(dims, self.dims, strict=True)) if not dim.edges]
        table = held.select(*self._keys(), *dims, *[F.col(f"`{c}`") for c in self.numbers()], F.max("__mc").over(groups).alias("__mc"), *sets, first.alias("__first"))
        both = F.when(F.col("__first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        table = table.select("*", F.explode(both).alias("__fill")).where(F.col("__fill") | F.col(dims[0]).isNotNull())
        size = F.lit(1.0)
        for i, dim in enumerate(self.dims):
            size = size * (F.lit(float(len(dim.edges) - 1)) if dim.edges else F.size(f"__all{i}"))
        for i, (name, dim) in enumerate(zip(dims, self.dims, strict=True)):
            every = F.sequence(F.lit(0), F.lit(len(dim.edges) - 2)) if dim.edges else F.col(f"__all{i}")
            if i == 0 and not all(d.edges for d in self.dims):
                every = F.when(size > MOST_BINS, F.raise_error(F.lit(f"{self.name}: more than {MOST_BINS} dense bins; give its keys bins, or use observed"))).otherwise(every)
            table = table.select(*[quoted(c) for c in table.columns if c != name], F.explode(F.when(F.col("__fill"), every).otherwise(F.array(F.col(name)))).alias(name))
        numbers = [F.max(F.when(~F.col("__fill"), F.col(f"`{c}`"))).alias(c) for c in self.numbers()]
        full = table.groupBy(*self._keys(), *dims).agg(*numbers, F.max("__mc").alias("__mc"))
        if not zeros:
            return full
        simulated = F.col("__mc") if self.dataset_col and self.weights and not self.weight_data else F.lit(True)
        fill = [F.coalesce("n", F.lit(0).cast("bigint")).alias("n")]
        fill += [F.when(simulated, F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).otherwise(F.col(f"`{c}`")).alias(c) for c in self.numbers()[1:]]
        return full.select(*self._keys(), *dims, *fill)

    def named(self, table: DataFrame) -> DataFrame:
        names = [dim.label_of(F.col(f"__bin{i}")).alias(dim.out) if dim.edges else F.col(f"__key{i}").alias(dim.out) for i, dim in enumerate(self.dims)]
        return table.orderBy(*self._keys(), *self._dims()).select(*self._keys(), *names, *[F.col(f"`{c}`") for c in self.numbers()])

    def collect(self, ctx: Context) -> DataFrame:
        if self.pad_missing or not self.observed:
            return self.named(self.dense(ctx, zeros=not self.pad_missing))
        return self.named(self.sparse(ctx))


class BuildAghast(BinnedDataframe):
    """A dense histogram with zeros everywhere, and ``axes``: what its axes are, to lie beside the table as JSON."""

    def __init__(self, name: str, out_dir: str = ".", binning: Any = None, weights: Any = None, dataset_col: bool = True, weight_data: bool = False) -> None:
        super().__init__(name, out_dir, binning, weights, dataset_col, weight_data=weight_data)

    def collect(self, ctx: Context) -> DataFrame:
        return self.named(self.dense(ctx, zeros=True)).na.fill(0.0)

    def axes(self) -> dict:
        out = []
        for d in self.dims:
            inner = [e for e in d.edges or () if abs(e) != float("inf")]
            out.append({"name": d.out, "expression": d.expression, "kind": "category"} if not d.edges else {"name": d.out, "expression": d.expression, "kind": "edges", "edges": inner, "underflow": d.edges[0] == -float("inf"), "overflow": d.edges[-1] == float("inf")})
        return {"axes": ([{"name": DATASET, "kind": "category"}] if self.dataset_col else []) + out, "counts": {"unweighted": "n", "weighted": {w: {"sumw": f"{w}:sumw", "sumw2": f"{w}:sumw2"} for w in self.weights}}}


__all__ = ["BinnedDataframe", "BuildAghast", "Dimension"]
