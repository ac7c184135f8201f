"""New variables from expressions, and weights with their systematic variations."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import functions as F

from eventloom.functions.reductions import keep_elements, reduce_event
from eventloom.functions.types import Typed, as_float

from .base import Context, Stage, is_mc, single_pair

KEYS = {"formula", "reduce", "mask", "fill_missing"}


class Define(Stage):
    """``variables``: an ordered list of ``{name: formula}`` or ``{name: {formula, reduce, mask, fill_missing}}``.

    Later ones see earlier ones. The mask picks elements before the reduction.
    """

    keeps_rows = True

    def __init__(self, name: str, out_dir: str = ".", variables: list | None = None) -> None:
        super().__init__(name, out_dir)
        self.variables = []
        for item in variables or []:
            target, config = single_pair(item, name)
            config = {"formula": config} if not isinstance(config, dict) else dict(config)
            if unknown := set(config) - KEYS:
                raise RuntimeError(f"{name}: {target} has unknown parameters {sorted(unknown)}")
            if "formula" not in config:
                raise RuntimeError(f"{name}: {target} has no formula")
            self.variables.append((target, config))

    def value(self, ctx: Context, config: dict[str, Any]) -> Typed:
        value = ctx.compile(config["formula"])
        if config.get("mask") is not None:
            value = keep_elements(value, ctx.compile(config["mask"]))
        if config.get("reduce") is not None:
            fill = config.get("fill_missing", math.nan)
            value = reduce_event(value, config["reduce"], math.nan if fill is None else fill)
        return value

    def apply(self, ctx: Context) -> Context:
        for target, config in self.variables:
            ctx = ctx.with_column(target, self.value(ctx, config).column)
        return ctx


class SystematicWeights(Stage):
    """Products of weights: the nominal one, and one for each variation with that weight's factor exchanged.

    ``weights``: name to a formula (nominal only) or to formulas by ``nominal``, ``up``, ``down`` and what
    ``extra_variations`` allows. Simulated events only: data has nulls.
    """

    keeps_rows = True

    def __init__(self, name: str, out_dir: str = ".", weights: dict | None = None, out_format: str = "weight_{}", extra_variations: list | tuple = ()) -> None:
        super().__init__(name, out_dir)
        allowed = ["nominal", "up", "down", *extra_variations]
        self.weights = {}
        for weight, held in (weights or {}).items():
            held = {"nominal": held} if isinstance(held, str) else dict(held)
            if "nominal" not in held:
                raise ValueError(f"{name}: weight {weight} has no nominal value")
            if unknown := set(held) - set(allowed):
                raise ValueError(f"{name}: weight {weight} has unknown variations {sorted(unknown)}")
            self.weights[weight] = held
        self.out_format, self.directions = out_format, allowed[1:]

    def formulas(self) -> dict[str, str]:
        """The product of each new variable, in order."""
        product = lambda over: "*".join(f"({over.get(w, held['nominal'])})" for w, held in self.weights.items())
        out = {self.out_format.format("nominal"): product({})}
        for weight, held in self.weights.items():
            for direction in self.directions:
                if direction in held:
                    out[self.out_format.format(f"{weight}_{direction}")] = product({weight: held[direction]})
        return out

    def apply(self, ctx: Context) -> Context:
        for target, formula in self.formulas().items():
            value = ctx.compile(formula)
            column = value.column if value.depth else as_float(value.column, value.kind)
            ctx = ctx.with_column(target, F.when(is_mc(), column))
        return ctx
