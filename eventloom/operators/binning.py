"""Bin descriptions, their edges and labels, and the bin of a value as generated code."""

from __future__ import annotations

import ast
import math
import operator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


class BadBinning(ValueError):
    pass


def arithmetic(value: Any) -> float:
    """A number, or a string of arithmetic over numbers."""
    if not isinstance(value, str):
        return value

    def walk(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.operand))
        if isinstance(node, ast.Name) and node.id in ("inf", "pi"):
            return getattr(math, node.id)
        raise BadBinning(f"cannot evaluate {value!r}")

    return walk(ast.parse(value.strip(), mode="eval").body)


@dataclass(frozen=True)
class Dimension:
    """A bin axis: ``expression`` gives its value; without edges the value itself is the key."""

    expression: str
    out: str
    edges: tuple[float, ...] | None = None

    @property
    def labels(self) -> list[str]:
        return [f"[{a!r}, {b!r})" for a, b in zip(self.edges, self.edges[1:], strict=False)] if self.edges else []

    def bin_of(self, x: Column) -> Column:
        """The number of the bin [low, high) that holds a double: a balanced tree of comparisons with literal edges.

        Null for nulls, NaN, what is out of range, and plus infinity (no bin contains its upper edge).
        """
        edges = self.edges

        def search(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < F.lit(edges[mid]), search(lo, mid)).otherwise(search(mid, hi))

        inside = x.isNotNull() & ~F.isnan(x) & (x >= F.lit(edges[0])) & (x < F.lit(edges[-1]))
        return F.when(inside, search(0, len(edges) - 1))

    def label_of(self, number: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in self.labels]), number)


def edges_of(bins: Any) -> tuple[float, ...] | None:
    """Regular bins stay double; explicit edges are rounded to single precision. Open bins at both ends unless told."""
    if bins is None:
        return None
    if not isinstance(bins, dict):
        raise BadBinning(f"bins must be a dictionary, not {bins!r}")
    if "edges" in bins:
        edges = [float(x) for x in np.array([arithmetic(e) for e in bins["edges"]], np.float32)]
    elif {"nbins", "low", "high"} <= set(bins):
        edges = [float(x) for x in np.linspace(arithmetic(bins["low"]), arithmetic(bins["high"]), int(arithmetic(bins["nbins"])) + 1)]
    else:
        raise BadBinning(f"bins need edges, or nbins, low and high: {bins!r}")
    if bins.get("underflow", True) and edges[0] != -math.inf:
        edges.insert(0, -math.inf)
    if bins.get("overflow", True) and edges[-1] != math.inf:
        edges.append(math.inf)
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise BadBinning(f"edges must increase: {edges}")
    return tuple(edges)


def dimensions(binning: Any) -> list[Dimension]:
    if not isinstance(binning, list) or not binning:
        raise BadBinning("binning must be a list of descriptions")
    out = []
    for item in binning:
        if not isinstance(item, dict) or not isinstance(item.get("in"), str):
            raise BadBinning(f"a bin description needs 'in': {item!r}")
        if unknown := set(item) - {"in", "out", "bins", "index"}:
            raise BadBinning(f"unknown in a bin description: {sorted(unknown)}")
        name = item.get("out", item["in"])
        if not isinstance(name, str):
            raise BadBinning(f"'out' must be a name: {name!r}")
        out.append(Dimension(item["in"], name, edges_of(item.get("bins"))))
    if len({d.out for d in out}) < len(out):
        raise BadBinning("two dimensions have one name")
    return out


def weights_of(weights: Any) -> dict[str, str]:
    if weights is None:
        return {}
    if isinstance(weights, dict):
        return {str(k): str(v) for k, v in weights.items()}
    if isinstance(weights, (list, tuple)):
        return {str(w): str(w) for w in weights}
    return {str(weights): str(weights)}
