"""String expressions over the variables of an event, compiled to Spark columns.

The text is parsed by Python's ``ast`` and checked against an allow-list; nothing is evaluated. Each node is lowered to
a column whose kind and depth follow from the schema, so one expression works on whole arrays inside an event (scalars
are broadcast to arrays, arrays of equal lengths combine element by element, others raise) and, after an explode, on
plain values, where everything stays in generated code.

Floating-point results are IEEE's: division by zero and logarithms give infinities and NaN instead of errors and nulls,
and every comparison with NaN but ``!=`` is false.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import BOOL, FLOAT, INT, OTHER, STRING, Typed, as_float, is_nan, widened

CONSTANTS = {"nan": math.nan, "inf": math.inf, "pi": math.pi, "e": math.e}


class ExpressionError(ValueError):
    pass


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _resolve(name: str, schema: T.StructType, aliases: dict[str, str]) -> Typed | None:
    """A variable: an alias, else a column of the whole dotted name, else a field of a struct (of structs)."""
    name = aliases.get(name, name)
    parts = name.split(".")
    for cut in range(len(parts), 0, -1):
        head = ".".join(parts[:cut])
        if head in schema.names:
            column, kind = quoted(head), schema[head].dataType
            for field in parts[cut:]:
                if not isinstance(kind, T.StructType) or field not in kind.names:
                    break
                column, kind = column.getField(field), kind[field].dataType
            else:
                return widened(column, kind)
    return None


def variables(text: str, schema: T.StructType | None = None) -> list[str]:
    """The names that an expression uses, in order of appearance; with a schema, the columns among them."""
    found: list[str] = []

    def walk(node: ast.AST) -> None:
        name = _dotted(node)
        if name:
            found.append(name)
            return
        for child in ast.iter_child_nodes(node):
            if not (isinstance(node, ast.Call) and child is node.func):
                walk(child)

    walk(_parse(text))
    names = [n for n in dict.fromkeys(found) if n not in CONSTANTS or (schema is not None and n in schema.names)]
    if schema is None:
        return names
    out = []
    for name in names:
        parts = name.split(".")
        out += [h for cut in range(len(parts), 0, -1) if (h := ".".join(parts[:cut])) in schema.names][:1]
    return list(dict.fromkeys(out))


def _parse(text: str) -> ast.AST:
    try:
        return ast.parse(str(text).strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot read expression {text!r}: {e.msg}") from None


def elementwise(work: Callable[..., Column], args: list[tuple[Column, int]]) -> Column:
    """Applies ``work`` to values at every depth: arrays are walked together, what is less deep is repeated."""
    deep = [i for i, (_, depth) in enumerate(args) if depth]
    if not deep:
        return work(*[c for c, _ in args])

    def inner(values: list[Column]) -> Column:
        now = list(args)
        for i, value in zip(deep, values, strict=True):
            now[i] = (value, args[i][1] - 1)
        return elementwise(work, now)

    arrays = [args[i][0] for i in deep]
    if len(arrays) == 1:
        return F.transform(arrays[0], lambda x: inner([x]))
    if len(arrays) == 2:
        joined = F.zip_with(arrays[0], arrays[1], lambda x, y: inner([x, y]))
    else:
        # Two at a time: the first two become pairs, the rest is walked beside them.
        paired = F.zip_with(arrays[0], arrays[1], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        joined = F.zip_with(paired, arrays[2], lambda p, z: inner([p.getField("x"), p.getField("y"), z]))
    uneven = F.lit(False)
    for other in arrays[1:]:
        uneven = uneven | (F.size(arrays[0]) != F.size(other))
    return F.when(uneven, F.raise_error(F.lit("cannot broadcast: arrays of an event have different jaggedness"))).otherwise(joined)


def _divide(a: Column, b: Column) -> Column:
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, F.try_divide(a, b)).otherwise(at_zero)


def _log(function: Callable[[Column], Column], least: float) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), x).when(x > least, function(x)).when(x == least, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def _whole(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(function(x).cast("double"))


#: Functions of doubles, by the names that expressions use.
MATH: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "exp": F.exp, "expm1": F.expm1,
    "log": _log(F.ln, 0.0), "log10": _log(F.log10, 0.0), "log1p": _log(F.log1p, -1.0), "floor": _whole(F.floor), "ceil": _whole(F.ceil), "hypot": F.hypot,
}
TWO = ("arctan2", "hypot")


class Compiler:
    def __init__(self, schema: T.StructType, aliases: dict[str, str] | None = None) -> None:
        self.schema, self.aliases = schema, aliases or {}

    def compile(self, text: str) -> Typed:
        return self.lower(_parse(text), text)

    def lower(self, node: ast.AST, text: str) -> Typed:
        again = lambda n: self.lower(n, text)
        if isinstance(node, (ast.Name, ast.Attribute)) and (name := _dotted(node)):
            found = _resolve(name, self.schema, self.aliases)
            if found is None and name in CONSTANTS:
                return Typed(F.lit(CONSTANTS[name]), FLOAT)
            if found is None:
                raise ExpressionError(f"no variable {name!r} in {text!r}")
            return found
        if isinstance(node, ast.Constant):
            for kind, python, sql in ((BOOL, bool, "boolean"), (INT, int, "bigint"), (FLOAT, float, "double"), (STRING, str, "string")):
                if isinstance(node.value, python):
                    return Typed(F.lit(node.value).cast(sql), kind)
        if isinstance(node, ast.UnaryOp):
            return self._unary(node.op, again(node.operand), text)
        if isinstance(node, ast.BinOp):
            return self._binary(node.op, again(node.left), again(node.right), text)
        if isinstance(node, ast.BoolOp):
            parts = [again(v) for v in node.values]
            out = parts[0]
            for other in parts[1:]:
                out = self._binary(ast.BitAnd() if isinstance(node.op, ast.And) else ast.BitOr(), out, other, text)
            return out
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return self._compare(node.ops[0], again(node.left), again(node.comparators[0]), text)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return self._call(node.func.id, [again(a) for a in node.args], text)
        raise ExpressionError(f"{type(node).__name__} is not allowed in {text!r}")

    def _apply(self, work: Callable[..., Column], kind: str, *args: Typed) -> Typed:
        return Typed(elementwise(work, [(a.column, a.depth) for a in args]), kind, max(a.depth for a in args))

    def _unary(self, op: ast.unaryop, x: Typed, text: str) -> Typed:
        if isinstance(op, ast.USub) and x.kind in (INT, FLOAT):
            return self._apply(lambda a: -a, x.kind, x)
        if isinstance(op, ast.UAdd) and x.kind in (INT, FLOAT):
            return x
        if isinstance(op, (ast.Invert, ast.Not)) and x.kind == BOOL:
            return self._apply(lambda a: ~a, BOOL, x)
        if isinstance(op, ast.Invert) and x.kind == INT:
            return self._apply(F.bitwise_not, INT, x)
        raise ExpressionError(f"wrong operand of {type(op).__name__} in {text!r}")

    def _binary(self, op: ast.operator, x: Typed, y: Typed, text: str) -> Typed:
        kinds = {x.kind, y.kind}
        if isinstance(op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            if kinds == {BOOL}:
                work = {ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a != b}[type(op)]
                return self._apply(work, BOOL, x, y)
            if kinds == {INT}:
                work = {ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.BitXor: lambda a, b: a.bitwiseXOR(b)}[type(op)]
                return self._apply(work, INT, x, y)
        elif not kinds & {STRING, OTHER}:
            both = lambda f: lambda a, b: f(as_float(a, x.kind), as_float(b, y.kind))
            if isinstance(op, ast.Div):
                return self._apply(both(_divide), FLOAT, x, y)
            if isinstance(op, ast.Pow):
                return self._apply(both(F.pow), FLOAT, x, y)
            whole = FLOAT not in kinds
            cast = (lambda f: lambda a, b: f(a.cast("bigint"), b.cast("bigint"))) if whole else both
            if isinstance(op, ast.Mod):
                empty = F.lit(None).cast("bigint") if whole else F.lit(math.nan)
                return self._apply(cast(lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None)).when(b != 0, F.try_mod(a, b)).otherwise(empty)), INT if whole else FLOAT, x, y)
            plain = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}.get(type(op))
            if plain:
                return self._apply(cast(plain), INT if whole else FLOAT, x, y)
        raise ExpressionError(f"wrong operands of {type(op).__name__} in {text!r}")

    def _compare(self, op: ast.cmpop, x: Typed, y: Typed, text: str) -> Typed:
        if (STRING in (x.kind, y.kind) and x.kind != y.kind) or OTHER in (x.kind, y.kind):
            raise ExpressionError(f"cannot compare {x.kind} and {y.kind} in {text!r}")
        mixed = x.kind != y.kind

        def work(a: Column, b: Column) -> Column:
            if mixed:
                a, b = as_float(a, x.kind), as_float(b, y.kind)
            kind = FLOAT if mixed else x.kind
            nan_a, nan_b = is_nan(a, kind), is_nan(b, kind)
            if kind != FLOAT:
                nan_a = nan_b = None
            sure = lambda c, *nans: c if nan_a is None else c & ~(nans[0] if len(nans) == 1 else nans[0] | nans[1])
            if isinstance(op, ast.Gt):
                return sure(a > b, nan_a, nan_b)
            if isinstance(op, ast.GtE):
                return sure(a >= b, nan_a, nan_b)
            if isinstance(op, ast.Lt):
                return sure(a < b, nan_a, nan_b)
            if isinstance(op, ast.LtE):
                return sure(a <= b, nan_a, nan_b)
            if isinstance(op, ast.Eq):
                return sure(a == b, nan_a, nan_b)
            return (a != b) if nan_a is None else (a != b) | nan_a | nan_b

        if not isinstance(op, (ast.Gt, ast.GtE, ast.Lt, ast.LtE, ast.Eq, ast.NotEq)):
            raise ExpressionError(f"{type(op).__name__} is not allowed in {text!r}")
        return self._apply(work, BOOL, x, y)

    def _call(self, name: str, args: list[Typed], text: str) -> Typed:
        if name == "where" and len(args) == 3 and args[0].kind == BOOL:
            kinds = {args[1].kind, args[2].kind}
            if len(kinds) == 1:
                return self._apply(lambda c, a, b: F.when(c, a).otherwise(b), args[1].kind, *args)
            if not kinds & {STRING, OTHER}:
                return self._apply(lambda c, a, b: F.when(c, as_float(a, args[1].kind)).otherwise(as_float(b, args[2].kind)), FLOAT, *args)
        if name == "abs" and len(args) == 1 and args[0].kind in (INT, FLOAT):
            return self._apply(F.abs, args[0].kind, args[0])
        if name in MATH and len(args) == (2 if name in TWO else 1) and all(a.kind in (INT, FLOAT, BOOL) for a in args):
            return self._apply(lambda *v: MATH[name](*[as_float(c, a.kind) for c, a in zip(v, args, strict=True)]), FLOAT, *args)
        raise ExpressionError(f"no function {name} of {len(args)} such arguments in {text!r}")


def compile_expression(text: str, schema: T.StructType, aliases: dict[str, str] | None = None) -> Typed:
    return Compiler(schema, aliases).compile(text)
