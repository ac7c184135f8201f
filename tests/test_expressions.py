import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Row

from eventloom.functions.expressions import ExpressionError, compile_expression, variables
from eventloom.functions.types import BOOL, FLOAT, INT
from eventloom.operators.explode import explode_events


def value(spark, text, schema, *rows):
    df = spark.createDataFrame(list(rows), schema)
    return [r[0] for r in df.select(compile_expression(text, df.schema).column.alias("x")).collect()]


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x / y", [math.inf, -math.inf, math.nan, 2.0, math.nan]),
        ("log(x)", [0.0, math.nan, -math.inf, math.log(4), math.nan]),
        ("log1p(x - 2)", [-math.inf, math.nan, math.nan, math.log1p(2), math.nan]),
        ("x > y", [True, False, False, True, False]),
        ("x != x", [False, False, False, False, True]),
        ("x == x", [True, True, True, True, False]),
        ("x <= nan", [False] * 5),
        ("where(x < inf, x, e - pi)", [1.0, -1.0, 0.0, 4.0, math.e - math.pi]),
        ("floor(x / 3)", [0.0, -1.0, 0.0, 1.0, math.nan]),
        ("-x + abs(x) ** 2", [0.0, 2.0, 0.0, 12.0, math.nan]),
    ],
)
def test_ieee(spark, text, want):
    got = value(spark, text, "x double, y double", (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (math.nan, 1.0))
    assert all(same(a, b) for a, b in zip(got, want, strict=True)), got


def test_null_stays_null(spark):
    assert value(spark, "log(x) + x / 0", "x double", (None,)) == [None]


def test_integers(spark):
    assert value(spark, "a * a + 1", "a int", (2**31 - 1,)) == [(2**31 - 1) ** 2 + 1]
    assert value(spark, "a / 2", "a int", (7,)) == [3.5]
    assert value(spark, "(a & 6) | 1", "a int", (7,)) == [7]
    assert value(spark, "a % 0", "a int", (7,)) == [None]


def test_jagged_broadcast(spark):
    rows = [([1.0, 2.0], [3.0, 4.0], 10.0), ([], [], 1.0)]
    assert value(spark, "a * s + b", "a array<double>, b array<double>, s double", *rows) == [[13.0, 24.0], []]
    assert value(spark, "where(a > 1, b, s)", "a array<double>, b array<double>, s double", *rows) == [[10.0, 4.0], []]
    with pytest.raises(PySparkException, match="jaggedness"):
        value(spark, "a + b", "a array<double>, b array<double>", ([1.0], [1.0, 2.0]))


def test_three_arrays(spark):
    assert value(spark, "where(c, a, b)", "a array<double>, b array<double>, c array<boolean>", ([1.0, 2.0], [3.0, 4.0], [True, False])) == [[1.0, 4.0]]


def test_nested(spark):
    rows = [([list(range(j, j + i + 1)) for i in range(j % 3)],) for j in range(5)]
    got = value(spark, "n + n * 2", "n array<array<bigint>>", *rows)
    assert got == [[[3 * j for j in x] for x in r[0]] for r in rows]


def test_dotted(spark):
    df = spark.createDataFrame([Row(**{"a.b": 1.0, "s": Row(t=Row(u=2.0))})])
    assert df.select(compile_expression("a.b + s.t.u", df.schema).column).first()[0] == 3.0
    assert variables("a.b + sqrt(s.t.u) * pi") == ["a.b", "s.t.u"]
    assert variables("a.b + s.t.u + zz", df.schema) == ["a.b", "s"]


@pytest.mark.parametrize("text", ["__import__('os')", "x.__class__()", "[x]", "lambda: 1", "x if x else y", "1 < x < 2", "nope(x)", "x &", "q", "x & 1.5", "~x", "x > 'a'"])
def test_refused(spark, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, spark.createDataFrame([(1.0,)], "x double").schema)


def test_kinds(spark):
    schema = spark.createDataFrame([], "i int, f float, b boolean, a array<int>").schema
    kinds = {t: compile_expression(t, schema).kind for t in ("i + i", "i + f", "i > f", "~b", "i / i", "a % 2")}
    assert kinds == {"i + i": INT, "i + f": FLOAT, "i > f": BOOL, "~b": BOOL, "i / i": FLOAT, "a % 2": INT}
    assert compile_expression("a + i", schema).depth == 1


numbers = st.lists(st.floats(allow_nan=True, allow_infinity=True, width=32), max_size=4)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(numbers, st.floats(allow_nan=True)), min_size=1, max_size=8))
def test_array_form_is_scalar_form(spark, rows):
    text = "where((a > s) | (a != a), a / (s - 1), -a) + log(abs(s))"
    df = spark.createDataFrame(rows, "a array<double>, s double")
    inside = [x for r in df.select(compile_expression(text, df.schema).column.alias("x")).collect() for x in r[0]]
    flat = explode_events(df)
    outside = [r[0] for r in flat.select(compile_expression(text, flat.schema).column.alias("x")).collect()]
    assert len(inside) == len(outside) and all(same(a, b) for a, b in zip(inside, outside, strict=True))
