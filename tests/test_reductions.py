import math

import pytest

from eventloom.functions.expressions import compile_expression
from eventloom.functions.reductions import BadReduction, reduce_event
from eventloom.operators.base import events
from eventloom.operators.define import Define, SystematicWeights

JAGGED = [[0.0, 1.1, 2.2], [3.3, 4.4], [5.5], [6.6, 7.7, 8.8], [9.9, 10.0, 11.0], []]
N = math.nan


@pytest.fixture(scope="module")
def jagged(spark):
    return spark.createDataFrame([(a,) for a in JAGGED], "a array<double>").coalesce(1)


@pytest.mark.parametrize(
    ("how", "fill", "want"),
    [
        (1, N, [1.1, 4.4, N, 7.7, 10.0, N]),
        (-1, N, [2.2, 4.4, 5.5, 8.8, 11.0, N]),
        (-2, N, [1.1, 3.3, 5.5, 7.7, 10.0, N]),
        (1, 0, [1.1, 4.4, 0.0, 7.7, 10.0, 0.0]),
        ("0", False, [False, True, True, True, True, False]),
        ("counts", N, [3, 2, 1, 3, 3, 0]),
        ("sum", N, [3.3, 7.7, 5.5, 23.1, 30.9, 0.0]),
        ("prod", N, [0.0, 14.52, 5.5, 447.216, 1089.0, 1.0]),
        ("any", N, [True, True, True, True, True, False]),
        ("all", N, [False, True, True, True, True, True]),
        ("count_nonzero", N, [2, 2, 1, 3, 3, 0]),
        ("count_zero", N, [1, 0, 0, 0, 0, 0]),
        ("max", N, [2.2, 4.4, 5.5, 8.8, 11.0, None]),
        ("min", N, [0.0, 3.3, 5.5, 6.6, 9.9, None]),
        ("argmax", N, [2, 1, 0, 2, 2, None]),
        ("argmin", N, [0, 0, 0, 0, 0, None]),
    ],
)
def test_golden(jagged, how, fill, want):
    got = [r[0] for r in jagged.select(reduce_event(compile_expression("a", jagged.schema), how, fill).column).collect()]
    assert got == pytest.approx(want, nan_ok=True)


def test_nested_index(spark):
    rows = [([list(range(j, j + i + 1)) for i in range(j % 3)],) for j in range(5)]
    df = spark.createDataFrame(rows, "n array<array<bigint>>").coalesce(1)
    got = [r[0] for r in df.select(reduce_event(compile_expression("n", df.schema), 1).column).collect()]
    assert [len(x) for x in got] == [0, 1, 2, 0, 1] and math.isnan(got[1][0]) and got[2][1] == 3.0


def test_extremes_skip_nan(spark):
    df = spark.createDataFrame([([N, 1.0, None, 3.0],)], "a array<double>")
    x = compile_expression("a", df.schema)
    assert df.select(*[reduce_event(x, h).column.alias(h) for h in ("max", "min", "argmax", "counts", "count_nonzero")]).first() == (3.0, 1.0, 3, 3, 3)


@pytest.mark.parametrize("how", [1.5, None, True, "count", "mean"])
def test_bad(jagged, how):
    with pytest.raises(BadReduction, match="not a string or an int|Unknown method"):
        reduce_event(compile_expression("a", jagged.schema), how)


def test_define(spark):
    ctx = events(spark.createDataFrame([([3.0, 1.0], 2.0), ([], 1.0)], "a array<double>, s double"))
    ctx = Define("d", variables=[{"b": "a * s"}, {"c": {"formula": "b", "mask": "a > 2", "reduce": "sum"}}, {"d": {"formula": "s", "mask": "a > 0", "reduce": "counts"}}, {"x.y": "s + 1"}, {"z": "x.y * 2"}]).apply(ctx)
    assert [tuple(r) for r in ctx.df.select("b", "c", "d", "z").collect()] == [([6.0, 2.0], 6.0, 2, 6.0), ([], 0.0, 0, 4.0)]
    for again in ("b", "x.y"):
        with pytest.raises(ValueError, match="exists"):
            Define("d", variables=[{again: "s"}]).apply(ctx)
    with pytest.raises(ValueError, match="jagged"):
        Define("d", variables=[{"m": {"formula": "a", "mask": "s > 1"}}]).apply(ctx)


@pytest.mark.parametrize("variables", [["a"], [{"a": "1", "b": "2"}], [{"a": {"formula": "1", "other": 1}}], [{"a": {"reduce": 1}}]])
def test_define_refuses(variables):
    with pytest.raises(RuntimeError):
        Define("d", variables=variables)


def test_systematics(spark):
    weights = {"none": "NoVariation", "varied": {"nominal": "Varied", "up": "Varied * 1.5", "down": "Varied * 0.75"}}
    stage = SystematicWeights("s", weights=weights)
    df = spark.createDataFrame([(4.0, float(i)) for i in range(3)], "NoVariation double, Varied double")
    got = stage.apply(events(df)).df.select("weight_nominal", "weight_varied_up", "weight_varied_down").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (4.0, 6.0, 3.0), (8.0, 12.0, 6.0)]
    assert stage.apply(events(df, eventtype="data")).df.where("weight_nominal is not null").count() == 0
    more = {"a": {"nominal": "x", "up": "y", "left": "z"}, "b": {"nominal": "u", "down": "v"}, "c": "w"}
    assert SystematicWeights("s", weights=more, extra_variations=["left"]).formulas() == {"weight_nominal": "(x)*(u)*(w)", "weight_a_up": "(y)*(u)*(w)", "weight_a_left": "(z)*(u)*(w)", "weight_b_down": "(x)*(v)*(w)"}
    with pytest.raises(ValueError, match="unknown"):
        SystematicWeights("s", weights=more)
