import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventloom.operators.base import Context, events
from eventloom.operators.binned import BinnedDataframe, BuildAghast
from eventloom.operators.binning import BadBinning, arithmetic, dimensions, edges_of
from eventloom.operators.explode import explode_events
from eventloom.operators.skim import EventByEventDataframe


def test_edges():
    assert len(edges_of({"nbins": 29, "low": 0, "high": 100})) == 32
    assert edges_of({"edges": [0, 0.1]}) == (-math.inf, 0.0, 0.10000000149011612, math.inf)
    assert len(edges_of({"nbins": "20", "low": 0.0, "high": "2.0*10**2"})) == 23
    assert edges_of({"nbins": 2, "low": 0, "high": 2, "overflow": False, "underflow": False}) == (0.0, 1.0, 2.0)
    assert dimensions([{"in": "x", "index": 0}])[0].out == "x"
    for bad in ("x", [], [{"out": "x"}], [{"in": 1}], [{"in": "x", "bins": 3}], [{"in": "x", "bins": {}}], [{"in": "x"}, {"in": "y", "out": "x"}], [{"in": "x", "out": 2}], [{"in": "x", "more": 2}]):
        with pytest.raises(BadBinning):
            dimensions(bad)
    with pytest.raises(BadBinning):
        arithmetic("open('x')")


def test_bin_of_every_kind_of_value(spark):
    dim = dimensions([{"in": "x", "bins": {"edges": [0, 1, 2]}}])[0]
    values = [None, math.nan, -math.inf, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, 3.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    assert [r[0] for r in df.select(dim.bin_of(F.col("x"))).collect()] == [None, None, 0, 0, 1, 1, 1, 2, 3, 3, None]
    regular = dimensions([{"in": "x", "bins": {"nbins": 29, "low": 0, "high": 100}}])[0]
    points = np.linspace(0, 100, 30).tolist()
    df = spark.createDataFrame([(v,) for v in points], "x double").coalesce(1)
    assert [r[0] for r in df.select(regular.bin_of(F.col("x"))).collect()] == list(range(1, 31))


def test_explode(spark):
    df = spark.createDataFrame([([1, 2, 3], 1), ([9], 1), ([], 1), ([3, 4], 1)], "A array<int>, B int")
    assert explode_events(df).count() == 6 and explode_events(df.withColumn("C", F.col("A"))).count() == 6
    assert explode_events(df.withColumn("s", F.lit("text"))).columns == ["A", "B", "s"]
    uneven = spark.createDataFrame([([1, 2], [1])], "A array<int>, D array<int>")
    with pytest.raises(PySparkException, match="jaggedness"):
        explode_events(uneven).count()
    deep = spark.createDataFrame([([[1, 2], [3]], 1), ([[], [4, 5]], 2), ([], 3), ([[6], [7, 8]], 4)], "A array<array<int>>, B int")
    assert explode_events(deep).count() == 8
    assert explode_events(spark.createDataFrame([(None, 1)], "A array<int>, B int")).count() == 0


@pytest.fixture(scope="module")
def ctx(spark):
    rows = [("mc1", "mc", [1.0, 5.0, math.nan], "x", 2.0), ("mc1", "mc", [1.5], "y", math.nan), ("mc1", "mc", [], "x", 1.0), ("data", "data", [7.0], "x", 3.0)]
    return events(spark.createDataFrame(rows, "dataset string, eventtype string, v array<double>, k string, w double"))


BINS = [{"in": "v", "out": "v", "bins": {"edges": [0, 2, 6]}}]


def rows(stage, ctx):
    return [tuple(r) for r in stage.collect(ctx).collect()]


def test_sparse_and_weights(ctx):
    got = rows(BinnedDataframe("t", binning=BINS, weights={"w": "w"}, observed=True), ctx)
    assert got == [("data", "[6.0, inf)", 1, None, None), ("mc1", "[0.0, 2.0)", 2, 2.0, 4.0), ("mc1", "[2.0, 6.0)", 1, 2.0, 4.0)]
    assert rows(BinnedDataframe("t", binning=BINS, weights="w", observed=True, weight_data=True), ctx)[0] == ("data", "[6.0, inf)", 1, 3.0, 9.0)


def test_dense_and_padded(ctx):
    dense = rows(BinnedDataframe("t", binning=BINS, weights="w"), ctx)
    assert len(dense) == 8 and dense[0] == ("data", "[-inf, 0.0)", 0, None, None) and dense[4] == ("mc1", "[-inf, 0.0)", 0, 0.0, 0.0)
    padded = rows(BinnedDataframe("t", binning=BINS, weights="w", pad_missing=True), ctx)
    assert len(padded) == 8 and padded[4] == ("mc1", "[-inf, 0.0)", None, None, None)
    filled = rows(BuildAghast("t", binning=BINS, weights="w"), ctx)
    assert filled[0] == ("data", "[-inf, 0.0)", 0, 0.0, 0.0)


def test_categories_and_names(ctx):
    stage = BinnedDataframe("t", binning=[*BINS, {"in": "k"}], dataset_col=False, observed=True)
    assert rows(stage, ctx) == [("[0.0, 2.0)", "x", 1), ("[0.0, 2.0)", "y", 1), ("[2.0, 6.0)", "x", 1), ("[6.0, inf)", "x", 1)]
    assert stage.file_name() == "tbl_v.k--t" and BinnedDataframe("t", binning=BINS).file_name() == "tbl_dataset.v--t"
    assert len(rows(BinnedDataframe("t", binning=[*BINS, {"in": "k"}], dataset_col=False), ctx)) == 8


def test_count_skips_nan_of_the_first_column(ctx):
    assert rows(BinnedDataframe("t", binning=[{"in": "w * 0", "bins": None, "out": "z"}, {"in": "k"}], dataset_col=False, observed=True), ctx) == [(0.0, "x", 3)]


def test_plan_is_one_exchange_without_python(ctx, spark):
    plan = BinnedDataframe("t", binning=BINS, weights="w", observed=True).sparse(ctx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Python" not in plan


def test_skim(ctx):
    got = EventByEventDataframe("s", collections=["v", "k"], mask="w > 1").collect(ctx)
    assert got.columns == ["dataset", "v", "k"] and got.count() == 4
    assert EventByEventDataframe("s", collections="v", flatten=False).collect(ctx).count() == 4


def test_dense_bins_of_datasets_without_binned_events(spark):
    """Empty arrays and failed events leave a dataset its bins, from one scan; categories multiply up to a limit."""
    rows_ = [("mc1", "mc", True, [1.0], "k"), ("mc2", "mc", True, [], "k"), ("mc3", "mc", False, [2.0], "l"), ("data", "data", True, None, "l")]
    ctx = Context(spark.createDataFrame(rows_, "dataset string, eventtype string, __alive boolean, v array<double>, cat string"))
    table = BinnedDataframe("t", binning=[{"in": "v", "bins": {"edges": [0, 5]}}], weights="v")
    got = {(r[0], r[1]): tuple(r[2:]) for r in table.collect(ctx).collect()}
    assert len(got) == 12 and got["mc1", "[0.0, 5.0)"] == (1, 1.0, 1.0) and got["mc2", "[0.0, 5.0)"] == got["mc3", "[0.0, 5.0)"] == (0, 0.0, 0.0) and got["data", "[0.0, 5.0)"] == (0, None, None)
    assert table.collect(ctx)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    both = BinnedDataframe("t", binning=[{"in": "cat"}, {"in": "v", "bins": {"edges": [0, 5]}}])
    assert [tuple(r) for r in both.collect(ctx).where("n > 0").collect()] == [("mc1", "k", "[0.0, 5.0)", 1)] and both.collect(ctx).count() == 3
