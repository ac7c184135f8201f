import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.operators.base import events
from eventloom.operators.cutflow import BadCutflow, CutFlow, SelectPhaseSpace, parse_selection

ANY = {"Any": ["NMuon > 1", "NElectron > 1", "NJet > 1"]}


@pytest.fixture(scope="module")
def flat(spark):
    rows = zip(*[x.tolist() for x in (np.linspace(0, 5, 101), np.linspace(0, 10, 101), np.linspace(2, -18, 101))], strict=True)
    return events(spark.createDataFrame(list(rows), "NMuon double, NElectron double, NJet double"))


def table(stage, ctx):
    return [r.asDict() for r in stage.collect(ctx).collect()]


def test_goldens(flat):
    assert CutFlow("c", selection="NMuon > 1").apply(flat).df.where("__alive").selectExpr("count(*)", "min(NMuon)", "max(NMuon)").first() == (80, 1.05, 5.0)
    assert CutFlow("c", selection=ANY).apply(flat).df.where("__alive").count() == 95
    rows = table(CutFlow("c", selection={"All": ["NMuon > 1", ANY]}, keep_unique_id=True), flat)
    assert [(r["unique_id"], r["depth"], r["cut"], r["passed_incl_unweighted"]) for r in rows] == [("0", 0, "All", 80), ("0,0", 1, "NMuon > 1", 80), ("0,1", 1, "Any", 80), ("0,1,0", 2, "NMuon > 1", 80), ("0,1,1", 2, "NElectron > 1", 80), ("0,1,2", 2, "NJet > 1", 80)]
    assert [r["totals_incl_unweighted"] for r in rows] == [101, 101, 80, 80, 80, 80]


def test_sequential_totals_count_dropped_events(flat):
    after = CutFlow("a", selection="NMuon > 1").apply(flat)
    row = table(CutFlow("b", selection={"All": ["NMuon > 2"]}, weights="NJet"), after)[1]
    assert row["totals_incl_unweighted"] == 101 and row["passed_incl_unweighted"] == 60
    assert row["totals_incl_NJet"] == pytest.approx(sum(x for m, x in zip(np.linspace(0, 5, 101), np.linspace(2, -18, 101), strict=True) if m > 1))


def test_data_weights_are_counts(flat, spark):
    ctx = events(flat.df.drop("eventtype"), eventtype="data")
    row = table(CutFlow("c", selection="NMuon > 1", weights={"w": "NJet"}), ctx)[0]
    assert row["passed_incl_w"] == row["passed_incl_unweighted"] == 80


def test_phase_space(flat):
    df = SelectPhaseSpace("s", region_name="region", selection="NMuon > 1").apply(flat).df
    assert df.where("region").count() == 80 and df.where("__alive").count() == 101


def test_names_and_errors(flat, tmp_path):
    assert CutFlow("c", selection="NMuon > 1", weights=["a", "b"]).file_name() == "cuts_c-unweighted.a.b.csv"
    path = tmp_path / "s.yml"
    path.write_text("All: ['NMuon > 1']")
    assert CutFlow("c", selection_file=str(path)).selection.children[0].label == "NMuon > 1"
    for config in ({}, {"selection": "a", "selection_file": "b"}, {"selection": "a", "weights": 1}, {"selection": "a", "weights": [1]}):
        with pytest.raises(BadCutflow):
            CutFlow("c", **config)
    with pytest.raises(NotImplementedError):
        CutFlow("c", selection="a", counter=False)
    for bad in ({"Some": []}, 3, {"All": "x"}, {"reduce": 1, "other": "x"}, {"a": 1, "b": 2, "c": 3}):
        with pytest.raises(RuntimeError):
            parse_selection(bad)
    with pytest.raises(BadCutflow):
        CutFlow("c", selection="NMuon + 1").collect(flat)


cuts = st.recursive(st.sampled_from(["a > 0", "b > 0", "c > 0"]), lambda x: st.one_of(st.builds(lambda v: {"All": v}, st.lists(x, min_size=1, max_size=3)), st.builds(lambda v: {"Any": v}, st.lists(x, min_size=1, max_size=3))), max_leaves=6)


def brute(selection, data, current=None, within="or"):
    """The counters by their definition on boolean vectors: (label, only, incl, totals) in order, and the mask."""
    if isinstance(selection, str):
        return [], np.array([r["abc".index(selection[0])] > 0 for r in data])
    how, parts = next(iter(selection.items()))
    ones, rows = np.ones(len(data), bool), []
    mask = ones.copy() if how == "All" else ~ones
    for part in parts:
        if how == "All":
            inner, own = brute(part, data, mask if current is None else mask & current, "and")
            new, before = mask & own, mask
            incl = new
        else:
            inner, own = brute(part, data, current, within)
            new, before = mask | own, ones if current is None else current
            incl = new if current is None else new & current
        label = part if isinstance(part, str) else next(iter(part))
        rows += [(label, own.sum(), incl.sum(), before.sum()), *inner]
        mask = new
    return rows, mask


@settings(max_examples=6, deadline=None)
@given(cuts, st.lists(st.tuples(*[st.integers(0, 1)] * 3), min_size=1, max_size=12))
def test_counters_by_definition(spark, selection, data):
    ctx = events(spark.createDataFrame(data, "a int, b int, c int"))
    got = [(r["cut"], r["passed_only_cut_unweighted"], r["passed_incl_unweighted"], r["totals_incl_unweighted"]) for r in CutFlow("c", selection=selection).collect(ctx).collect()]
    rows, mask = brute(selection, data)
    top = selection if isinstance(selection, str) else next(iter(selection))
    assert got == [(top, mask.sum(), mask.sum(), len(data)), *rows]
