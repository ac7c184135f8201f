import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from eventloom.__main__ import help_stages, main
from eventloom.operators.base import Stage, events
from eventloom.operators.binned import BinnedDataframe
from eventloom.operators.define import Define
from eventloom.plans.runner import run
from eventloom.plans.sequence import BadSequence, build
from eventloom.sources.datasets import Dataset, as_events, get_source, read_datasets, register_source, row_range, unregister_source
from eventloom.sources.sinks import formats, write_table
from eventloom.streaming.tables import start_table


class Scaled(Stage):
    """A user's stage."""

    def __init__(self, name, out_dir, factor):
        super().__init__(name, out_dir)
        self.factor = factor

    def apply(self, ctx):
        return ctx.with_column("scaled", F.col("x") * self.factor)

    def collect(self, ctx):
        return ctx.df.groupBy("dataset").agg(F.count("*").alias("events"))


@pytest.fixture
def book(spark, tmp_path):
    spark.createDataFrame([(float(i), [float(i)] * (i % 3)) for i in range(10)], "x double, v array<double>").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(1.0, "k")], "x double, extra string").write.json(str(tmp_path / "two"))
    (tmp_path / "more.yml").write_text("datasets:\n - {name: two, files: '{this_dir}/two', eventtype: data, format: json}\n")
    (tmp_path / "data.yml").write_text("import: ['{this_dir}/more.yml']\ndefaults: {eventtype: mc}\ndatasets:\n - {name: one, files: [one], aliases: {y: x}}\n")
    (tmp_path / "tail.yml").write_text("stages:\n - skim: EventByEventDataframe\nskim: {collections: [x, twice]}\n")
    (tmp_path / "seq.yml").write_text(
        "stages:\n - vars: Define\n - mine: tests.test_runs.Scaled\n - cuts: some.other.package.CutFlow\n - table: BinnedDataframe\n - hist: BuildAghast\n - IMPORT: '{this_dir}/tail.yml'\n"
        "vars: {variables: [{twice: 'y * 2'}]}\nmine: {factor: 3}\ncuts: {selection: {All: ['x > 0']}, weights: x}\n"
        "table: {binning: [{in: twice, bins: {nbins: 2, low: 0, high: 10}}], file_format: [csv, .parquet, {extension: .json, orient: records}, nonsense]}\nhist: {binning: [{in: scaled, bins: {edges: [0, 5]}}]}\n"
    )
    return tmp_path


def test_books(spark, book):
    two, one = read_datasets(str(book / "data.yml"))
    assert (two.name, two.eventtype, one.aliases) == ("two", "data", {"y": "x"})
    ctx = as_events(spark, [two, one])
    assert ctx.df.count() == 11 and ctx.df.where("dataset = 'two'").select("v", "extra", "eventtype").first() == (None, "k", "data")
    assert as_events(spark, [one], most=4).df.count() == 4
    with pytest.raises(ValueError, match="no source"):
        get_source("nope")
    with pytest.raises(RuntimeError, match="does not exist"):
        get_source("csv", "/no/such.yml")


def test_own_source(spark):
    class Fixed:
        def open(self, spark, paths):
            return spark.range(len(paths)).withColumnRenamed("id", "x")

    register_source("fixed", Fixed)
    assert as_events(spark, [Dataset("d", ["a", "b"], format="fixed")]).df.count() == 2
    unregister_source("fixed")


def test_row_range(spark):
    df = spark.range(10)
    assert [row_range(df, "id", *r).count() for r in ((0, -1), (0, 4), (3, 5), (8, -1))] == [10, 4, 2, 2]


def test_command_line(spark, book, capsys):
    out = book / "out"
    assert main([str(book / "data.yml"), str(book / "seq.yml"), "--outdir", str(out)]) == 0
    made = set(os.listdir(out))
    assert {"cuts_cuts-unweighted.x.csv", "tbl_dataset.twice--table.csv", "tbl_dataset.twice--table.parquet", "tbl_dataset.twice--table.json", "tbl_dataset.scaled--hist.csv", "tbl_dataset.scaled--hist.axes.json", "df_skim", "book-keeping.tar.gz", "mine.csv"} <= made
    assert "cannot write" in capsys.readouterr().out
    assert sorted(tarfile.open(out / "book-keeping.tar.gz").getnames()) == ["datasets.yml", "metadata.yml", "sequence.yml"]
    assert json.loads((out / "tbl_dataset.scaled--hist.axes.json").read_text())["axes"][1]["edges"] == [0.0, 5.0]
    assert spark.read.parquet(str(out / "df_skim")).count() == 10
    assert "[0.0, 5.0)" in (out / "tbl_dataset.twice--table.csv").read_text()


def test_help():
    assert "CutFlow" in help_stages("", False) and "Later ones see" in help_stages("Define", True)


@pytest.mark.parametrize("config", [{}, {"stages": ["x"]}, {"stages": [{"a": "Nope"}]}, {"stages": [{"a": "no.such.Nope"}]}, {"stages": [{"a": "os.Nope"}]}, {"stages": [{"a": "Define"}], "a": {"wrong": 1}}, {"stages": [{"a": "Define"}], "a": []}, {"stages": [{"a": "Define"}, {"a": "Define"}]}])
def test_bad_sequences(config):
    with pytest.raises(BadSequence):
        build(config)


def test_formats_are_not_used_up(spark, tmp_path):
    config = {"extension": "csv", "sep": ";"}
    table = spark.createDataFrame([(1, 0.1)], "a int, b double")
    for _ in range(2):
        (path,) = write_table(table, str(tmp_path), "t", config)
        assert open(path).read() == "a;b\n1;0.1\n"
    assert formats(None) == [{"extension": ".csv", "float_format": "%.17g"}]


def test_empty_events(spark):
    ctx = events(spark.createDataFrame([], "x double, v array<double>"))
    got = run(build({"stages": [{"c": "CutFlow"}, {"t": "BinnedDataframe"}], "c": {"selection": "x > 1"}, "t": {"binning": [{"in": "v", "bins": {"edges": [0, 1]}}]}}), ctx)
    assert [t.count() for t in got.values()] == [0, 0]


def test_streaming_table(spark, tmp_path):
    schema = "dataset string, eventtype string, x double"
    for n in range(2):
        spark.createDataFrame([("d", "mc", float(n)), ("d", "mc", 5.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    table = BinnedDataframe("t", binning=[{"in": "y", "bins": {"edges": [0, 4]}}])
    query = start_table([Define("d", variables=[{"y": "x * 1.0"}])], table, events(stream), lambda df, number: seen.append([tuple(r) for r in df.collect()]), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen[-1] == [("d", "[0.0, 4.0)", 2), ("d", "[4.0, inf)", 2)]


def test_aliases_of_each_dataset(spark, tmp_path):
    """A name may stand for another column in each dataset."""
    spark.createDataFrame([(1.0, 5.0)], "a_pt double, m double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2.0, 6.0)], "b_pt double, m double").write.parquet(str(tmp_path / "b"))
    books = [Dataset("A", [str(tmp_path / "a")], aliases={"pt": "a_pt", "mass": "m"}), Dataset("B", [str(tmp_path / "b")], aliases={"pt": "b_pt", "mass": "m"})]
    ctx = Define("d", variables=[{"out": "pt * 2 + mass"}]).apply(as_events(spark, books))
    assert {r["dataset"]: r["out"] for r in ctx.df.select("dataset", "out").collect()} == {"A": 7.0, "B": 10.0}
    with pytest.raises(ValueError, match="as well as aliases"):
        as_events(spark, [books[0], Dataset("C", [str(tmp_path / "a")], aliases={"m": "a_pt"})])


def test_failed_tables_raise(spark, tmp_path, monkeypatch):
    from eventloom.sources import sinks

    table = spark.createDataFrame([(1, 0.1), (2, 0.2)], "a int, b double")
    with pytest.raises(TypeError):
        write_table(table, str(tmp_path), "t", {"extension": "csv", "no_such_option": 1})
    monkeypatch.setattr(sinks, "MOST_ROWS", 1)
    with pytest.raises(ValueError, match="more than 1 rows"):
        write_table(table, str(tmp_path), "t", "csv")


def test_tables_from_one_copy_of_the_events(spark, book, tmp_path):
    """Tables of stages that keep rows read the copy, later ones the source; the rows are the same."""
    config = {
        "stages": [{"vars": "Define"}, {"cuts": "CutFlow"}, {"more": "Define"}, {"table": "BinnedDataframe"}, {"tight": "CutFlow"}, {"skim": "EventByEventDataframe"}, {"mine": "tests.test_runs.Scaled"}, {"last": "BinnedDataframe"}],
        "vars": {"variables": [{"twice": "y * 2"}]}, "cuts": {"selection": {"All": ["x > 0", "x < 9"]}, "weights": "twice"}, "more": {"variables": [{"half": "x / 2"}]},
        "table": {"binning": [{"in": "half", "bins": {"edges": [0, 2]}}]}, "tight": {"selection": "half > 2"}, "skim": {"collections": ["x", "half"]},
        "mine": {"factor": 3}, "last": {"binning": [{"in": "scaled", "bins": {"edges": [0, 5]}}]},
    }
    ctx = as_events(spark, [d for d in read_datasets(str(book / "data.yml")) if d.name == "one"])
    plain, shared = run(build(config), ctx), run(build(config), ctx, shared=str(tmp_path / "copies"))
    assert list(plain) == list(shared) == ["cuts", "table", "tight", "skim", "mine", "last"]
    for name, table in plain.items():
        assert sorted(map(repr, shared[name].collect())) == sorted(map(repr, table.collect()))
    copied = {name: all("/copies/" in f for f in table.inputFiles()) for name, table in shared.items()}
    assert copied == {"cuts": True, "table": True, "tight": True, "skim": True, "mine": False, "last": False}
    assert len(os.listdir(tmp_path / "copies")) == 1
    run(build(config, str(tmp_path / "out")), ctx, write=True, shared=str(tmp_path / "copies2"))
    assert not os.listdir(tmp_path / "copies2") and "tbl_dataset.half--table.csv" in os.listdir(tmp_path / "out")


def test_row_ranges_and_blocks_of_a_book(spark, book, tmp_path):
    (book / "rows.yml").write_text("datasets:\n - {name: one, files: [one], rows: {column: x, start: 2, stop: 5}}\n")
    assert sorted(r.x for r in as_events(spark, read_datasets(str(book / "rows.yml"))).df.collect()) == [2.0, 3.0, 4.0]
    (book / "bad.yml").write_text("datasets:\n - {name: one, files: [one], rows: 3}\n")
    with pytest.raises(ValueError, match="rows are a column"):
        read_datasets(str(book / "bad.yml"))
    (book / "few.yml").write_text("stages:\n - skim: EventByEventDataframe\nskim: {collections: [x]}\n")
    for options, most in ((["--nblocks-per-dataset", "2", "--nblocks-per-sample", "3"], 5), (["--nblocks-per-dataset", "0"], 11)):
        assert main([str(book / "data.yml"), str(book / "few.yml"), "--outdir", str(tmp_path / "few"), "--blocksize", "2", *options]) == 0
        assert spark.read.parquet(str(tmp_path / "few" / "df_skim")).count() == most
