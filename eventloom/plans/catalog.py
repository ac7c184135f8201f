"""Registered queries of the event engine over the star-schema tables, each with the SQL that gives the same rows.

Orders are the events and their line items the jagged arrays. An order's status is its dataset; status O is data, the
others are simulated. ``EventWeight`` is the order's price in units of 100,000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import arrays
from eventloom.operators.base import Context, events
from eventloom.operators.binned import BinnedDataframe, BuildAghast
from eventloom.operators.cutflow import CutFlow, SelectPhaseSpace
from eventloom.operators.define import Define, SystematicWeights
from eventloom.operators.explode import explode_events
from eventloom.operators.skim import EventByEventDataframe
from eventloom.plans.runner import run
from eventloom.sources.datasets import Dataset, as_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ITEMS = ("l_quantity", "l_extendedprice", "l_discount")
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def order_events(spark: SparkSession, sf_dir: str) -> Context:
    """Orders with their line items nested: one shuffle of the items by order, whose arrays one order bounds."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    held = F.array_sort(F.collect_list(F.struct(*ORDER, *[c for c in ITEMS if c not in ORDER])))
    items = read("lineitem").groupBy("l_orderkey").agg(held.alias("items"))
    joined = read("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    arrays = [F.coalesce(F.col(f"items.{c}"), F.array().cast("array<double>")).alias("Item_" + c[2:]) for c in ITEMS]
    weight = (F.col("o_totalprice") / 100000.0).alias("EventWeight")
    base = joined.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", weight, F.coalesce(F.size("items"), F.lit(0)).alias("NItem"), F.struct("o_custkey", F.struct(F.col("o_totalprice").alias("price")).alias("sum")).alias("order"), *arrays)
    return events(base, F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "O", "data").otherwise("mc"))


_BY = ", ".join(ORDER)
EV = f"""WITH li AS (SELECT l_orderkey, list(l_quantity ORDER BY {_BY}) AS q, list(l_extendedprice ORDER BY {_BY}) AS p, list(l_discount ORDER BY {_BY}) AS d FROM lineitem GROUP BY l_orderkey),
ev AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderstatus AS dataset, CASE WHEN o_orderstatus = 'O' THEN 'data' ELSE 'mc' END AS eventtype, o_totalprice / 100000.0 AS w,
coalesce(len(q), 0)::INTEGER AS n, coalesce(q, []::DOUBLE[]) AS q, coalesce(p, []::DOUBLE[]) AS p, coalesce(d, []::DOUBLE[]) AS d FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
it AS (SELECT e.*, i - 1 AS pos, q[i] AS qi, p[i] AS pr, d[i] AS di FROM (SELECT ev.*, unnest(range(1, len(q) + 1)) AS i FROM ev) e)
"""


def register(name: str, sql: str, base: str = EV) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        ORACLE_SQL[name] = base + sql
        return f

    return put


def _elements(df: DataFrame, name: str, rounded: bool) -> DataFrame:
    value = F.round("value", 6) if rounded else F.col("value")
    return df.select("o_orderkey", F.posexplode(name).alias("pos", "value")).select("o_orderkey", F.col("pos").cast("bigint").alias("pos"), value.alias("value"))


def _define(name: str, sql: str, formula: str | dict, array: bool, rounded: bool = False) -> None:
    """``rounded``: for functions whose last bit may differ between engines; arithmetic is the same to the bit."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Define("define", variables=[{"out": formula}]).apply(order_events(spark, sf_dir)).df
        if array:
            return _elements(df, "out", rounded)
        return df.select("o_orderkey", F.round("out", 6).alias("value") if rounded else F.col("out").alias("value"))

    register(name, sql)(query)


_ITEM = "SELECT o_orderkey, pos::BIGINT AS pos, {} AS value FROM it"
_define("define_elementwise", _ITEM.format("sqrt(pr * pr + qi * qi) * (1 - di)"), "sqrt(Item_extendedprice**2 + Item_quantity**2) * (1 - Item_discount)", True)
_define("define_where_const", _ITEM.format("CASE WHEN qi > 25 THEN pr * pi() ELSE -qi END"), "where(Item_quantity > 25, Item_extendedprice * pi, -Item_quantity)", True)
_define("define_dot_path", "SELECT o_orderkey, o_custkey + o_totalprice / 2 AS value FROM ev", "order.o_custkey + order.sum.price / 2", False)
_define("define_broadcast_scalar", _ITEM.format("pr / o_totalprice"), "Item_extendedprice / o_totalprice", True)
_define("define_masked_elements", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS pos, pr AS value FROM it WHERE qi > 10 AND di > 0.02", {"formula": "Item_extendedprice", "mask": "(Item_quantity > 10) & (Item_discount > 0.02)"}, True)
_define("define_division_by_zero", _ITEM.format("CASE WHEN qi = 20 THEN 'inf'::DOUBLE ELSE pr / (qi - 20) END"), "Item_extendedprice / (Item_quantity - 20)", True)
_define("define_logarithms", _ITEM.format("round(CASE WHEN di = 0 THEN '-inf'::DOUBLE ELSE ln(di) END + ln(1 + qi) + log10(pr), 6)"), "log(Item_discount) + log(1 + Item_quantity) + log10(Item_extendedprice)", True, rounded=True)
_define("define_modulo_power", _ITEM.format("round(qi % 7 + 2.0 ** (qi / 10), 6)"), "Item_quantity % 7 + 2 ** (Item_quantity / 10)", True, rounded=True)
_define("define_boolean_logic", "SELECT o_orderkey, (n > 2 AND NOT (o_totalprice < 100000) OR n = 0) AS value FROM ev", "((NItem > 2) & ~(o_totalprice < 100000)) | (NItem == 0)", False)


@register("define_nested_3d", "SELECT o_orderkey, (pos // 2)::BIGINT AS outer_pos, (pos % 2)::BIGINT AS inner_pos, qi * 2 + qi AS value FROM it")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = order_events(spark, sf_dir)
    pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("Item_quantity") / 2).cast("int") - 1), lambda i: F.slice("Item_quantity", i * 2 + 1, 2))
    ctx = ctx.with_frame(ctx.df.select("*", F.when(F.size("Item_quantity") > 0, pairs).otherwise(F.array().cast("array<array<double>>")).alias("Pairs")))
    df = Define("define", variables=[{"out": "Pairs * 2 + Pairs"}]).apply(ctx).df
    rows = df.select("o_orderkey", F.posexplode("out").alias("outer_pos", "inner"))
    return rows.select("o_orderkey", F.col("outer_pos").cast("bigint").alias("outer_pos"), F.posexplode("inner").alias("inner_pos", "value")).select("o_orderkey", "outer_pos", F.col("inner_pos").cast("bigint").alias("inner_pos"), "value")


def _reduce(name: str, sql: str, how: str | int, formula: str = "Item_extendedprice", **more) -> None:
    _define(name, f"SELECT o_orderkey, {sql} AS value FROM ev", {"formula": formula, "reduce": how, **more}, False, rounded=how in ("sum", "prod"))


_reduce("reduce_nth_pos", "CASE WHEN n > 1 THEN p[2] ELSE 'nan'::DOUBLE END", 1)
_reduce("reduce_nth_neg", "CASE WHEN n = 0 THEN -1.0::DOUBLE ELSE p[greatest(n, 2) - 1] END", -2, fill_missing=-1.0)
_reduce("reduce_nth_bool", "coalesce(q[1] > 20, false)", 0, "Item_quantity > 20", fill_missing=False)
_reduce("reduce_sum", "round(coalesce(list_sum(list_transform(p, lambda x: round(x * 100)::BIGINT)), 0)::BIGINT / 100.0, 6)", "sum")
_reduce("reduce_prod", "round(list_reduce(list_concat([1.0::DOUBLE], list_transform(q, lambda x: x / 10)), lambda a, b: a * b), 6)", "prod", "Item_quantity / 10")
_reduce("reduce_any", "len(list_filter(q, lambda x: x > 49)) > 0", "any", "Item_quantity > 49")
_reduce("reduce_all", "len(list_filter(q, lambda x: x > 5)) = n", "all", "Item_quantity > 5")
_reduce("reduce_count_nonzero", "len(list_filter(d, lambda x: x <> 0))::BIGINT", "count_nonzero", "Item_discount")
_reduce("reduce_count_zero", "len(list_filter(d, lambda x: x = 0))::BIGINT", "count_zero", "Item_discount")
_reduce("reduce_max", "list_max(p)", "max")
_reduce("reduce_min", "list_min(p)", "min")
_reduce("reduce_argmax", "(list_position(p, list_max(p)) - 1)::BIGINT", "argmax")
_reduce("reduce_argmin", "(list_position(p, list_min(p)) - 1)::BIGINT", "argmin")
_reduce("reduce_counts", "n::BIGINT", "counts")
_define("reduce_with_mask", "SELECT o_orderkey, len(list_filter(q, lambda x: x > 30))::BIGINT AS value FROM ev", {"formula": "Item_quantity", "mask": "Item_quantity > 30", "reduce": "counts"}, False)

SYSTEMATICS = {"weights": {"price": {"nominal": "EventWeight", "up": "EventWeight * 1.1", "down": "EventWeight * 0.9"}, "count": {"nominal": "NItem", "up": "NItem + 1", "left": "NItem - 1"}}, "extra_variations": ["left"]}
_SYST = {"nominal": "w * n", "price_up": "(w * 1.1) * n", "price_down": "(w * 0.9) * n", "count_up": "w * (n + 1)", "count_left": "w * (n - 1)"}


@register("systematic_weights", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN eventtype = 'mc' THEN round({v}, 9) END AS weight_{k}" for k, v in _SYST.items()) + " FROM ev")
def _systematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = SystematicWeights("syst", **SYSTEMATICS).apply(order_events(spark, sf_dir)).df
    return df.select("o_orderkey", *[F.round(f"weight_{k}", 9).alias(f"weight_{k}") for k in _SYST])


@register("systematic_weights_data_skipped", "SELECT dataset, count(CASE WHEN eventtype = 'mc' THEN w * n END) AS filled, count(*) AS total FROM ev GROUP BY dataset")
def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = SystematicWeights("syst", **SYSTEMATICS).apply(order_events(spark, sf_dir)).df
    return df.groupBy("dataset").agg(F.count("weight_nominal").alias("filled"), F.count("*").alias("total"))


def _cut_sql(rows: list[tuple[str, int, str, str, str, str]], weight: str | None, alive: str = "true") -> str:
    """Rows of (id, depth, label, only, incl, totals) as conditions."""
    out = []
    for uid, depth, label, *conditions in rows:
        parts = []
        for counter, c in zip(("passed_only_cut", "passed_incl", "totals_incl"), conditions, strict=True):
            parts.append(f"count(*) FILTER ({c}) AS {counter}_unweighted")
            if weight:
                parts.append(f"round(coalesce(sum(CASE WHEN eventtype = 'mc' THEN CASE WHEN {alive} THEN {weight} ELSE 0 END ELSE 1 END) FILTER ({c}), 0), 7) AS {counter}_{weight}")
        text = label.replace("'", "''")
        out.append(f"SELECT dataset, '{uid}' AS unique_id, {depth} AS depth, '{text}' AS cut, {', '.join(parts)} FROM ev GROUP BY dataset")
    return " UNION ALL ".join(out)


def _cut(name: str, selection, rows: list[tuple], weights: str | None = None, before=None, alive: str = "true") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = order_events(spark, sf_dir)
        if before is not None:
            ctx = CutFlow("before", selection=before).apply(ctx)
        if weights:
            ctx = ctx.with_frame(ctx.df.withColumn("w", F.col("EventWeight")))
        table = CutFlow("cuts", selection=selection, weights=weights, keep_unique_id=True).collect(ctx)
        return table.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])

    register(name, _cut_sql(rows, weights, alive))(query)


_A, _B, _C = "n > 2", "o_totalprice > 300000", "len(list_filter(q, lambda x: x > 49)) > 0"
_D = "coalesce(q[1] > 20, false)"
_ANY = {"Any": ["o_totalprice > 300000", {"reduce": "any", "formula": "Item_quantity > 49"}]}
_REDUCED = str({"reduce": "any", "formula": "Item_quantity > 49"})
_cut("cutflow_single", "NItem > 2", [("0", 0, "NItem > 2", _A, _A, "true")])
_cut("cutflow_any", _ANY, [("0", 0, "Any", f"({_B}) OR ({_C})", f"({_B}) OR ({_C})", "true"), ("0,0", 1, "o_totalprice > 300000", _B, _B, "true"), ("0,1", 1, _REDUCED, _C, f"({_B}) OR ({_C})", "true")])
_cut("cutflow_reduce", {"All": [{"reduce": 0, "formula": "Item_quantity > 20"}]}, [("0", 0, "All", _D, _D, "true"), ("0,0", 1, str({"reduce": 0, "formula": "Item_quantity > 20"}), _D, _D, "true")])
_ALL = {"All": ["NItem > 2", _ANY, {"reduce": 0, "formula": "Item_quantity > 20"}]}
_E = f"(({_B}) OR ({_C}))"
_ALL_ROWS = [
    ("0", 0, "All", f"{_A} AND {_E} AND {_D}", f"{_A} AND {_E} AND {_D}", "true"),
    ("0,0", 1, "NItem > 2", _A, _A, "true"),
    ("0,1", 1, "Any", _E, f"{_A} AND {_E}", _A),
    ("0,1,0", 2, "o_totalprice > 300000", _B, f"{_A} AND {_B}", _A),
    ("0,1,1", 2, _REDUCED, _C, f"{_A} AND {_E}", _A),
    ("0,2", 1, str({"reduce": 0, "formula": "Item_quantity > 20"}), _D, f"{_A} AND {_E} AND {_D}", f"{_A} AND {_E}"),
]
_cut("cutflow_all_any", _ALL, _ALL_ROWS)
_cut("cutflow_weighted_mc_data", _ALL, _ALL_ROWS, weights="w")
_F = "o_totalprice > 100000"
_cut("cutflow_sequential", {"All": ["NItem > 2", "NItem > 4"]}, [("0", 0, "All", f"{_F} AND n > 4", f"{_F} AND n > 4", "true"), ("0,0", 1, "NItem > 2", f"{_F} AND n > 2", f"{_F} AND n > 2", "true"), ("0,1", 1, "NItem > 4", f"{_F} AND n > 4", f"{_F} AND n > 4", f"{_F} AND n > 2")], weights="w", before="o_totalprice > 100000", alive=_F)


@register("phase_space_region", f"SELECT o_orderkey, ({_A} AND {_E}) AS region FROM ev")
def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SelectPhaseSpace("region", region_name="region", selection={"All": ["NItem > 2", _ANY]}).apply(order_events(spark, sf_dir)).df.select("o_orderkey", "region")


def _labels(edges: list[float]) -> list[str]:
    return [f"[{a!r}, {b!r})" for a, b in zip(edges, edges[1:], strict=False)]


_INF = float("inf")


def _bin_sql(x: str, edges: list[float]) -> str:
    of = lambda e: "'inf'::DOUBLE" if e == _INF else "'-inf'::DOUBLE" if e == -_INF else f"{e!r}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {x} >= {of(a)} AND {x} < {of(b)} THEN '{label}'" for a, b, label in zip(edges, edges[1:], _labels(edges), strict=False)) + " END"


_W = "CASE WHEN eventtype = 'mc' THEN w END"


def _hist(name: str, config: dict, sql: str, stage: type = BinnedDataframe) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = order_events(spark, sf_dir)
        ctx = ctx.with_frame(ctx.df.withColumn("w", F.col("EventWeight")))
        table = stage(name, **config).collect(ctx)
        rename = {c: c.replace(":", "_") for c in table.columns}
        return table.select(*[F.round(F.col(f"`{c}`"), 4 if c.endswith("2") else 7).alias(r) if "sumw" in c else F.col(f"`{c}`").alias(r) for c, r in rename.items()])

    register(name, sql)(query)


def _sums(weighted: bool) -> str:
    return "count(*) AS n" + (f", round(sum({_W}), 7) AS w_sumw, round(sum(({_W}) * ({_W})), 4) AS w_sumw2" if weighted else "")


_QTY = [-_INF, 0.0, 10.0, 20.0, 30.0, 40.0, 50.0, _INF]
_qty = {"in": "Item_quantity", "out": "qty", "bins": {"nbins": 5, "low": 0, "high": "5*10"}}
_Q = _bin_sql("qi", _QTY)
_hist("hist_regular", {"binning": [{"in": "o_totalprice", "out": "price", "bins": {"nbins": 4, "low": 0, "high": 400000}}], "observed": True}, f"SELECT dataset, {_bin_sql('o_totalprice', [-_INF, 0.0, 100000.0, 200000.0, 300000.0, 400000.0, _INF])} AS price, count(*) AS n FROM ev GROUP BY ALL")
_F32 = [-_INF, 0.0, 0.019999999552965164, 0.05000000074505806, 0.07999999821186066, _INF]
_hist("hist_edges_f32", {"binning": [{"in": "Item_discount", "out": "disc", "bins": {"edges": [0, 0.02, 0.05, 0.08]}}], "observed": True}, f"SELECT dataset, {_bin_sql('di', _F32)} AS disc, count(*) AS n FROM it GROUP BY ALL")
_hist("hist_categorical", {"binning": [{"in": "o_orderpriority", "out": "priority"}], "observed": True}, "SELECT dataset, o_orderpriority AS priority, count(*) AS n FROM ev GROUP BY ALL")
_hist("hist_expression_dim", {"binning": [{"in": "Item_extendedprice * (1 - Item_discount)", "out": "net", "bins": {"edges": [0, 1000, 10000, 50000]}}], "observed": True}, f"SELECT dataset, {_bin_sql('pr * (1 - di)', [-_INF, 0.0, 1000.0, 10000.0, 50000.0, _INF])} AS net, count(*) AS n FROM it GROUP BY ALL")
_hist("hist_jagged", {"binning": [_qty], "observed": True}, f"SELECT dataset, {_Q} AS qty, count(*) AS n FROM it GROUP BY ALL")
_hist("hist_2d", {"binning": [_qty, {"in": "o_orderpriority", "out": "priority"}], "observed": True}, f"SELECT dataset, {_Q} AS qty, o_orderpriority AS priority, count(*) AS n FROM it GROUP BY ALL")
_hist("hist_weighted", {"binning": [_qty], "weights": "w", "observed": True}, f"SELECT dataset, {_Q} AS qty, {_sums(True)} FROM it GROUP BY ALL")
_SPACE = f", spaces AS (SELECT * FROM (SELECT DISTINCT dataset, eventtype FROM ev) CROSS JOIN (SELECT unnest({_labels(_QTY)!r}) AS qty)), hits AS (SELECT dataset, {_Q} AS qty, {_sums(True)} FROM it GROUP BY ALL) "
_hist("hist_dense", {"binning": [_qty], "weights": {"w": "w"}}, _SPACE + "SELECT s.dataset, s.qty, coalesce(n, 0) AS n, CASE WHEN eventtype = 'mc' THEN coalesce(w_sumw, 0) END AS w_sumw, CASE WHEN eventtype = 'mc' THEN coalesce(w_sumw2, 0) END AS w_sumw2 FROM spaces s LEFT JOIN hits h ON s.dataset = h.dataset AND s.qty = h.qty")
_hist("hist_padded", {"binning": [_qty], "weights": ["w"], "pad_missing": True}, _SPACE + "SELECT s.dataset, s.qty, n, w_sumw, w_sumw2 FROM spaces s LEFT JOIN hits h ON s.dataset = h.dataset AND s.qty = h.qty")
_hist("hist_no_dataset", {"binning": [_qty], "weights": "w", "dataset_col": False, "observed": True}, f"SELECT {_Q} AS qty, {_sums(True)} FROM it GROUP BY ALL")
_hist("hist_no_overflow", {"binning": [{**_qty, "bins": {"nbins": 2, "low": 0, "high": 20, "underflow": False, "overflow": False}}], "observed": True}, f"SELECT dataset, {_bin_sql('qi', [0.0, 10.0, 20.0])} AS qty, count(*) AS n FROM it WHERE qi >= 0 AND qi < 20 GROUP BY ALL")
_hist("hist_weight_data", {"binning": [_qty], "weights": "w", "weight_data": True, "observed": True}, f"SELECT dataset, {_Q} AS qty, count(*) AS n, round(sum(w), 7) AS w_sumw, round(sum(w * w), 4) AS w_sumw2 FROM it GROUP BY ALL")
_hist("hist_axes_dense", {"binning": [_qty], "weights": "w"}, _SPACE + "SELECT s.dataset, s.qty, coalesce(n, 0) AS n, coalesce(w_sumw, 0) AS w_sumw, coalesce(w_sumw2, 0) AS w_sumw2 FROM spaces s LEFT JOIN hits h ON s.dataset = h.dataset AND s.qty = h.qty", BuildAghast)


@register("hist_after_cutflow", f"SELECT dataset, {_Q} AS qty, {_sums(True)} FROM it WHERE {_A} AND {_E} GROUP BY ALL")
def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = order_events(spark, sf_dir)
    ctx = CutFlow("cuts", selection={"All": ["NItem > 2", _ANY]}).apply(ctx.with_frame(ctx.df.withColumn("w", F.col("EventWeight"))))
    table = BinnedDataframe("hist", binning=[_qty], weights="w", observed=True).collect(ctx)
    return table.select("dataset", "qty", "n", F.round("`w:sumw`", 7).alias("w_sumw"), F.round("`w:sumw2`", 4).alias("w_sumw2"))


@register("skim_flat", "SELECT dataset, o_orderkey, qi AS Item_quantity, pr AS Item_extendedprice FROM it WHERE n > 2 AND o_totalprice > 200000")
def _skim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = CutFlow("cuts", selection="NItem > 2").apply(order_events(spark, sf_dir))
    return EventByEventDataframe("skim", collections=["o_orderkey", "Item_quantity", "Item_extendedprice"], mask="o_totalprice > 200000").collect(ctx)


@register("skim_nested", "SELECT dataset, o_orderkey, array_to_string(list_transform(q, lambda x: x::BIGINT), ',') AS quantities FROM ev WHERE n > 5")
def _skim_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = CutFlow("cuts", selection="NItem > 5").apply(order_events(spark, sf_dir))
    df = EventByEventDataframe("skim", collections=["o_orderkey", "Item_quantity"], flatten=False).collect(ctx)
    return df.select("dataset", "o_orderkey", F.array_join(F.transform("Item_quantity", lambda x: x.cast("bigint").cast("string")), ",").alias("quantities"))


@register("explode_zip", "SELECT o_orderkey, qi AS Item_quantity, di AS Item_discount, o_orderpriority FROM it")
def _explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_events(order_events(spark, sf_dir).df.select("o_orderkey", "Item_quantity", "Item_discount", "o_orderpriority"))


@register("dataset_union", "SELECT 'first' AS dataset, 'mc' AS eventtype, o_orderkey, o_totalprice, NULL::DOUBLE AS value FROM orders UNION ALL SELECT 'second', 'data', NULL, NULL, value FROM events", "")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = as_events(spark, [Dataset("first", [f"{sf_dir}/orders.parquet"]), Dataset("second", [f"{sf_dir}/events.parquet"], "data")])
    return ctx.df.select("dataset", "eventtype", "o_orderkey", "o_totalprice", "value")


@register("aliases_by_dataset", "SELECT 'first' AS dataset, round(o_totalprice * 2, 6) AS twice FROM orders UNION ALL SELECT 'second', round(value * 2, 6) FROM events", "")
def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = [Dataset("first", [f"{sf_dir}/orders.parquet"], aliases={"size": "o_totalprice"}), Dataset("second", [f"{sf_dir}/events.parquet"], "data", aliases={"size": "value"})]
    ctx = Define("define", variables=[{"twice": "size * 2"}]).apply(as_events(spark, books))
    return ctx.df.select("dataset", F.round("twice", 6).alias("twice"))


@register("dataset_row_range", "SELECT 'part' AS dataset, o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200", "")
def _row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = as_events(spark, [Dataset("part", [f"{sf_dir}/orders.parquet"], rows={"column": "o_orderkey", "start": 100, "stop": 1200})])
    return ctx.df.select("dataset", "o_orderkey", "o_totalprice")


@register("valid_entries", "SELECT 'first' AS dataset, o_orderkey, true AS known FROM orders", "")
def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = as_events(spark, [Dataset("first", [f"{sf_dir}/orders.parquet"]), Dataset("second", [f"{sf_dir}/events.parquet"])])
    known = arrays.valid_entry_mask(ctx.compile("o_totalprice")).column
    return arrays.only_valid_entries(ctx.df, "o_totalprice").select("dataset", "o_orderkey", known.alias("known"))


@register("user_merge", "SELECT dataset, o_orderpriority AS priority, count(*) AS events, max(o_totalprice) AS dearest FROM ev WHERE n > 2 GROUP BY ALL")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Dearest:
        """A user's aggregate: each batch's own table, and the table of those."""

        name, schema = "dearest", "dataset string, priority string, events long, dearest double"

        def needs(self, ctx):
            return ["o_orderpriority", "o_totalprice"]

        def partial(self, batch):
            held = batch.rename(columns={"o_orderpriority": "priority"}).groupby(["dataset", "priority"], as_index=False)
            return held.agg(events=("o_totalprice", "size"), dearest=("o_totalprice", "max"))

        def merge(self, parts):
            return parts.groupBy("dataset", "priority").agg(F.sum("events").alias("events"), F.max("dearest").alias("dearest"))

    return run([CutFlow("cuts", selection="NItem > 2"), Dearest()], order_events(spark, sf_dir))["dearest"]


@register("hist_embedding", "SELECT label::BIGINT AS label, CASE WHEN x < -0.1 THEN '[-inf, -0.10000000149011612)' WHEN x < 0 THEN '[-0.10000000149011612, 0.0)' WHEN x < 0.10000000149011612 THEN '[0.0, 0.10000000149011612)' ELSE '[0.10000000149011612, inf)' END AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL".replace("x < -0.1 ", "x < -0.10000000149011612 "), "")
def _embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = events(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return BinnedDataframe("hist", binning=[{"in": "label"}, {"in": "embedding", "out": "x", "bins": {"edges": [-0.1, 0, 0.1]}}], dataset_col=False, observed=True).collect(ctx)


def _array(name: str, work, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = order_events(spark, sf_dir)
        out = work(ctx.compile("Item_quantity"))
        text = F.array_join(F.transform(out.column, lambda x: F.coalesce(x.cast("bigint").cast("string"), F.lit("null"))), ",")
        return ctx.df.select("o_orderkey", text.alias("value"))

    register(name, f"SELECT o_orderkey, coalesce(array_to_string(list_transform({sql}, lambda x: coalesce((x::BIGINT)::VARCHAR, 'null')), ','), '') AS value FROM ev")(query)


_define("define_hypot", "SELECT o_orderkey, round(sqrt(w * w + n * n), 6) AS value FROM ev", "hypot(EventWeight, NItem)", False, rounded=True)

_array("array_pad", lambda v: arrays.pad(v, 3), "list_resize(q, greatest(n, 3))")
_array("array_fill_none", lambda v: arrays.fill_none(arrays.pad(v, 3), -1), "list_resize(q, greatest(n, 3), -1.0)")
_array("array_values_as_type", lambda v: arrays.values_as_type(v, "int"), "q")
_array("array_flatten", lambda v: arrays.flatten(arrays.Typed(F.array(v.column, v.column), v.kind, 2)), "list_concat(q, q)")
