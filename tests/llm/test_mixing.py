import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import mixing


def filled(sizes, weights):
    """Water-filling by bisection of the level."""
    total, lo, hi = sum(sizes), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(3 * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(filled(sizes, weights), rel=1e-6, abs=1e-3)


def test_documents(some):
    rows = mixing.mix(some.select("*", F.col("source").alias("_source"))).collect()
    source = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in some.collect()}
    assert len(rows) == len(source) and rows == mixing.mix(some).collect() or sorted(rows) == sorted(mixing.mix(some.repartition(5)).collect())
    names = sorted({s for s, _ in source.values()}, key=lambda s: s.encode())
    sizes = [sum(n for s, n in source.values() if s == name) for name in names]
    wanted = dict(zip(names, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n and r["source_size"] == sizes[names.index(s)] and r["target"] == pytest.approx(wanted[s])
        taken[s] += r["taken"]
    assert all(taken[s] == pytest.approx(wanted[s], rel=0.02) for s in names)


def test_schedule_is_even(spark):
    plan = mixing.Plan([{"source": s, "size": n, "docs": 1} for s, n in (("a", 500_000), ("b", 300_000), (None, 70_000))])
    sources = spark.createDataFrame(plan.rows, mixing.Plan.SCHEMA)
    ranks = {}
    for r in mixing.schedule(spark, plan, sources).collect():
        ranks.setdefault(r["number"], []).append(r["rank"])
    for row in plan.rows:
        assert sorted(ranks[row[0]]) == list(range(row[6]))
    assert plan.rows[2][1] is None


def test_hot_source_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    df = spark.range(900).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source", "repeat('w ', cast(id % 50 as int)) as text")
    rows = mixing.mix(df).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and len(rows) == 900
    by = {}
    for r in rows:
        held = by.setdefault(r["target"], [0])
        held[0] += r["taken"]
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(r["size"] for r in rows), rel=0.03)


def test_odd(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(none).count() == mixing.repeated(none).count() == 0
    again = mixing.repeated(odd)
    assert again.columns == odd.columns and again.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6


def test_repeats(some):
    by = F.struct(*[F.xxhash64(F.lit(n), "doc_id", "text").alias(f"_b{n}") for n in (1, 2)]).alias("_b")
    names = {tuple(r["_b"]): r["doc_id"] for r in some.select(by, "doc_id").collect()}
    rows = mixing.mix(some.select(by, "source", "text"), keep="_b").collect()
    want = {names[tuple(r["_b"])]: min(3, (2 * r["taken"] + r["size"]) // (2 * r["size"])) for r in rows if r["size"]}
    got = {r["doc_id"]: r["count"] for r in mixing.repeated(some).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
