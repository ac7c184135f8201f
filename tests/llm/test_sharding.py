import pytest

from eventloom.llm.common import fresh_path
from eventloom.llm.sharding import Conflict, ShardedTable, contents, shard


def rows(df):
    return sorted(map(str, df.collect()))


def test_versions_and_tiers(spark, some):
    table = ShardedTable(spark, fresh_path(spark, "t"), target_bytes=200_000, fan_in=3)
    parts = some.randomSplit([1.0] * 7, 1)
    for p in parts:
        table.append(p.coalesce(1))
    before = table.manifest()
    assert before["version"] == 7 and len(before["shards"]) == 7
    after = table.compact()
    assert after["version"] > 7 and len(after["shards"]) < 7
    assert rows(table.read()) == rows(some) and rows(table.read(7)) == rows(some)
    assert table.read(3).count() == sum(p.count() for p in parts[:3])
    assert table.plan(after["shards"]) == [] and table.vacuum() >= 3
    assert rows(table.read()) == rows(some)
    assert table.read(shard="_shard").select("_shard").distinct().count() == len(after["shards"])


def test_plan():
    table = ShardedTable.__new__(ShardedTable)
    table.target, table.fan_in = 1000, 4
    sized = lambda *sizes: [{"name": str(i), "bytes": s} for i, s in enumerate(sizes)]
    assert table.plan(sized(990, 600, 10, 11)) == []
    assert [len(m) for m in table.plan(sized(20, 21, 22, 23))] == [4]
    assert [sum(s["bytes"] for s in m) for m in table.plan(sized(*[300] * 7))] == [900, 900]


def test_only_one_writer_commits(spark, some):
    table = ShardedTable(spark, fresh_path(spark, "t"))
    base = table.append(some.limit(3))
    table.commit(base, base["schema"], base["shards"])
    with pytest.raises(Conflict):
        table.commit(base, base["schema"], base["shards"])
    with pytest.raises(ValueError, match="schema"):
        table.append(some.select("doc_id"))


def test_odd(odd, none, spark):
    assert rows(shard(odd, target_bytes=1 << 20).read()) == rows(odd)
    assert shard(none).read().count() == contents(none).count() == 0
    with pytest.raises(ValueError, match="no version"):
        ShardedTable(spark, fresh_path(spark, "t")).read()
