"""Size-tiered sharding with a versioned manifest, in DataFrame operations only.

Arrivals are appended as small immutable Parquet shards, one for each input partition and without a shuffle. Compaction
looks at sizes alone: shards of a similar size (one tier: a power of ``FAN_IN``) are merged once there are ``FAN_IN`` of
them or enough for a file of the target size. A merge reads its shards in one task and writes one file; many merges are
one job. A new version of the table exists from the moment its manifest is renamed to its final name, which only one
writer can do; readers of older versions keep their shards until ``vacuum``.
"""

from __future__ import annotations

import functools
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Merges that one Spark job makes.
MERGES_PER_JOB = 64


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardedTable:
    """A table of immutable shards under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` and ``shards`` (name, bytes) of a version, the last unless told."""
        held = self.versions()
        if not held:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version or held[-1]:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, schema: dict, shards: list[dict]) -> dict:
        """Writes the manifest after ``base`` under a passing name and renames it; fails if that version exists."""
        made = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["name"])}
        draft, final = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{made['version']:010d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {made['version']} exists")
        return made

    def _written(self, df: DataFrame) -> list[dict]:
        """Writes a frame into a new folder; its shards' names below the root and their sizes."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        found = self.fs.listStatus(self._path(f"{self.root}/{folder}"))
        return [{"name": f"{folder}/{s.getPath().getName()}", "bytes": int(s.getLen())} for s in found if s.getPath().getName().startswith("part-")]

    def append(self, df: DataFrame) -> dict:
        """One small shard for each partition of the arrivals, then a new version."""
        base = self.manifest()
        schema = json.loads(df.schema.json())
        if base["schema"] not in (None, schema):
            raise ValueError("the arrivals' schema is not the table's")
        return self.commit(base, schema, base["shards"] + self._written(df))

    def tier(self, size: int) -> int:
        return int(math.log(max(1, size), self.fan_in))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Which shards to merge: runs of one tier, packed up to the target size; full files are left alone."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        merges = []
        for _, held in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(held, key=lambda s: (-s["bytes"], s["name"])):
                if run and size + s["bytes"] > self.target:
                    merges.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= self.fan_in or (len(run) > 1 and size >= self.target // 2):
                merges.append(run)
        return [m for m in merges if len(m) > 1]

    def compact(self) -> dict:
        """Merges until no tier has a run left; each round is one version. Shards that a reader holds stay in place."""
        now = self.manifest()
        while merges := self.plan(now["shards"]):
            gone = {s["name"] for m in merges for s in m}
            made = []
            for at in range(0, len(merges), MERGES_PER_JOB):
                frames = [self._frame(m, now["schema"]).coalesce(1) for m in merges[at : at + MERGES_PER_JOB]]
                made += self._written(functools.reduce(DataFrame.unionAll, frames))
            now = self.commit(now, now["schema"], [s for s in now["shards"] if s["name"] not in gone] + made)
        return now

    def _frame(self, shards: list[dict], schema: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(schema)).parquet(*[f"{self.root}/{s['name']}" for s in shards])

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; ``shard`` names a column to hold each row's shard."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError("the table has no version yet")
        df = self._frame(held["shards"], held["schema"])
        return df.withColumn(shard, F.element_at(F.split(F.input_file_name(), "/"), -1)) if shard else df

    def vacuum(self) -> int:
        """Deletes the shards that the last version does not name; returns how many."""
        keep, gone = {s["name"] for s in self.manifest()["shards"]}, 0
        for folder in self.fs.listStatus(self._path(f"{self.root}/data")):
            for s in self.fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if s.getPath().getName().startswith("part-") and name not in keep:
                    gone += bool(self.fs.delete(s.getPath(), False))
        return gone


def shard(df: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> ShardedTable:
    """Appends all rows, compacts and drops what no version needs; returns the table.

    Rows are kept as they are: nulls, repeated rows, any columns. An empty table becomes shards without rows.
    """
    spark = df.sparkSession
    table = ShardedTable(spark, root or fresh_path(spark, "shards"), target_bytes)
    table.append(df)
    table.compact()
    table.vacuum()
    return table


def contents(df: DataFrame, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """What the last version holds: ``keep``, the text's bytes and SHA-256 (null for null), read through the manifest."""
    held = shard(df).read()
    return held.select(keep, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.col(text).cast("binary"), 256).alias("text_sha256"))


#: The same rows straight from the table.
SQL = "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
