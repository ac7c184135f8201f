"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) on DataFrames.

A node's neighbours are never gathered: each step takes minima by partial aggregation and joins them back, so a star
with millions of rays costs rows, not memory. Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node that can be reached.

    Nodes are of one orderable type. Edges with a null end and loops are ignored; no edges give no rows.
    """
    now = Written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = _mark(now.df)
    while mark[0]:
        then = Written(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now, before = then, mark
        mark = _mark(now.df)
        if mark == before:
            break
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(now.df.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
