"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the schedule is the golden-ratio point frac(1/2 + i * phi), mapped through the sources' cumulative weights:
any stretch of the schedule holds each source in nearly its share. Slots are ranked per source; rank r takes block
r modulo the source's number of blocks. Blocks are equal stretches of words of the source's documents in an order
shuffled by hash; a document takes the words that its blocks' visits cover.

Ranks and word offsets are running counts within bounded chunks, added to running totals over chunks, so a source with
a third of all rows never meets in one task. The driver sees one row per source.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, packed

WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Words of a block, at most; a source has LEAST_BLOCKS blocks if it has that many words.
BLOCK_WORDS = 1024
LEAST_BLOCKS = 256
#: Slots of a chunk whose ranks are counted in one task.
CHUNK = 1 << 16
#: Documents of a bucket whose offsets are summed in one task, about.
BUCKET_DOCS = 20_000
#: Cells of the unit interval in which slots meet the sources' weights.
CELLS = 4096
#: Slots beyond the planned number, so that no source falls short of its quota.
SPARE = 1.02
SEED = 17


def word_count(text: Column) -> Column:
    """Words of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of all words by weight, each at most ``most`` times its source; what is over goes to the rest by weight."""
    total, left = sum(sizes), sum(sizes)
    open_, found = set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * whole]
        if not full:
            for i in open_:
                found[i] = left * weights[i] / whole
            break
        for i in full:
            found[i] = float(most * sizes[i])
            left -= most * sizes[i]
            open_.discard(i)
    return found if total else [0.0] * len(sizes)


def _phi(power: int) -> float:
    """frac(2 ** power / golden ratio), exact to a double."""
    with localcontext() as c:
        c.prec = 60
        x = (Decimal(5).sqrt() - 1) / 2 * (1 << power)
        return float(x - int(x))


def _point(i: Column) -> Column:
    """frac(1/2 + i / golden ratio), by halves of i so that no product loses the fraction."""
    fraction = lambda x: x - F.floor(x)
    low, high = i.bitwiseAND(F.lit((1 << 20) - 1)).cast("double"), F.shiftright(i, 20).cast("double")
    return fraction(F.lit(0.5) + fraction(low * F.lit(_phi(0))) + fraction(high * F.lit(_phi(20))))


class Plan:
    """One row per source: number, size, target, block length, blocks, quota of slots, cumulative weight."""

    def __init__(self, summary: list) -> None:
        rows = sorted(summary, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
        sizes = [int(r["size"]) for r in rows]
        wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
        self.docs = sum(int(r["docs"]) for r in rows)
        self.rows, at, held = [], 0.0, []
        for r, size, target in zip(rows, sizes, wanted, strict=True):
            block = max(1, min(BLOCK_WORDS, size // LEAST_BLOCKS))
            quota = min(round(target / block), MOST * -(-size // block)) if size else 0
            held.append((r["source"], size, target, block, -(-size // block), quota))
        slots = sum(h[-1] for h in held)
        self.slots = int(slots * SPARE) + 8 * len(held) if slots else 0
        for i, h in enumerate(held):
            end = 1.0 if i == len(held) - 1 else at + (h[-1] / slots if slots else 0.0)
            self.rows.append((i, *h, at, end))
            at = end

    SCHEMA = "number int, source string, source_size long, target double, block long, blocks long, quota long, lo double, hi double"


def schedule(spark, plan: Plan, sources: DataFrame) -> DataFrame:
    """(number, rank) of each slot that counts: its source, and which of the source's slots it is, from 0."""
    slots = spark.range(plan.slots).select("id", _point(F.col("id")).alias("u"))
    cell = lambda x: F.least(F.lit(CELLS - 1), F.floor(x * CELLS)).cast("int")
    weights = sources.where("hi > lo").select("number", "quota", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    drawn = slots.withColumn("cell", cell(F.col("u"))).join(weights, "cell").where("u >= lo and u < hi").select("id", "number", "quota", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("number", "chunk", (F.sum("n").over(W.partitionBy("number").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = drawn.withColumn("own", F.row_number().over(W.partitionBy("chunk", "number").orderBy("id")) - 1)
    return ranked.join(before, ["number", "chunk"]).select("number", (F.col("before") + F.col("own")).alias("rank"), "quota").where("rank < quota").select("number", "rank")


def mix(df: DataFrame, text: str = "text", source: str = "source", keep: str = "doc_id") -> DataFrame:
    """``keep``, ``size``, ``source_size``, ``target`` and ``taken`` of each row; reruns agree.

    Null texts have no words, and documents without words take none. The null source is a source of its own, the last.
    Repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    held = df.select(F.col(keep).alias("_id"), F.col(source).cast("string").alias("_source"), word_count(F.col(text)).alias("_size"), F.xxhash64(F.lit(SEED), F.col(keep), F.col(text)).alias("_by"))
    sized = Written(held, "sized").df
    plan = Plan(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("size"), F.count("*").alias("docs")).collect())
    sources = spark.createDataFrame(plan.rows, Plan.SCHEMA)
    buckets = max(1, -(-plan.docs // BUCKET_DOCS)) * 8
    docs = sized.join(F.broadcast(sources) if len(plan.rows) <= 10_000 else sources, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_bucket", F.floor((F.shiftrightunsigned("_by", 32) / float(1 << 32)) * buckets).cast("int"))
    full = docs.where("_size > 0")
    sums = full.groupBy("number", "_bucket").agg(F.sum("_size").alias("n"))
    before = sums.select("number", "_bucket", (F.sum("n").over(W.partitionBy("number").orderBy("_bucket")) - F.col("n")).alias("before"))
    running = F.sum("_size").over(W.partitionBy("number", "_bucket").orderBy("_by", F.col("_id").asc_nulls_first(), "_size").rowsBetween(W.unboundedPreceding, -1))
    placed = full.withColumn("own", F.coalesce(running, F.lit(0).cast("long"))).join(before, ["number", "_bucket"]).withColumn("first", F.col("before") + F.col("own"))
    pieces = placed.select("number", "first", "_id", "_size", "source_size", "target", "block", "blocks", F.explode(F.sequence(F.expr("first div block"), F.expr("(first + _size - 1) div block"))).alias("piece"))
    visits = schedule(spark, plan, sources).join(F.broadcast(sources.select("number", "blocks")) if len(plan.rows) <= 10_000 else sources.select("number", "blocks"), "number").groupBy("number", (F.col("rank") % F.col("blocks")).alias("piece")).agg(F.count("*").alias("visits"))
    covered = F.least(F.col("first") + F.col("_size"), (F.col("piece") + 1) * F.col("block")) - F.greatest(F.col("first"), F.col("piece") * F.col("block"))
    taken = pieces.join(visits, ["number", "piece"], "left").groupBy("number", "first", "_id", "_size", "source_size", "target").agg(F.sum(covered * F.coalesce("visits", F.lit(0))).alias("taken"))
    none = docs.where("_size = 0").select("_id", "_size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.select("_id", "_size", "source_size", "target", "taken").unionByName(none).select(F.col("_id").alias(keep), F.col("_size").alias("size"), "source_size", "target", "taken")


def repeated(df: DataFrame, text: str = "text", source: str = "source", keep: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as often as the mix takes them: words taken over words held, rounded half up, at most MOST.

    Rows that it takes less than half go. A row is known by 128 bits of its id and text; equal rows count as one
    document of their joint words.
    """
    by = [F.xxhash64(F.lit(1), F.col(keep), F.col(text)).alias("_b1"), F.xxhash64(F.lit(2), F.col(keep), F.col(text)).alias("_b2")]
    keyed = df.select(packed(df), *by)
    rows = df.select(F.struct(*by).alias("_b"), F.col(source), F.col(text))
    taken = mix(rows, text, source, "_b").groupBy("_b").agg(F.sum("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_rows"))
    times = taken.where("_size > 0").select("_b._b1", "_b._b2", F.least(F.lit(MOST) * F.col("_rows"), F.expr("(2 * _taken * _rows + _size) div (2 * _size)")).cast("int").alias("_times")).where("_times > 0")
    once = keyed.join(Written(times, "times").df, ["_b1", "_b2"]).dropDuplicates(["_b1", "_b2"])
    return once.select("_all", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_all.*")
