"""Nearest neighbours by inner product, by collision-counting hashing (the query-aware form of LSH).

Vectors are indexed in blocks, and in a block by ranges of norms. A range adds one coordinate to its vectors, so that all
have its largest norm and the largest inner product is the smallest distance; norms that differ much would make most of
that coordinate and little of the vectors. It keeps, for each of ``PROJECTIONS`` random directions, its vectors
sorted by projection. A query, scaled to the same norm, opens a window around its own projection in every sorted array;
virtual rehashing widens all windows by ``GROWTH`` at a time, and only the newly covered stretches are counted. Vectors
with at least ``THRESHOLD`` of the projections colliding are verified by their exact inner product.

A range is done once as many of its vectors are verified as its index was fitted to need: ``SAMPLE`` of its own vectors,
spread evenly, are searched for, and the number found when each of their true k nearest reaches the threshold is noted;
the number that REACHED of them stay under is the range's. It depends on the dimension and on how the vectors lie: few
where there are clusters, most of the range where directions are unrelated, as nothing is much nearer than the rest
there. Ranges too small for that are verified whole; those whose norms are too small for a query's k best are left out.

Queries meet blocks as blocks of queries: a task is given a block of vectors once and all blocks of queries after it;
each pair of blocks gives at most ``k`` rows a query. Every vector is indexed, and no bucket has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, bounded_batches, integer_id

#: Vectors of a block, and queries of a block, at most.
BLOCK = 8192
QUERIES = 512
PROJECTIONS = 64
THRESHOLD = 0.6
#: Vectors of a range that its index is fitted on, and the share of their nearest that must have been found.
SAMPLE = 24
REACHED = 0.93
#: A range of which such a share would have to be verified is verified whole: counting would cost more than it saves.
WHOLE = 0.8
START = 0.95
GROWTH = 1.06
SEED = 5
#: Blocks whose numbers (12 bytes each) are broadcast; more are joined by dimension.
BROADCAST_BLOCKS = 1 << 20
#: The smallest norm of a range is at least this share of its largest.
NORMS = 0.9


class Block:
    """The indexes of a block's ranges of norms, largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        at, self.ranges = 0, []
        while at < len(order):
            end = int(np.searchsorted(-norms[order], -NORMS * norms[order[at]], "right"))
            self.ranges.append(Index(ids[order[at:end]], vectors[order[at:end]]))
            at = end

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``Index.search``, of all ranges. A query leaves out those that cannot have a product as large as its k-th."""
        best = [(np.empty(0, np.int64), np.empty(0))] * len(own)
        lengths = np.sqrt((queries**2).sum(axis=1))
        for index in self.ranges:
            reach = index.norm * lengths * (1 + 1e-9)
            asked = [q for q, (ids, scores) in enumerate(best) if len(ids) < k or scores[-1] <= reach[q]]
            if not asked:
                break
            for q, (ids, scores) in zip(asked, index.search(own[asked], queries[asked], k), strict=True):
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                first = np.lexsort((ids, -scores))[:k]
                best[q] = ids[first], scores[first]
        return best


class Index:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.norm = float(norms.max())
        rest = np.sqrt(np.maximum(self.norm**2 - norms**2, 0.0))
        self.directions = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        projected = (self.vectors @ self.directions[:, :-1].T + rest[:, None] * self.directions[:, -1]).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

        self.wants: dict[int, int] = {}

    def _widen(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, vectors over the threshold) again and again, all queries in step, so that window ends are looked up
        for all of them at once; what is sent back says whether that query goes on."""
        n = len(self.ids)
        centres = (queries * (self.norm / np.sqrt((queries**2).sum(axis=1)))[:, None]) @ self.directions[:, :-1].T
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        counts = np.zeros((len(queries), n), np.int16)
        waiting, half = np.arange(len(queries)), START * self.norm
        low = high = None
        while len(waiting):
            centre = centres[waiting]
            to_low = np.stack([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centre.T, strict=True)], axis=1)
            to_high = np.stack([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centre.T, strict=True)], axis=1)
            still = np.ones(len(waiting), bool)
            for i, q in enumerate(waiting.tolist()):
                below, above = to_low[i].tolist(), to_high[i].tolist()
                if low is None:
                    new = [o[a:b] for o, a, b in zip(self.order, below, above, strict=True)]
                else:
                    new = [o[a:b] for o, a, b in zip(self.order, below, low[i].tolist(), strict=True)] + [o[a:b] for o, a, b in zip(self.order, high[i].tolist(), above, strict=True)]
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                still[i] = yield q, np.nonzero(counts[q] >= need)[0]
            waiting, low, high, half = waiting[still], to_low[still], to_high[still], half * GROWTH

    def want(self, k: int) -> int:
        """How many of the vectors have to be verified for a query's k nearest."""
        n = len(self.ids)
        if n <= 10 * k:
            return n
        if k not in self.wants:
            rows = np.unique(np.linspace(0, n - 1, SAMPLE).astype(np.int64))
            products = self.vectors[rows] @ self.vectors.T
            products[np.arange(len(rows)), rows] = -np.inf
            nearest = np.argpartition(-products, k, axis=1)[:, :k]
            reached = np.full(nearest.shape, n)
            steps = self._widen(self.vectors[rows])
            more = None
            while True:
                try:
                    q, found = steps.send(more)
                except StopIteration:
                    break
                here = np.isin(nearest[q], found, assume_unique=True) & (reached[q] == n)
                reached[q, here] = len(found)
                more = len(found) < n and bool((reached[q] == n).any())
            self.wants[k] = min(n, int(np.quantile(reached, REACHED, method="higher")) + 1)
        return self.wants[k]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the k best verified vectors but its own, best first, ties to the
        smaller id."""
        n, queries, want = len(self.ids), queries.astype(np.float64), self.want(k)
        if want >= WHOLE * n:
            return [self._verify(np.arange(n), int(i), q, k) for i, q in zip(own, queries, strict=True)]
        done: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)
        steps, more = self._widen(queries), None
        while True:
            try:
                q, found = steps.send(more)
            except StopIteration:
                return done
            more = len(found) < want
            if not more:
                done[q] = self._verify(found, int(own[q]), queries[q], k)

    def _verify(self, found: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the candidates. A fast product drops those that are surely worse; the rest is scored one row at a
        time, so that equal vectors have equal scores to the bit."""
        found = found[self.ids[found] != own]
        if len(found) > k:
            rough = self.vectors[found] @ query
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            found = found[rough >= edge - 1e-9 * self.norm * np.sqrt((query**2).sum())]
        scores = np.einsum("ij,j->i", self.vectors[found], query)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def _valid(df: DataFrame, vector: str, keep: str) -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero: ``_id``, ``_v`` (doubles)."""
    held = df.select(F.col(keep).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return held.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)).where(F.coalesce(finite, F.lit(False)) & F.exists("_v", lambda x: x != 0))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Packs rows into blocks of one dimension each: (dim, ids, vectors) as little-endian binaries; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            for i in range(len(ids)):
                vector = flat[ends[i] : ends[i + 1]]
                held.setdefault(len(vector), []).append((ids[i], vector))
                if len(held[len(vector)]) >= most:
                    yield packed(len(vector))
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary")


def search(df: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", keep: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: each query's k nearest rows of ``df`` that were found.

    A query's own row (every row with its id) is no candidate. Ids or vectors that are null, vectors that are empty,
    zero or hold a null or non-finite component take no part; vectors of other dimensions than the query's neither.
    Ids are integers; other columns are ignored.
    A repeated query row is one query. Fewer candidates give fewer rows; an empty table gives none.
    """
    spark = df.sparkSession
    for table in (df, queries):
        integer_id(table, keep)
    bounded_batches(spark)
    numbered = Written(_blocks(_valid(df, vector, keep), BLOCK).withColumn("block", F.monotonically_increasing_id()), "ann-blocks").df
    places = numbered.select("dim", "block")
    count = places.count()
    asked = Written(_blocks(_valid(queries, vector, keep).dropDuplicates(["_id"]), QUERIES), "ann-queries").df
    # A task gets each block of vectors once, and the blocks of queries of its dimension after it.
    to = asked.join(F.broadcast(places) if count <= BROADCAST_BLOCKS else places, "dim").select("block", F.lit(1).alias("role"), "dim", "ids", "vectors")
    both = numbered.select("block", F.lit(0).alias("role"), "dim", "ids", "vectors").unionByName(to)
    dealt = both.repartition(max(1, 2 * count), "block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for at in range(batch.num_rows):
                _, role, dim, ids, vectors = (c[at].as_py() for c in batch.columns)
                held, own = np.frombuffer(vectors, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8")
                if not role:
                    index = Block(own, held)
                    continue
                found = index.search(own, held, k)
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    near = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
