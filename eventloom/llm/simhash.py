"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into 32-bit segments. Small Hamming balls around each segment's value are enumerated and looked up
in the table of that segment; complete distances are then verified. Everything works on distinct fingerprints, so exact
copies cost one row. A segment value that very many fingerprints share is not paired within its bucket: there the rest
of the fingerprint joins the key, and rows are tied to the smallest of their key (see ``_hot_links``), which finds the
same components with a number of rows in proportion to the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, bounded_batches, integer_id, map_texts, measured_broadcasts, packed, scratch, text_key
from .components import components
from .meeting import BLOBS, bits_for, blob_batch, meet, stretch_blobs

SEED = 42
SEGMENT_BITS = 32
LOW_SEGMENT = (1 << SEGMENT_BITS) - 1

#: Fingerprints of one segment value that are paired with each other; larger buckets go by longer keys.
BUCKET = 32

#: Crowded values that are sent to all tasks; of more, joins choose by what they measure.
FEW_CROWDED = 1 << 16

#: Shingles hashed at once: what a very long text needs of memory beyond itself.
BLOCK = 1 << 15

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.intp)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence if there are fewer; none of no words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    count = len(words) - size + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, count)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set, bit 0 first."""
    total = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), BLOCK):
        held = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.intp)
        held += _PLACES
        total += np.bincount(held.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return total.ravel()


def fingerprint(text: str | None, size: int) -> int:
    hashes = shingle_hashes(text, size)
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint's bits as a signed long) of each row; null and wordless texts have 0."""

    def make() -> Callable:
        return lambda texts: {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))}

    return map_texts(df, make, f"{keep} {df.schema[keep].dataType.simpleString()}, fp long", text, {keep: keep})


def _ball(segment: int) -> Column:
    """The masks that change at most one bit of a segment (0: the low one)."""
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in (0, *(1 << (i + SEGMENT_BITS * segment) for i in range(SEGMENT_BITS)))])


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(LOW_SEGMENT))


def close_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): links that join exactly the 64-bit fingerprints (column ``fp``, distinct) of 2 or fewer differing bits.

    Two differing bits in two segments: the high segment differs in at most one bit, or else the low one in none. So
    the high segments are probed with balls of radius 1, the low ones with balls of radius 0.
    """
    fp = F.col("fp")
    high = fps.select(_high(fp).alias("seg"), "fp")
    low = fps.select(_low(fp).alias("seg"), "fp")
    crowded = lambda t: t.groupBy("seg").count().where(F.col("count") > BUCKET).select("seg")
    few = lambda t: F.broadcast(t) if t.count() <= FEW_CROWDED else t
    hot_high, hot_low = few(Written(crowded(high), "crowded").df), few(Written(crowded(low), "crowded").df)
    probes = fps.select(F.col("fp").alias("a"), F.explode(_ball(1)).alias("mask")).select("a", _high(F.col("a").bitwiseXOR(F.col("mask"))).alias("seg"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    tables = lambda t, hot: t.join(hot, "seg", "left_anti").select("seg", F.col("fp").alias("b"))
    found = probes.join(tables(high, hot_high), "seg").where("a < b").where(near).select("a", "b")
    other = low.select("seg", F.col("fp").alias("a")).join(tables(low, hot_low), "seg").where("a < b").where(near).select("a", "b")
    return found.unionByName(other).unionByName(_hot_links(fps, high, low, hot_high, hot_low, probes)).distinct()


def _hot_links(fps: DataFrame, high: DataFrame, low: DataFrame, hot_high: DataFrame, hot_low: DataFrame, probes: DataFrame) -> DataFrame:
    """The links through crowded segment values.

    A key is a whole fingerprint: a crowded value in one segment, a ball's member in the other. All that have a key are
    one bit from it at most, so two or fewer from each other, and any two that are so close and meet in a crowded value
    have a key in common: each is tied to the smallest of its key, without pairs.
    """
    fp, mask = F.col("fp"), F.col("mask")
    inner = high.join(hot_high, "seg", "left_semi").select("fp", F.explode(_ball(0)).alias("mask")).select(fp.bitwiseXOR(mask).alias("key"), "fp")
    whole = F.shiftleft(F.col("seg"), SEGMENT_BITS).bitwiseOR(_low(F.col("a")))
    outer = probes.join(hot_high, "seg", "left_semi").select(whole.alias("key"), F.col("a").alias("fp"))
    lower = low.join(hot_low, "seg", "left_semi").select("fp", F.explode(_ball(1)).alias("mask")).select(fp.bitwiseXOR(mask).alias("key"), "fp")
    keyed = inner.unionByName(outer).unionByName(lower)
    least = keyed.groupBy("key").agg(F.min("fp").alias("a"))
    return keyed.join(least, "key").where("a < fp").select("a", F.col("fp").alias("b"))


def near_duplicates(df: DataFrame, shingle: int = 3, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """A row for each input row: ``keep``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints of 2 or fewer differing bits are linked; ``component_id`` is the smallest ``keep`` that can be
    reached, the row's own included (null if all of them are null). Null and wordless texts have fingerprint zero and
    are linked like others. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = Written(fingerprints(df, shingle, text, keep).select(F.col(keep).alias("_id"), "fp"), "fingerprints").df
    with measured_broadcasts(df.sparkSession):
        distinct = Written(rows.groupBy("fp").agg(F.min("_id").alias("least")), "distinct").df
        labels = components(close_pairs(distinct.select("fp")))
        labelled = distinct.join(labels, distinct["fp"] == labels["node"]).select("fp", "least", "label")
        lowest = labelled.groupBy("label").agg(F.min("least").alias("lowest"))
        # Written, so that the join of all rows is a join alone, which may be split where a fingerprint has many rows.
        groups = Written(distinct.join(labelled.join(lowest, "label").select("fp", "lowest"), "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id")), "groups").df
    # A row for each fingerprint: too many for the driver, and this join runs under the caller's settings.
    return rows.join(groups.hint("merge"), "fp").select(F.col("_id").alias(keep), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicates by similarity: 64-bit words of a wide fingerprint, members of the ball around each segment that are
#: looked up, the least certain bits that span the ball, and the differing bits from which a pair isn't verified any more
#: (similarity 0.8 makes about 78 of 512 differ, 8 more or less).
WORDS = 8
PROBES = 16
LOOSE_BITS = 7
FARTHEST = 128
SEGMENTS = WORDS * 64 // SEGMENT_BITS

#: Texts whose keys are packed together, and keys for each task that they meet in, about.
STRETCH = 2048
KEYS_A_TASK = 1 << 20

#: Ratio of the classes of numbers of shingles.
GROW = 1.05

_SUBSETS = ((np.arange(1 << LOOSE_BITS)[:, None] >> np.arange(LOOSE_BITS)) & 1).astype(np.float32)


def margins(hashes: np.ndarray) -> np.ndarray:
    """Of distinct shingles: by how much each of the wide fingerprint's bits is more often set than not.

    A word is made of its own remix of the shingles' hashes.
    """
    sums = []
    for k in range(WORDS):
        mixed = hashes * np.uint64(2 * k + 1) if k else hashes
        if k:
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        sums.append(2 * bit_counts(mixed) - len(hashes))
    return np.concatenate(sums)


def ball_keys(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts' margins: the fingerprints' segments, and for each text SEGMENTS * PROBES keys.

    A key stands for a segment and a value in the ball around the text's own. Near copies differ mostly in bits that few
    shingles decide, so the ball is spanned by the least certain bits, and the PROBES likeliest of its members are taken.
    """
    cells = held.reshape(len(held), SEGMENTS, SEGMENT_BITS)
    own = np.packbits(cells > 0, axis=2, bitorder="little").view("<u4")[..., 0]
    size = np.abs(cells)
    loose = np.argsort(size, axis=2, kind="stable")[..., :LOOSE_BITS]
    cost = (np.take_along_axis(size, loose, 2).astype(np.float32) + 0.5) @ _SUBSETS.T
    chosen = np.argsort(cost, axis=2, kind="stable")[..., :PROBES]
    flips = np.zeros(chosen.shape, np.uint32)
    for b in range(LOOSE_BITS):
        flips |= (((chosen >> b) & 1) << loose[..., b : b + 1]).astype(np.uint32)
    keys = (own[..., None] ^ flips).astype(np.uint64) | (np.arange(1, SEGMENTS + 1, dtype=np.uint64) << np.uint64(32))[:, None]
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return own, keys.reshape(len(held), -1)


def _distinct_texts(df: DataFrame, text: str, keep: str) -> DataFrame:
    """Each distinct text: ``_k1``, ``_k2``, ``_id`` (its smallest), ``_t``, and ``node``, a number of its own (ids may be
    repeated): to be written before it is used. Copies spread over tasks, as the id is a key of the join too."""
    rows = df.select(F.col(keep).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"), *text_key(F.col(text)))
    least = Written(rows.groupBy("_k1", "_k2").agg(F.min("_id").alias("_id")), "texts").df.select(F.col("_k1").alias("_l1"), F.col("_k2").alias("_l2"), F.col("_id").alias("_least"))
    once = rows.join(least, (F.col("_k1") == F.col("_l1")) & (F.col("_k2") == F.col("_l2")) & F.col("_id").eqNullSafe(F.col("_least")))
    return once.dropDuplicates(["_k1", "_k2", "_id"]).select(F.monotonically_increasing_id().alias("node"), "_id", "_k1", "_k2", "_t")


def _shared(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(node, seg): the fingerprints of texts with a word; (key, node): each text's keys that another text has too."""
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-texts.count() * SEGMENTS * PROBES // KEYS_A_TASK))
    bits = bits_for(parts)
    bounded_batches(spark)

    def run(batches):
        nodes, held = [], []

        def work() -> pa.RecordBatch:
            owners = np.array(nodes, np.int64)
            own, keys = ball_keys(np.stack(held))
            owner = np.repeat(owners, keys.shape[1])
            return blob_batch([(None, len(nodes), owners.tobytes() + own.tobytes()), *stretch_blobs(keys.ravel(), owner, np.zeros(len(owner), np.int64), bits)])

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(h := np.unique(shingle_hashes(text, shingle))):
                    nodes.append(node)
                    held.append(margins(h))
                if len(nodes) == STRETCH:
                    yield work()
                    nodes, held = [], []
        if nodes:
            yield work()

    def prints(batches):
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seg = np.frombuffer(blob, "<i4", offset=8 * n).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SEGMENTS), pa.array(seg))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, "<i8", n)), lists], names=["node", "seg"])

    blobs = Written(texts.select("node", "_t").mapInArrow(run, BLOBS), "keys")
    signatures = Written(blobs.df.where("bucket is null").select("n", "blob").mapInArrow(prints, "node long, seg array<int>"), "signatures").df
    shared = Written(meet(blobs.df.where("bucket is not null"), parts, True).select("key", F.col("owner").alias("node")), "shared").df
    blobs.drop()
    return signatures, shared


def _led(shared: DataFrame) -> DataFrame:
    """One comparison a text at most: with the most central of the leaders of its keys.

    A key's leader is the member that meets most others over all its keys: where near copies vary one text in ways of
    their own, that is the text itself or what comes nearest to it.
    """
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    central = shared.join(sizes, "key").groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    leaders = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("met", F.col("node").alias("other"))).alias("leader"))
    best = shared.join(leaders, "key").where("node != leader.other").groupBy("node").agg(F.max("leader").alias("leader"))
    return best.select(F.least("node", "leader.other").alias("a"), F.greatest("node", "leader.other").alias("b")).distinct()


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label): all members of the components that meet another one in some key. A component is one entry of a key
    however many members it has there."""
    of = shared.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = of.select("key", "label").distinct()
    both = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    labels = each.join(both, "key", "left_semi").select("label").distinct()
    return of.select("node", "label").distinct().join(labels, "label", "left_semi").select("node", "label")


def _rest(texts: DataFrame, labels: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """A superset of the similar pairs of different labels among the nodes of ``labels``, by prefixes of rare shingles.

    With every text's shingles in one order, the rarest first, the first shingle that two texts share leaves at most what
    follows it to be shared. So it stands at place i <= x - t + 1 of a text of x shingles that must share t with the
    other: (x + y) * similarity / (1 + similarity) or more, y being the other's number. Numbers are told apart by classes
    of GROW, and the larger text looks for smaller ones of each class with the t that the class needs at least. Shingles
    that no other text has take places and need no rows. Texts that look alike but aren't have own shingles there, so
    what meets is in proportion to what is similar.
    """
    asked = texts.join(labels, "node", "left_semi")
    size = asked.agg(F.sum(F.octet_length("_t").cast("long"))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // (6 * KEYS_A_TASK)))
    bits = bits_for(parts)
    bounded_batches(texts.sparkSession)

    def run(batches):
        nodes, held, entries = [], [], 0

        def work() -> pa.RecordBatch:
            sizes = np.array([len(h) for h in held], np.int64)
            return blob_batch(stretch_blobs(np.concatenate(held), np.repeat(np.array(nodes, np.int64), sizes), np.repeat(sizes, sizes), bits))

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes.append(node)
                held.append(np.unique(shingle_hashes(text, shingle)))
                entries += len(held[-1])
                if entries > KEYS_A_TASK:
                    yield work()
                    nodes, held, entries = [], [], 0
        if nodes:
            yield work()

    met = Written(meet(asked.select("node", "_t").mapInArrow(run, BLOBS), parts, True).select("key", F.col("owner").alias("node"), F.col("place").alias("size")), "shingles").df
    common = met.join(met.groupBy("key").agg(F.count("*").alias("texts")), "key")
    share = lambda x: F.ceil(x - F.lit(1e-6))
    own = W.partitionBy("node")
    at = F.row_number().over(own.orderBy("texts", "key")) + F.col("size") - F.count("*").over(own)
    ranked = common.withColumn("at", at).where(F.col("at") <= F.col("size") - share(F.col("size") * similarity) + 1).join(labels, "node")
    kept = Written(ranked.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / math.log(GROW)).cast("int")).select("key", "node", "size", "label", "at", "class"), "prefixes").df
    both = similarity / (1 + similarity)
    smaller = kept.where(F.col("at") <= F.col("size") - share(F.col("size") * 2 * both) + 1).select("key", "class", F.col("node").alias("other"), F.col("size").alias("less"), F.col("label").alias("its"))
    reach = math.ceil(-math.log(similarity) / math.log(GROW)) + 1
    least = F.greatest(F.pow(F.lit(GROW), F.col("class") - F.col("down")), F.col("size") * similarity)
    larger = kept.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(reach)))).where(F.col("at") <= F.col("size") - share((F.col("size") + least) * both) + 1)
    larger = larger.select("key", (F.col("class") - F.col("down")).alias("class"), "node", "size", "label")
    pairs = larger.join(smaller, ["key", "class"]).where("label != its and less <= size and less >= size * " + repr(similarity - 1e-9))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def similar_pairs(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", keep: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and pairs (a, b), a <= b, of their smallest ids whose texts are similar: links that join what
    all similar pairs join."""
    texts, pairs = _similar_nodes(df, shingle, similarity, text, keep)
    of = lambda name: texts.select(F.col("node").alias(name), F.col("_id").alias(f"id_{name}"))
    ids = pairs.join(of("a"), "a").join(of("b"), "b")
    return texts, ids.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _similar_nodes(df: DataFrame, shingle: int, similarity: float, text: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and pairs (a, b) of nodes verified: Jaccard similarity of their sets of shingles.

    The pairs join what all similar pairs with a key in common join. Each text is compared with one leader first; the
    components that this leaves apart although they have a key in common are then compared by their rare shingles.
    """
    texts = Written(_distinct_texts(df, text, keep), "texts").df
    with scratch("similar"):
        signatures, shared = _shared(texts, shingle)
        tried = Written(_led(shared), "candidates").df
        found = _verified(texts, signatures, tried, shingle, similarity)
        apart = Written(_apart(shared, found), "apart").df
        fresh = Written(_rest(texts, apart, shingle, similarity).join(tried, ["a", "b"], "left_anti"), "candidates").df
        found = found.unionByName(_verified(texts, signatures, fresh, shingle, similarity))
    return texts, found


def _verified(texts: DataFrame, signatures: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs whose texts are so similar: the fingerprints' complete distance drops most others, the sets of
    shingles decide. A side's shingles are kept from one pair to the next, as pairs come in the order of ``a``."""
    of = lambda name: signatures.select(F.col("node").alias(name), F.col("seg").alias(f"seg_{name}"))
    distance = F.aggregate(F.zip_with("seg_a", "seg_b", lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(LOW_SEGMENT)))), F.lit(0), lambda s, x: s + x)
    near = Written(pairs.join(of("a"), "a").join(of("b"), "b").where(distance <= FARTHEST).select("a", "b"), "near").df
    asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    held = Written(texts.join(asked, "node", "left_semi").select("node", "_t"), "near-texts")
    bounded_batches(texts.sparkSession)
    side = lambda name: held.df.select(F.col("node").alias(name), F.col("_t").alias(f"text_{name}"))

    def run(batches):
        last, x = None, None
        for batch in batches:
            alike = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, x = a, np.unique(shingle_hashes(text_a, shingle))
                y = np.unique(shingle_hashes(text_b, shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    verified = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    similar = Written(verified, "similar").df
    held.drop()
    return similar


def one_of_each(df: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each group that similar pairs and equal texts join, the row of the
    smallest ``keep`` stays.

    Candidates come from wide SimHash fingerprints by multi-index hashing, with balls over each segment's least certain
    bits; the shingles' Jaccard similarity is then verified, so no pair below it is joined (of pairs just above it a few
    have no ball in common and are missed; the README has figures). Texts without a word have equal texts as their only
    duplicates; null counts as empty. Ids are integers. Of rows with the same id and text one stays; one id's different
    texts are told apart, and rows without an id come last.
    """
    integer_id(df, keep)
    texts, pairs = _similar_nodes(df, shingle, similarity, text, keep)
    order = F.struct(F.col("_id").isNull(), "_id", "_k1", "_k2")
    grouped = Written(components(pairs).join(texts.select("node", "_k1", "_k2", "_id"), "node"), "groups").df
    best = grouped.groupBy("label").agg(F.min_by("node", order).alias("best"))
    gone = grouped.join(best, "label").where("node != best").select("node")
    stays = Written(texts.select("node", "_k1", "_k2", "_id").join(gone, "node", "left_anti").select(F.col("_k1").alias("_l1"), F.col("_k2").alias("_l2"), F.col("_id").alias("_least")), "stays").df
    keyed = df.select(packed(df), F.col(keep).cast("long").alias("_id"), *text_key(F.col(text)))
    kept = keyed.join(stays, (F.col("_k1") == F.col("_l1")) & (F.col("_k2") == F.col("_l2")) & F.col("_id").eqNullSafe(F.col("_least")))
    return kept.dropDuplicates(["_k1", "_k2", "_id"]).select("_all.*")
