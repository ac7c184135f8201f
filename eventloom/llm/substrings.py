"""Exact removal of long byte strings that also start in an earlier document, by suffix arrays.

Every 50-byte string is filed under an anchor inside it: the 16 bytes of least hash, leftmost first, and the 17 bytes on
the side where the string reaches further. Equal strings have equal anchors, so only anchors that two documents share
matter; of those, the neighbourhoods (an anchor and the run of strings filed under it) are compared. Distinct
neighbourhoods of one anchor meet in a bin, where a suffix array (see ``suffixes``) brings equal strings together; the
anchor stands as one symbol in it. An anchor with more of them than ``CROWD`` is lengthened on the side where each string
reaches further, which deals its strings to more anchors, until every anchor's neighbourhoods fit a bin: at full length
an anchor is its only string. Each string learns the smallest document it starts in, and each document removes the
strings that a smaller one has.

Texts are read once for their anchors, which meet in packed blobs (see ``meeting``), so a common passage costs a bucket
one entry for each stretch of text and not for each document. Copies of one text are one document of the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches, integer_id, text_key
from .meeting import BLOBS, bits_for, blob_batch, meet, stretch_blobs
from .suffixes import suffix_array

LENGTH = 50
GRAM = 16
PLACES = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
ANCHOR = GRAM + HALF
#: Distinct neighbourhoods of one anchor that a bin takes.
CROWD = 512
#: Bytes of neighbourhoods in a bin, about.
BIN_BYTES = 1 << 16
#: Bytes of neighbourhoods in an Arrow batch, about; those of one text stay together.
BODY_BYTES = 2 << 20
#: String starts in one pass over texts, and the bytes of texts whose anchors are packed together.
BLOCK = 1 << 19
STRETCH = 16 << 20
#: Bytes of text for each bucket of anchors, about.
BUCKET_BYTES = 4 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _hashes(words: np.ndarray, at: np.ndarray | slice, steps: list[int]) -> np.ndarray:
    """A 64-bit hash of the eight bytes at each of ``steps`` from each place; ``words`` has eight bytes for each place."""
    take = lambda step: words[at.start + step : at.stop + step] if isinstance(at, slice) else words[at + step]
    out = take(steps[0]) * _C[0]
    for k, step in enumerate(steps[1:]):
        out ^= out >> np.uint64(29)
        out += take(step)
        out *= _C[1 + k % 2]
    out ^= out >> np.uint64(32)
    out *= _C[3]
    out ^= out >> np.uint64(29)
    return out


def anchor_runs(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run: the anchor's hash, the first string's start, the number of strings, the anchor's offset in the
    first string, and whether it reaches to the left (1) or right (0) of its least 16 bytes.

    ``data`` is the texts joined, each of LENGTH bytes or more; ``ends`` is where they end. No string crosses an end.
    """
    strings = max(0, len(data) - LENGTH + 1)
    held = np.frombuffer(data + bytes(64), np.uint8)
    inside = np.ones(len(data), bool)
    inside[(ends[:, None] - np.arange(1, LENGTH)).ravel()] = False
    parts = []
    for at in range(0, strings, BLOCK):
        size = min(BLOCK, strings - at)
        grams = size + PLACES - 1
        words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(held[at:], (grams + ANCHOR - GRAM + 8, 8), (1, 1))).view("<u8").ravel()
        key = (_hashes(words, slice(0, grams), [0, 8]) & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span * 2 <= PLACES:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < PLACES:
            key = np.minimum(key[: len(key) - (PLACES - span)], key[PLACES - span :])
        least = (key & np.uint64(0xFFFFF)).astype(np.int64)
        left = least - np.arange(size) >= HALF
        here = inside[at : at + size]
        new = np.ones(size, bool)
        new[1:] = (least[1:] != least[:-1]) | (left[1:] != left[:-1]) | (here[1:] != here[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(starts, append=size)
        whole = here[starts]
        starts, counts = starts[whole], counts[whole]
        side = left[starts]
        anchor = least[starts] - np.where(side, HALF, 0)
        parts.append((_hashes(words, anchor, [0, 8, 16, 24, ANCHOR - 8]) ^ side.astype(np.uint64), starts + at, counts, anchor - starts, side.astype(np.int64)))
    if not parts:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _place(starts: np.ndarray, counts: np.ndarray, shifts: np.ndarray, sides: np.ndarray) -> np.ndarray:
    return starts << 11 | counts << 6 | shifts << 1 | sides


def stretch_entries(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, row, place) of each run of a stretch of texts."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    keys, starts, counts, shifts, sides = anchor_runs(b"".join(texts), ends)
    text = np.searchsorted(ends, starts, "right")
    return keys, rows[text], _place(starts - (ends - lengths)[text], counts, shifts, sides)


def _shared_places(docs: DataFrame, size: int) -> DataFrame:
    """(owner, place) of each run whose anchor two documents have; ``size``: bytes of all texts."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    bits = bits_for(parts)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, held = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(row)
                texts.append(text.encode())
                held += len(texts[-1])
                if held > STRETCH:
                    yield blob_batch(stretch_blobs(*stretch_entries(np.array(rows, np.int64), texts), bits))
                    rows, texts, held = [], [], 0
        if rows:
            yield blob_batch(stretch_blobs(*stretch_entries(np.array(rows, np.int64), texts), bits))

    return meet(docs.select("_row", "_text").mapInArrow(run, BLOBS), parts)


def _bodies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The neighbourhoods of a batch of (doc, row, text, places); those of many texts share a batch of some BODY_BYTES."""
    places, many = batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy()
    docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    bodies: list[bytes] = []
    at = done = first = size = 0

    def made(end: int) -> pa.RecordBatch:
        place, owners = places[done:at], slice(first, end)
        same = [np.repeat(x[owners], many[owners]) for x in (docs, rows)]
        columns = [*same, place >> 11, (place >> 1 & 31).astype(np.int32), (place & 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary())], names=["doc", "row", "start", "shift", "side", "body"])

    for i, (text, n) in enumerate(zip(batch.column(2).to_pylist(), many.tolist(), strict=True)):
        data, place = text.encode(), places[at : at + n]
        start = place >> 11
        bodies += [data[a:b] for a, b in zip(start.tolist(), (start + (place >> 6 & 31) + (LENGTH - 1)).tolist(), strict=True)]
        at, size = at + n, size + n * LENGTH
        if size > BODY_BYTES:
            yield made(i + 1)
            bodies, done, first, size = [], at, i + 1, 0
    if bodies:
        yield made(len(many))


def _neighbourhoods(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, row, start, shift, side, body): the bytes around each shared anchor."""
    held = places.groupBy("owner").agg(F.collect_list("place").alias("places"))
    joined = docs.join(held, F.col("_row") == F.col("owner")).select("_doc", "_row", "_text", "places")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _bodies(batch)

    return joined.mapInArrow(run, "doc long, row long, start long, shift int, side int, body binary")


def first_documents(bodies: list[tuple[bytes, int, int]], length: int = ANCHOR) -> list[list[int]]:
    """For each (bytes, anchor's offset, smallest document): of each of its strings the smallest document in the bin."""
    symbols: list[int] = []
    anchors: dict[bytes, int] = {}
    strings: list[bytes | None] = []
    where: list[tuple[list[int], int]] = []
    least = [[doc] * (len(body) - LENGTH + 1) for body, _, doc in bodies]
    for (body, shift, _), low in zip(bodies, least, strict=True):
        anchor = anchors.setdefault(body[shift : shift + length], 257 + len(anchors))
        rest = len(body) - length + 2 - len(low)
        strings += [body[o : o + LENGTH] for o in range(len(low))]
        strings += [None] * rest
        where += [(low, o) for o in range(len(low))]
        where += [(low, -1)] * rest
        symbols += [x + 1 for x in body[:shift]]
        symbols.append(anchor)
        symbols += [x + 1 for x in body[shift + length :]]
        symbols.append(0)
    run: list[tuple[list[int], int]] = []
    last = b""

    def close() -> None:
        smallest = min(low[o] for low, o in run)
        for low, o in run:
            low[o] = smallest

    for at in suffix_array(symbols):
        string = strings[at]
        if string is None:
            continue
        if string != last:
            if len(run) > 1:
                close()
            run, last = [], string
        run.append(where[at])
    if len(run) > 1:
        close()
    return least


def _runs_of(least: list[int], most: int) -> list[tuple[int, int, int]]:
    """(first, last, smallest document) of stretches of strings that some document of the body must remove."""
    out: list[tuple[int, int, int]] = []
    for o, low in enumerate(least):
        if low < most:
            if out and out[-1][1] == o - 1 and out[-1][2] == low:
                out[-1] = (out[-1][0], o, low)
            else:
                out.append((o, o, low))
    return out


def _trimmed(bodies: list[tuple], length: int) -> list[tuple[int, int]]:
    """The first and last string of each (key, own, shift, body, ...) that another body of its key may have.

    A string reaches further to the left of its anchor or to the right, and must share that side's nearest bytes.
    """
    half = -(-(LENGTH - length) // 2)
    sides, seen = [], {}
    for x in bodies:
        key, shift, body = x[0], x[2], x[3]
        left = (key, 0, body[shift - half : shift]) if half and shift >= half else None
        right = (key, 1, body[shift + length : shift + length + half]) if len(body) >= shift + length + half else None
        for side in (left, right):
            seen[side] = seen.get(side, 0) + 1
        sides.append((left, right))
    out = []
    for x, (left, right) in zip(bodies, sides, strict=True):
        last, turn = len(x[3]) - LENGTH, x[2] - half
        first, end = 0 if left and seen[left] > 1 else max(0, turn + 1), last if right and seen[right] > 1 else min(last, turn)
        out.append((first, end))
    return out


FOUND = "key long, own long, first int, last int, least long"


def _bin(held: list[tuple], length: int) -> list[tuple]:
    """(key, own, first, last, least) from whole keys' (key, own, shift, body, least, most)."""
    out, compared, trims = [], [], []
    for x, (first, end) in zip(held, _trimmed(held, length), strict=True):
        last = len(x[3]) - LENGTH
        if x[4] < x[5]:
            out += [(x[0], x[1], a, b, x[4]) for a, b in (((0, first - 1), (end + 1, last)) if first <= end else ((0, last),)) if a <= b]
        if first <= end:
            compared.append(x)
            trims.append((first, end))
    least = first_documents([(x[3][a : b + LENGTH], x[2] - a, x[4]) for x, (a, b) in zip(compared, trims, strict=True)], length) if compared else []
    for x, (a, _), low in zip(compared, trims, least, strict=True):
        out += [(x[0], x[1], a + i, a + j, doc) for i, j, doc in _runs_of(low, x[5])]
    return out


def _binned(bodies: DataFrame, length: int) -> DataFrame:
    """Bins of whole anchors of ``length`` bytes, a suffix array for each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def work() -> Iterator[pa.RecordBatch]:
            if out := _bin(held, length):
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "own", "first", "last", "least"])

        for batch in batches:
            for x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > BIN_BYTES and x[0] != last:
                    yield from work()
                    held, size = [], 0
                held.append(x)
                size, last = size + len(x[3]), x[0]
        if held:
            yield from work()

    ordered = bodies.repartition("key").sortWithinPartitions("key")
    return ordered.select("key", "own", "shift", "body", "least", "most").mapInArrow(run, FOUND)


def _anchored(shift: Column, side: Column, body: Column, length: int) -> list[Column]:
    """``key`` of the anchor and ``own`` of the body and the anchor's place in it: together they stand for the body."""
    anchor = F.substring(body, shift + 1, F.lit(length))
    return [F.xxhash64(side, anchor).alias("key"), F.xxhash64(F.lit(1), side, shift, body).alias("own")]


def _halves(bodies: DataFrame, length: int) -> DataFrame:
    """Each body as the strings that reach further to the left of the anchor and those that reach further to the right,
    with anchors so much longer: ``of1``, ``of2`` and ``skip`` say which strings of which body they are."""
    half = -(-(LENGTH - length) // 2)
    count, shift = F.length("body") - (LENGTH - 1), F.col("shift")
    lefts = F.least(count, F.greatest(shift - (half - 1), F.lit(0)))
    part = lambda side, skip, many, at: F.struct(F.lit(side).alias("side"), skip.alias("skip"), many.alias("many"), at.alias("shift"))
    parts = F.filter(F.array(part(1, F.lit(0), lefts, shift - half), part(0, lefts, count - lefts, shift - lefts)), lambda p: p["many"] > 0)
    cut = bodies.select(F.col("key").alias("of_key"), F.col("own").alias("of_own"), "least", "most", "body", F.explode(parts).alias("p"))
    body = F.substring("body", F.col("p.skip") + 1, F.col("p.many") + (LENGTH - 1))
    held = cut.select("of_key", "of_own", "least", "most", F.col("p.skip").alias("skip"), F.col("p.shift").alias("shift"), F.col("p.side").alias("side"), body.alias("body"))
    return held.select("*", *_anchored(F.col("shift"), F.col("side"), F.col("body"), length + half))


def _distinct(bodies: DataFrame, least: str, most: str) -> Written:
    return Written(bodies.groupBy("key", "own", "shift", "side", "body").agg(F.min(least).alias("least"), F.max(most).alias("most")), "bodies")


def _search(bodies: DataFrame, length: int = ANCHOR) -> DataFrame:
    """(key, own, first, last, least) of the strings of distinct bodies that a smaller document than ``most`` has."""
    crowds = Written(bodies.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "crowds").df
    if crowds.isEmpty():
        return _binned(bodies, length)
    found = _binned(bodies.join(crowds, "key", "left_anti"), length)
    finer = Written(_halves(bodies.join(crowds, "key", "left_semi"), length), "finer").df
    inner = Written(_search(_distinct(finer, "least", "most").df, length - (length - LENGTH) // 2), "found").df
    back = finer.select("key", "own", "of_key", "of_own", "skip", "most").join(inner, ["key", "own"]).where("least < most")
    return found.unionByName(back.select(F.col("of_key").alias("key"), F.col("of_own").alias("own"), (F.col("skip") + F.col("first")).alias("first"), (F.col("skip") + F.col("last")).alias("last"), "least"))


def _ranges(unique: Written, size: int) -> DataFrame:
    """(_k1, _k2, _doc, ranges) of the texts that lose something: byte ranges (from, to), which may overlap. ``unique``
    is dropped as soon as it has been read."""
    docs = unique.df
    names = Written(docs.select(F.col("_row").alias("row"), "_k1", "_k2", "_doc"), "names")
    places = Written(_shared_places(docs, size), "places")
    around = Written(_neighbourhoods(docs, places.df).select("doc", "row", "start", "shift", "side", "body", *_anchored(F.col("shift"), F.col("side"), F.col("body"), ANCHOR)), "neighbourhoods")
    places.drop()
    unique.drop()
    bodies = _distinct(around.df, "doc", "doc")
    found = Written(_search(bodies.df), "found")
    bodies.drop()
    pieces = around.df.select("key", "own", "doc", "row", "start").join(found.df, ["key", "own"]).where("least < doc")
    pieces = pieces.select("row", F.struct((F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + LENGTH).alias("to")).alias("range"))
    cuts = Written(pieces.groupBy("row").agg(F.collect_set("range").alias("ranges")), "cuts")
    around.drop()
    found.drop()
    return cuts.df.join(names.df, "row").drop("row")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the union of byte ranges (from, to) begins and ends, in order; ranges that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > stops[:-1]
    return starts[first], stops[np.append(first[1:], True)] if len(stops) else stops


def _cut(texts: DataFrame, ranges: DataFrame, kept: bool) -> DataFrame:
    """What is left of each text that loses something, by its key."""
    joined = texts.join(ranges, ["_k1", "_k2", "_doc"]).dropDuplicates(["_k1", "_k2", "_doc"]).select("_k1", "_k2", "_text", "ranges")
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # All texts' ranges at once: texts lie 4 GB apart, so none of their ranges touch.
            many = batch.column(3).value_lengths().to_numpy()
            apart = np.repeat(np.arange(len(many)) << 32, many)
            starts, stops = merged(*(x.to_numpy() + apart for x in batch.column(3).flatten().flatten()))
            ends = np.searchsorted(starts, np.arange(1, len(many) + 1) << 32).tolist()
            starts, stops = (starts & 0xFFFFFFFF).tolist(), (stops & 0xFFFFFFFF).tolist()
            for t, lo, hi in zip(batch.column(2).to_pylist(), [0, *ends], ends, strict=False):
                data, cuts, at, left = t.encode(), list(zip(starts[lo:hi], stops[lo:hi], strict=True)), 0, []
                for a, b in cuts:
                    left.append(data[at:a])
                    at = b
                rest = b"".join([*left, data[at:]])
                out.append((len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), *([rest] if kept else [])))
            kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if kept else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]], names=names)

    names = ["_k1", "_k2", "_gone", "_spans", "_sha", *(["_rest"] if kept else [])]
    return joined.mapInArrow(run, f"_k1 long, _k2 long, _gone long, _spans long, _sha string{', _rest binary' if kept else ''}")


def dedup(df: DataFrame, text: str = "text", keep: str = "doc_id", kept: bool = True) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` (binary) unless told not to.

    Each byte goes that a LENGTH-byte string covers which also starts in a document of smaller id. Ids are integers.
    Null texts are empty; null ids are neither earlier nor later than others and lose nothing; rows of one id are one
    document's. Texts under LENGTH bytes lose nothing. Repeated rows stay; an empty table gives no rows; other columns
    are ignored.
    """
    integer_id(df, keep)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = F.col(keep).cast("long")
    long = df.where(doc.isNotNull() & (F.octet_length(body) >= LENGTH))
    firsts = Written(long.select(doc.alias("_first"), F.octet_length(body).alias("_bytes"), *text_key(body)).groupBy("_k1", "_k2").agg(F.min("_first").alias("_first"), F.max("_bytes").alias("_bytes")), "firsts").df
    size = firsts.agg(F.sum(F.col("_bytes").cast("long"))).first()[0] or 0
    # The smallest id is a key of the joins too, so copies of a text spread over tasks.
    keys = firsts.select("_k1", "_k2", F.col("_first").alias("_doc"))
    texts = long.select(doc.alias("_doc"), body.alias("_text"), *text_key(body))
    once = texts.join(keys, ["_k1", "_k2", "_doc"]).dropDuplicates(["_k1", "_k2", "_doc"])
    unique = Written(once.select(F.monotonically_increasing_id().alias("_row"), "_doc", "_k1", "_k2", "_text"), "unique")
    gone = _cut(texts, _ranges(unique, size), kept)
    cut = Written(firsts.drop("_bytes").join(gone, ["_k1", "_k2"], "left"), "cut").df
    rows = df.select(F.col(keep).alias("_id"), doc.alias("_doc"), F.octet_length(body).cast("long").alias("_n"), F.sha2(body.cast("binary"), 256).alias("_whole"), *([body.cast("binary").alias("_text")] if kept else []), *text_key(body))
    joined = rows.join(cut, ["_k1", "_k2"], "left")
    copy, first = F.col("_doc") > F.col("_first"), F.col("_doc") == F.col("_first")
    pick = lambda whole, part, none: F.when(copy, whole).when(first, F.coalesce(part, none)).otherwise(none)
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("_id").alias(keep), F.col("_n").alias("n_bytes"), pick(F.col("_n"), F.col("_gone"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("_spans"), zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("_sha"), F.col("_whole")).alias("kept_sha256"), *([pick(F.lit(b""), F.col("_rest"), F.col("_text")).alias("kept")] if kept else []),
    )
