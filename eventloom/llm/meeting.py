"""Which keys do several owners have? Entries meet as packed blobs instead of rows.

A task sorts the entries of a stretch of its input by key and packs them into one compressed blob for each bucket of
keys. A key that two owners of the stretch have is known at once: its entries go on as they are, and one entry without a
place stands for them in the bucket. So a key that very many rows have costs its bucket one entry for each stretch.
Buckets grow in number with the input and are worked off as sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOBS = "bucket int, n int, blob binary"
#: The key of an entry, the one who has it, and what else is to be known; -1 stands for entries that went ahead.
_KINDS = ["<u8", "<i8", "<i8"]
_SHORT = ["<u4", "<i8", "<i8"]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte, as neighbouring values share their high bytes, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    held, at, out = np.frombuffer(pa.decompress(blob, n * sum(sizes), "zstd", asbytes=True), np.uint8), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(held[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def groups(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each distinct one begins, and whether more than one owner has it."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return begin, np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin)


def bits_for(parts: int) -> int:
    """Leading bits of a key that number its bucket, so that each of ``parts`` tasks gets several buckets."""
    return min(30, max(1, (parts * 4 - 1).bit_length()))


def stretch_blobs(keys: np.ndarray, owners: np.ndarray, places: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """(bucket, entries, blob) of a stretch's entries. Buckets below 0 hold those whose keys are known to be shared."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys, owners, places = keys[order] >> np.uint64(32 - bits), owners[order], places[order]
    begin, shared = groups(keys, owners)
    known = np.repeat(shared, np.diff(begin, append=len(keys)))
    out = []
    if known.any():
        out.append((-1 - int(keys[begin[shared]][0] >> np.uint64(32)), int(known.sum()), pack([keys[known], owners[known], places[known]])))
    ahead = ~known
    ahead[begin[shared]] = True
    places = np.where(known, -1, places)[ahead]
    keys, owners = keys[ahead], owners[ahead]
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    short = keys.astype("<u4")
    return out + [(int(bucket[a]), b - a, pack([short[a:b], owners[a:b], places[a:b]])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def blob_batch(blobs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*blobs, strict=True) if blobs else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "n", "blob"])


def meet(blobs: DataFrame, parts: int, keyed: bool = False) -> DataFrame:
    """(owner, place), and ``key`` if asked for, of each entry whose key several owners have."""
    names = [*(["key"] if keyed else []), "owner", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*([pa.array(key.view(np.int64))] if keyed else []), pa.array(owner), pa.array(place)], names=names)

        for batch in batches:
            for bucket, n, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket < 0:
                    yield out(*unpack(blob, n, _KINDS))
                else:
                    short, owner, place = unpack(blob, n, _SHORT)
                    held.append([short.astype(np.uint64) | np.uint64(bucket << 32), owner, place])
        if held:
            key, owner, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, owner, place = key[order], owner[order], place[order]
            begin, shared = groups(key, owner)
            taken = np.repeat(shared, np.diff(begin, append=len(key))) & (place >= 0)
            yield out(key[taken], owner[taken], place[taken])

    return blobs.repartition(parts, "bucket").mapInArrow(run, ", ".join(f"{c} long" for c in names))
