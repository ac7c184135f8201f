"""Byte-pair encoding and decoding by forced boundaries.

Two neighbouring bytes that never stand next to each other inside any token of the vocabulary can never be merged
across, whatever the merge order: a text may be cut there, each fragment encoded for itself, and the ids concatenated.
The vocabulary is read on the driver and sent to the executors as one broadcast value (its size is the vocabulary's,
whatever the corpus), so no executor needs the tokenizer file.

Null texts count as empty: no ids. The pass is narrow; rows may repeat and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts

#: The pattern that splits texts before the merges; white space as Unicode's White_Space property has it.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: The same for texts whose characters are all below U+0100, in the terms of the standard library's faster engine.
LATIN_PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""

#: Pieces that a worker remembers at most; then it begins anew.
REMEMBERED = 400_000

#: A merge is one number: its rank, then the id it makes.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62

#: Bytes from which a fragment is merged with a heap.
LONG_FRAGMENT = 100


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """What encoding needs of a byte-level BPE file: tokens as bytes by id, merges by rank, special tokens."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    ids = {raw(token): i for token, i in held["model"]["vocab"].items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
    merges = [(raw(a), raw(b)) for a, b in pairs]
    special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
    return {"ids": ids, "merges": merges, "special": special}


class Pieces(dict):
    """Ids by pre-token, as little-endian 32-bit integers; fills itself."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        made = self.codec.encode_piece(piece.encode())
        self[piece] = made
        return made


class Codec:
    def __init__(self, vocabulary: dict) -> None:
        ids = vocabulary["ids"]
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges = {(ids[a], ids[b]): rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(vocabulary["merges"])}
        self.tokens = {i: token for token, i in ids.items()} | {i: s.encode() for s, i in vocabulary["special"].items()}
        self.special = vocabulary["special"]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.joined = {(a, b) for token in ids for a, b in zip(token, token[1:], strict=False)}
        self.find_any, self.find_latin = regex.compile(PRETOKENS).findall, re.compile(LATIN_PRETOKENS).findall
        self.pieces = Pieces(self)

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut between all bytes that no token holds side by side."""
        joined, cuts = self.joined, [0]
        cuts += [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if pair not in joined]
        return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True)]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        symbols = [self.byte_ids[b] for b in fragment]
        if len(symbols) > LONG_FRAGMENT:
            return self.encode_long(symbols)
        get = self.merges.get
        ranks = [get(pair, NO_MERGE) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_MERGE:
            i = ranks.index(least)
            symbols[i : i + 2] = [least & ID_MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), NO_MERGE)
        return symbols

    def encode_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap over a linked list, for fragments whose length a quadratic loop would not bear."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(merges[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in merges]
        heapq.heapify(heap)
        while heap:
            code, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, _ = code & ID_MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (made, symbols[k])) in merges:
                    heapq.heappush(heap, (merges[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (symbols[h], made)) in merges:
                heapq.heappush(heap, (merges[pair], h, *pair))
        return [s for s in symbols if s >= 0]

    def encode_piece(self, piece: bytes) -> bytes:
        out = array("I")
        for fragment in self.fragments(piece):
            out.extend(self.encode_fragment(fragment))
        return _little(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        if len(pieces) > REMEMBERED:
            pieces.clear()
        if not self.special or not any(s in text for s in self.special):
            return b"".join(map(pieces.__getitem__, self.find(text)))
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(pieces.__getitem__, self.find(part)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return _ids(self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; ids that the vocabulary lacks are left out; broken UTF-8 becomes U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids if i in tokens]).decode("utf-8", "replace")


def _little(ids: array) -> bytes:
    if array("I", [1]).tobytes()[0] != 1:
        ids.byteswap()
    return ids.tobytes()


def _ids(held: bytes) -> array:
    ids = array("I", held)
    if array("I", [1]).tobytes()[0] != 1:
        ids.byteswap()
    return ids


_codecs: dict[str, Codec] = {}


def _codec(name: str, vocabulary) -> Codec:
    """One codec a worker process and vocabulary; tasks that follow each other share it."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(vocabulary.value)
    return _codecs[name]


def _shipped(df: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    return name, df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``input_ids`` (array of int) for each row: the whole text, null as empty."""
    name, vocabulary = _shipped(df, tokenizer)

    def make():
        codec = _codec(name, vocabulary)
        return lambda texts: {"input_ids": pa.array([codec.encode(t or "") for t in texts], pa.list_(pa.int32()))}

    return map_texts(df, make, f"{keep} {_type(df, keep)}, input_ids array<int>", text, {keep: keep})


def decode(df: DataFrame, tokenizer: str, ids: str = "input_ids", keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``text`` for each row of ids; null ids give an empty text."""
    name, vocabulary = _shipped(df, tokenizer)
    inner = df.select(F.col(keep).alias("_keep"), F.col(ids).alias("_ids"))
    bounded_batches(df.sparkSession)

    def run(batches):
        codec = _codec(name, vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[keep, "text"])

    return inner.mapInArrow(run, f"{keep} {_type(df, keep)}, text string")


def digests(df: DataFrame, tokenizer: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Encodes and decodes each whole text; returns the digests of both, in one narrow pass."""
    name, vocabulary = _shipped(df, tokenizer)

    def make():
        codec = _codec(name, vocabulary)

        def work(texts: list) -> dict:
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                held = codec.encode_bytes(t or "")
                counts.append(len(held) // 4)
                ids_sha.append(hashlib.sha256(held).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(_ids(held)).encode()).hexdigest())
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

        return work

    return map_texts(df, make, f"{keep} {_type(df, keep)}, n_tokens long, ids_sha256 string, decoded_sha256 string", text, {keep: keep})


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
