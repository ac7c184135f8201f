import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000))
def test_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 192 == 0 and payload.rstrip(b" ") == raw.rstrip(b" ") and len(payload) >= 192
    stored = media.encode_image(payload)
    assert media.decode_image(stored) == payload and media.read_header(stored[:33]) == (192, len(payload) // 192, 8)


def test_broken():
    stored = bytearray(media.encode_image(media.padded(b"text")))
    stored[45] ^= 1
    with pytest.raises(ValueError, match="broken"):
        media.decode_image(bytes(stored))
    with pytest.raises(ValueError, match="header"):
        media.read_header(b"x" * 33)


def check(df):
    got = media.media_columns(df).collect()
    assert len(got) == df.count()
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    for r in got:
        raw = next(t for t in texts[r["doc_id"]] if len(t) == r["n_bytes"])
        payload = media.padded(raw)
        stored = media.encode_image(payload)
        assert r["digest"] == r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["length"]) == (len(payload), zlib.crc32(payload[-16:]), len(stored), len(stored))
        assert r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["feature"] == media.image_feature(payload)
        assert (r["width"], r["height"], r["bits"]) == struct.unpack(">IIB", stored[16:25])
        with open(r["shard"].removeprefix("file:").replace("//", "/"), "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["length"]) == stored
    return got


def test_documents(some):
    got = check(some)
    places = {}
    for r in got:
        assert places.setdefault(r["digest"], (r["shard"], r["offset"])) == (r["shard"], r["offset"])


def test_odd(odd, none):
    check(odd)
    assert media.digests(none).count() == 0


def test_shards_are_tar_files(some, monkeypatch):
    import tarfile

    shard = media.store(some).first()["shard"].removeprefix("file:").replace("//", "/")
    with tarfile.open(shard) as archive:
        for member in archive.getmembers()[:20]:
            payload = media.decode_image(archive.extractfile(member).read())
            assert hashlib.sha256(payload).hexdigest() + ".png" == member.name


@pytest.mark.parametrize("copies", [2_000_000, 0])
def test_a_payload_is_stored_once(spark, monkeypatch, copies):
    """Whatever tasks its rows lie in, blanks at the end and nulls included."""
    monkeypatch.setattr(media, "COPIES", copies)
    monkeypatch.setattr(media, "STRETCH", 2000)
    texts = ["same", "same ", "same" + " " * 188, "same" + " " * 189, "", None, " ", "other é"]
    df = spark.createDataFrame([(i, texts[i % 8]) for i in range(80)], "doc_id long, text string").repartition(7)
    got = check(df)
    assert media.store(df).count() == len({r["digest"] for r in got}) == len({(r["shard"], r["offset"]) for r in got}) == 4
    folder = got[0]["shard"].removeprefix("file:").replace("//", "/").rsplit("/", 1)[0]
    import os
    import tarfile

    assert sum(len(tarfile.open(f"{folder}/{name}").getmembers()) for name in os.listdir(folder) if name.endswith(".tar")) == 4
