import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import meeting, substrings
from eventloom.llm.suffixes import _lyndon_groups, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repeats():
    for text in (b"a" * 300, b"ab" * 150, b"abcab" * 40, bytes(range(255, -1, -1)), b"mississippi" * 9):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def by_definition(rows):
    first, out = {}, []
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for k in range(len(data) - 49):
                first[data[k : k + 50]] = min(i, first.get(data[k : k + 50], i))
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for k in range(len(data) - 49):
                if first[data[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), len(data) - len(kept), sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in substrings.dedup(df, kept=False).collect()), key=str)


def test_documents(some, texts):
    assert result(some) == by_definition(texts)


@pytest.mark.parametrize("crowd", [1, 3, 512])
def test_planted(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "BIN_BYTES", 2000)
    rng = random.Random(crowd)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(rng.choice([49, 50, 51, 80, 300])) for _ in range(6)] + ["z" * 120]
    rows = [(rng.randrange(60), noise(rng.randrange(80)) + rng.choice(shared)[rng.randrange(4) :] + noise(rng.randrange(60)) + rng.choice(shared)) for _ in range(90)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(100, shared[5]), (101, shared[5] * 2)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == by_definition(rows)


def test_runs_cover_every_string():
    data = ("lorem ipsum " * 30 + "a" * 200).encode()
    hashes, starts, counts, shifts, sides = substrings.anchor_runs(data, np.array([len(data)]))
    assert starts[0] == 0 and counts.sum() == len(data) - 49 and (starts[1:] == (starts + counts)[:-1]).all()
    assert ((shifts >= counts - 1) & (shifts + substrings.ANCHOR <= 50)).all() and len(hashes) == len(starts)
    assert len(substrings.anchor_runs(b"", np.empty(0, int))[0]) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=50, max_size=130), min_size=1, max_size=6))
def test_equal_strings_have_equal_anchors(texts):
    ends = np.cumsum([len(t) for t in texts])
    data, found = "".join(texts).encode(), {}
    for key, start, count, _, _ in zip(*substrings.anchor_runs(data, ends), strict=True):
        for at in range(start, start + count):
            assert found.setdefault(data[at : at + 50], key) == key
    inside = {t.encode()[k : k + 50] for t in texts for k in range(len(t) - 49)}
    assert set(found) == inside


def test_odd(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == by_definition(rows)
    assert substrings.dedup(none).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substrings.dedup(odd).collect()}
    assert kept[2] == b"" and kept[8] in (b"x", b"y y")


def test_passes_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([50, 51, 90, 400]))) for _ in range(30)]
    strings = lambda: {(s + k, h) for h, s, n, *_ in zip(*substrings.anchor_runs(b"".join(texts), np.cumsum([*map(len, texts)])), strict=True) for k in range(n)}
    whole = strings()
    monkeypatch.setattr(substrings, "BLOCK", 300)
    assert strings() == whole


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_blobs_keep_what_stretches_share(bits):
    """Places that a stretch knows to be shared, and entries that meet those of others."""
    rng = random.Random(bits)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(80)) + (passage if i % 3 else b"") for i in range(9)]
    known, ahead = set(), {}
    for bucket, n, blob in meeting.stretch_blobs(*substrings.stretch_entries(np.arange(9), texts), bits):
        for key, row, place in zip(*[c.tolist() for c in meeting.unpack(blob, n, meeting._KINDS if bucket < 0 else meeting._SHORT)], strict=True):
            if bucket < 0:
                known.add((row, place))
            else:
                ahead.setdefault((bucket, key), []).append((row, place))
    assert {row for row, _ in known} == {i for i in range(9) if i % 3}
    probes = [v for v in ahead.values() if v[0][1] == -1]
    assert probes and all(len(v) == 1 for v in probes) and known.isdisjoint(x for v in ahead.values() for x in v)


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        substrings.dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_groups_that_move_as_one_stay():
    """A suffix without an equal prefix and a group that moves whole need no new group, which is most of the work."""
    text = random.Random(1).sample(range(1, 2000), 1500)
    assert len(_lyndon_groups(text, len(text))[1]) == max(text) + 2
    for text in (b"ab" * 200, [*range(1, 60), 0] * 5):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
        assert len(_lyndon_groups(text, len(text))[1]) < max(text) + 2 + len(text) // 2


def test_neighbourhoods_of_texts_share_a_batch(monkeypatch):
    texts = [f"{i:04}" * 40 for i in range(200)]
    place = lambda start, count, shift, side: start << 11 | count << 6 | shift << 1 | side
    wanted = [(i, i + 1000, at, 3, at % 2, texts[i].encode()[at : at + 54]) for i in range(200) for at in range(i % 4)]
    places = pa.array([[place(at, 5, 3, at % 2) for at in range(i % 4)] for i in range(200)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(1000, 1200)), pa.array(texts), places], names=["doc", "row", "text", "places"])
    for most, batches in ((1 << 20, 1), (1000, 15)):
        monkeypatch.setattr(substrings, "BODY_BYTES", most)
        made = list(substrings._bodies(batch))
        assert len(made) == batches and [tuple(r.values()) for b in made for r in b.to_pylist()] == wanted


def test_merged_ranges():
    rng = random.Random(4)
    for _ in range(200):
        ranges = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(12)))]
        covered = {x for a, b in ranges for x in range(a, b)}
        starts, stops = substrings.merged(*np.array(ranges, np.int64).reshape(-1, 2).T)
        assert starts.tolist() == sorted(x for x in covered if x - 1 not in covered)
        assert stops.tolist() == sorted(x + 1 for x in covered if x + 1 not in covered)
