import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe
from eventloom.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()
CODEC, LIBRARY = bpe.Codec(bpe.load_vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)
PIECES = ["the", " and", "'ll", "'s", "<|endoftext|>", "\n\n", "  ", "\t", "\x85", "　", "\x1c", "é", "ß", "漢", "😀", "٣", "½", "Ǆ", "_", "...", "0", "12", "x" * 130, "​", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(PIECES)).map("".join)))
def test_same_as_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256)))
def test_decodes_any_ids(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_no_token_crosses_a_boundary():
    for text in ("therein hitherto", "naïve façade", "𝔘𝔫𝔦"):
        piece = text.encode()
        cuts = {sum(map(len, CODEC.fragments(piece)[: i + 1])) for i in range(len(CODEC.fragments(piece)))}
        assert b"".join(CODEC.fragments(piece)) == piece and cuts
    assert len(CODEC.fragments(b"zqxjkvbq")) > 1


def test_digests(some, texts):
    want = set()
    for i, t in texts:
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in bpe.digests(some, PATH).collect()} == want


def test_odd(odd, none):
    rows = bpe.digests(odd, PATH).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0}
    ids = bpe.encode(odd, PATH)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(ids, PATH).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    assert bpe.digests(none, PATH).count() == bpe.encode(none, PATH).count() == 0
