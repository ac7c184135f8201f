import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from eventloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+ 01255()%_é\n4", max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == base(text)


def test_long_texts_take_no_square_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 50_000, "1." * 50_000, "a(at)" * 20_000, "@a." * 50_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_trees_on_templates_of_another_seed():
    model, limits = pii.trained()
    rng = random.Random(991)
    made = [pii._made(rng) for _ in range(1500)]
    odds = model.probability(np.array([pii.features(t, k, a, b) for t, k, a, b, _ in made]))
    taken = np.array([p >= limits[m[1]] for p, m in zip(odds, made, strict=True)])
    truth = np.array([m[-1] for m in made], bool)
    assert truth[taken].mean() > 0.95 and taken[truth].mean() > 0.8
    assert pii.trained()[1] == limits


def test_added_spans():
    text = "mail jo@ex.com, SSN: 219-45-6781 and account IBAN DE89370400440532013000; order 000-45-6781"
    base_, (model, limits) = pii.base_spans(text), pii.trained()
    more = pii.more_spans(text, base_, model, limits)
    assert ("ssn", 21, 32) in more and any(k == "iban" for k, _, _ in more) and not any(a > 80 for _, a, _ in more)
    assert pii.redact(text, base_ + more).startswith("mail [EMAIL], SSN: [SSN] and account IBAN [IBAN]")


def test_documents(some, texts):
    got = {r["doc_id"]: r for r in pii.find(some).collect()}
    for i, t in texts:
        spans = base(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(spans).encode()).hexdigest() and got[i]["spans"].startswith(pii.joined(spans))


def test_odd(odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and pii.find(none).count() == 0
    assert next((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows if r["doc_id"] == 12) == (1, 1, 1, 1)


@pytest.mark.parametrize("n", [1, 3, 9, 12, 200])
def test_added_spans_overlap_nothing(n):
    """However many base spans lie inside another one."""
    text = "my SSN: x@" + "1.1.1.1." * n + "SSN.219-45-6781.com and SSN: 219-45-6782 too"
    base = pii.base_spans(text)
    more = pii.more_spans(text, base, *pii.trained())
    assert all(b <= c or d <= a for _, a, b in base for _, c, d in more) and len(more) == 1
