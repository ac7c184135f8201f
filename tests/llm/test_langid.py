import zlib

import numpy as np

from eventloom.llm import langid


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(df).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_many_languages_and_false_positives():
    rng = np.random.default_rng(1)
    members = {f"l{i:03d}": np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for i in range(130)}
    filters = langid.Filters.build(members)
    assert filters.slots.shape[1] == 3 and filters.false.max() < 0.5
    bits = int(filters.slots.shape[0]).bit_length() - 1
    for i, name in enumerate(filters.languages):
        assert all(((filters.slots[at, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all() for at in filters.slots_of(members[name], bits))


def grams(text):
    return np.concatenate(list(langid.ngram_hashes(text)))


def plain_grams(text):
    """n-grams of each word between spaces, as strings, and pairs across words never."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return [f" {w} "[i : i + n] for w in words for n in langid.SIZES for i in range(len(w) + 3 - n)]


def test_passes_change_nothing(monkeypatch):
    text = "Hello,  world! Été 12 ab" * 40 + "  x"
    whole = grams(text)
    assert len(whole) == len(plain_grams(text)) and len(np.unique(whole)) == len(set(plain_grams(text)))
    for block in (1, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.array_equal(np.sort(grams(text)), np.sort(whole))


def test_filters_against_exact_sets(spark, some, texts):
    """Filters hold all members, as few others as they say, and decide as the exact sets do."""
    members = langid.members(some)
    filters, held = langid.Filters.build(members), {k: set(v.tolist()) for k, v in members.items()}
    others = np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    bits = int(filters.slots.shape[0]).bit_length() - 1
    has = lambda h, i: np.all([(filters.slots[at, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for at in filters.slots_of(h, bits)], axis=0)
    for i, language in enumerate(filters.languages):
        assert has(members[language], i).all() and abs(has(others, i).mean() - filters.false[i]) < 0.01
    for _, text in texts:
        found = grams(text).tolist()
        exact = {k: sum(g in v for g in found) / max(1, len(found)) for k, v in held.items()}
        pred, score = filters.predict(text)
        if found:
            assert abs(score - exact[pred]) < 0.03 and exact[pred] >= max(exact.values()) - 0.03
        else:
            assert (pred, score) == (langid.UNKNOWN, 0.0)


def test_odd(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (4, 5, 6, 7)} == {("und", 0.0)}
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
