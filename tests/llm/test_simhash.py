import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import simhash
from eventloom.llm.components import components


def by_definition(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(some, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(some).collect()}
    prints = {i: by_definition(t) for i, t in texts}
    labels = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", labels[i]) for i in prints}


@pytest.mark.parametrize("bucket", [0, 2, 32])
def test_links_join_what_all_pairs_join(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    made = {0, 1, 3, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(8):
            made.add(seed)
            seed ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                seed ^= 1 << rng.randrange(64)
    for _ in range(40):
        made.add(0xABCDEF01 << 32 | 1 << rng.randrange(32) | 1 << rng.randrange(32))
        made.add((1 << rng.randrange(32) | 1 << rng.randrange(32)) << 32 | 0x12345678)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in made)
    pairs = [(r["a"], r["b"]) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(distance(a, b) <= 2 for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    assert groups(signed, lambda a, b: frozenset((a, b)) in linked) == groups(signed, lambda a, b: distance(a, b) <= 2)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = {(r["doc_id"], r["component_id"]) for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {(4, 4), (5, 4), (6, 4), (None, 4)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [1, 4, 6, 7, 8, 8, 9, 11, 12]


def shingles(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


def test_similar_pairs(spark, some, texts):
    rng = random.Random(3)
    base = list(dict.fromkeys(t for _, t in texts if len(t.split()) > 80))[:25]
    copies = []
    for n, t in enumerate(base):
        words = t.split(" ")
        for _ in range(max(1, len(words) // 150)):
            words[rng.randrange(len(words))] = "changed"
        copies.append((10_000 + n, " ".join(words)))
    df = spark.createDataFrame(list(enumerate(base)) + copies, "doc_id long, text string")
    held = {i: shingles(t) for i, t in [*enumerate(base), *copies]}
    alike = lambda a, b: len(held[a] & held[b]) / len(held[a] | held[b])
    _, pairs = simhash.similar_pairs(df)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(alike(a, b) >= 0.8 for a, b in found)
    wanted = {(a, b) for a in held for b in held if a < b and alike(a, b) >= 0.8}
    labels = groups(sorted(held), lambda a, b: (a, b) in found)
    assert sum(labels[a] == labels[b] for a, b in wanted) >= 0.95 * len(wanted) and len(wanted) > 10
    equal = {t: min(i for i, u in [*enumerate(base), *copies] if u == t) for _, t in [*enumerate(base), *copies]}
    want = {i for i, t in [*enumerate(base), *copies] if labels[i] == i and equal[t] == i}
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == want
    assert simhash.one_of_each(df.select("*", F.lit(1).alias("_first"), F.lit(1).alias("_all"))).columns == ["doc_id", "text", "_first", "_all"]


def test_ball_keys():
    """The likeliest members of each ball: flips of least total margin, its centre first; near copies share some."""
    rng = np.random.default_rng(1)
    held = rng.integers(-60, 60, (3, 512))
    own, keys = simhash.ball_keys(held)
    assert keys.shape == (3, simhash.SEGMENTS * simhash.PROBES) and len(np.unique(keys)) == keys.size
    for t in range(3):
        assert [int(x) for x in own[t]] == [sum(1 << i for i in range(32) if held[t, 32 * s + i] > 0) for s in range(16)]
    missed = 0
    for n in [12, 40, 200, 800] * 25:
        both = -(-n * 8 // 9)
        pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.int64).view(np.uint64)
        _, keys = simhash.ball_keys(np.stack([simhash.margins(pool[:n]), simhash.margins(pool[n - both :])]))
        missed += not np.intersect1d(keys[0], keys[1]).size
    assert missed <= 5


def keys(text):
    """The members of the balls around each segment."""
    return set(simhash.ball_keys(simhash.margins(np.unique(simhash.shingle_hashes(text, 5)))[None])[1].ravel().tolist())


def star_and_drift():
    """Variants of one text, each similar to it and not to each other, and versions that drift."""
    rng = random.Random(11)
    base = [f"w{rng.getrandbits(30)}" for _ in range(204)]
    made = {5_000: " ".join(base)}
    for n in range(300):
        words = list(base)
        for at in rng.sample(range(5, 199, 6), 4):
            words[at] = f"v{n}x{at}"
        made[n + (0 if n < 150 else 9_000)] = " ".join(words)
    drift = [f"d{rng.getrandbits(30)}" for _ in range(204)]
    for n in range(80):
        drift[(6 * n + 5) % 204] = f"e{n}"
        drift[(6 * n + 95) % 204] = f"f{n}"
        made[20_000 + n * 37 % 80] = " ".join(drift)
    return made


def test_all_members_of_a_key_are_compared(spark):
    """Whatever the ends of a key are, all similar pairs that share one are joined."""
    made = star_and_drift()
    held = {i: shingles(t) for i, t in made.items()}
    similar = lambda a, b: len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])
    met = {i: keys(t) for i, t in made.items()}
    most = {i for i, label in groups(sorted(made), lambda a, b: not met[a].isdisjoint(met[b]) and similar(a, b)).items() if i == label}
    least = {i for i, label in groups(sorted(made), similar).items() if i == label}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert least <= kept <= most and len(most) < 12


def test_rest_holds_every_similar_pair(spark):
    """Prefixes of rare shingles lose no pair, whatever the numbers of shingles are."""
    rng = random.Random(7)
    made = list(star_and_drift().values())[::5]
    for n in (1, 2, 3, 5, 9, 10, 40, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(n + 4)]
        made += [" ".join(base[: len(base) - rng.randrange(1 + n // 4)] + [f"t{rng.randrange(3)}"]) for _ in range(8)]
    made = list(dict.fromkeys(made))
    texts = spark.createDataFrame(list(enumerate(made)), "node long, _t string")
    members = spark.createDataFrame([(i, i if i % 7 else -1) for i in range(len(made))], "node long, label long")
    got = {(r["a"], r["b"]) for r in simhash._rest(texts, members, 5, 0.8).collect()}
    held = [shingles(t) for t in made]
    similar = {(a, b) for a in range(len(made)) for b in range(a + 1, len(made)) if (a % 7 or b % 7) and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    assert similar <= got and len(similar) > 50 and all(a % 7 or b % 7 for a, b in got)


def test_one_id_of_two_texts(spark):
    """A text that shares its id with a near copy isn't taken for it."""
    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.getrandbits(30)}" for _ in range(200))
    base, other, third = prose(), prose(), prose()
    rows = [(1, base), (2, base + " tail"), (2, other), (3, third), (3, third + " end"), (None, third + " more")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and {(r["doc_id"], r["text"][:40]) for r in kept} == {(i, t[:40]) for i, t in [(1, base), (2, other), (3, third)]}


def test_the_driver_gathers_what_was_measured(spark):
    """Exploded rows are many more than the file that they come from: no join's side goes to the driver by the file's size."""
    rng = random.Random(13)
    made = [" ".join(f"w{rng.getrandbits(30)}" for _ in range(4)) for _ in range(4_000)]
    made += [t.upper() for t in made[:50]]
    before = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.maxBroadcastTableSize": "3m"}
    held = {k: spark.conf.get(k, None) for k in [*before, "spark.sql.adaptive.autoBroadcastJoinThreshold"]}
    try:
        for k, v in before.items():
            spark.conf.set(k, v)
        result = simhash.near_duplicates(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result.collect()}
        assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) == held["spark.sql.adaptive.autoBroadcastJoinThreshold"]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    prints = np.array([by_definition(t) for t in made], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 2).tolist() for p in prints]
    labels = list(range(len(made)))
    while (then := [min(labels[j] for j in js) for js in near]) != labels:
        labels = then
    assert got == {i: (f"{int(prints[i]):016x}", labels[i]) for i in range(len(made))}
