import math

import numpy as np
import pytest

from eventloom.llm import ann


def exact(rows, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % 20 == 0:
            scores = v @ q
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def test_recall_and_form(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r[1] for r in rows} & {w[0] for w in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_blocks_dimensions_ties_and_norms(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 5)).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 380)]
    df = spark.createDataFrame([*rows, (1000, [1.0, 2.0]), (1001, [2.0, 2.0])], "vec_id long, embedding array<double>").repartition(3)
    want, got = exact(rows), {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.pop(1000) == [(1001, 6.0)]
    assert sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert all(math.isclose(s, dict(want[q])[i], rel_tol=1e-12) for q in want for i, s in got[q] if i in dict(want[q]))


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "1 as _v", "1 as dim")
    assert [tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_of_skewed_norms(spark):
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((2000, 64))
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    one = np.ones((2000, 1))
    one[17] = 3
    for norms in (one, np.exp(0.5 * rng.standard_normal((2000, 1)))):
        rows = list(enumerate((unit * norms).tolist()))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        want, got = exact(rows), {}
        for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert sum(len(got[q] & {x for x, _ in want[q]}) for q in want) >= 0.93 * 20 * len(want)


def spread(kind, dim, n, rng):
    if kind == "unrelated":
        return rng.standard_normal((n, dim))
    centres = rng.standard_normal((40, dim))
    return centres[rng.integers(0, 40, n)] + 0.6 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("dim", [64, 128, 384])
@pytest.mark.parametrize("kind", ["unrelated", "clustered"])
def test_recall_by_dimension(kind, dim):
    """An index is fitted to how its vectors lie; where there are clusters, few are verified."""
    vectors = spread(kind, dim, 4000, np.random.default_rng(dim))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    block, asked = ann.Block(np.arange(4000), vectors), np.arange(0, 4000, 50)
    found = block.search(asked, vectors[asked], 20)
    products = vectors[asked] @ vectors.T
    products[np.arange(len(asked)), asked] = -np.inf
    nearest = np.argsort(-products, axis=1)[:, :20]
    assert np.mean([len(np.intersect1d(f[0], t)) / 20 for f, t in zip(found, nearest, strict=True)]) >= 0.93
    assert block.ranges[0].want(20) < (0.4 if kind == "clustered" else 1.01) * 4000
