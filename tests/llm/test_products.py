"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pytest
from cases import bag
from pyspark.sql import functions as F

from tidemark.llm import products

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, _norm string"
NULL_FIRST = -(2**63)


def codes(vector, scale=256.0):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def brute(rows, every, k):
    vectors = [(r[0], c) for r in rows if (c := codes(r[1])) is not None]
    out = []
    for n, (query, a) in enumerate(vectors):
        if query is None or query % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), NULL_FIRST if v is None else v, m)
            for m, (v, b) in enumerate(vectors)
            if m != n and len(a) == len(b)
        )
        out += [(query, i, vectors[m][0], -s) for i, (s, _, m) in enumerate(scored[:k], 1)]
    return bag(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def search(df, every=5, k=5, **sizes):
    got = products.top_products(df, F.col("vec_id") % every == 0, k, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return bag(got.collect())


def vectors(seed, kind):
    rnd = np.random.default_rng(seed)
    n = 400
    if kind == "unit":
        x = rnd.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "lengths":
        x = rnd.normal(size=(n, 8)) * rnd.lognormal(0, 2, n)[:, None]
    elif kind == "clusters":  # narrow: local cosine thresholds near one
        x = np.eye(32)[rnd.integers(0, 32, n)] + rnd.normal(scale=0.01, size=(n, 32))
    else:  # a third of all vectors is the same
        x = rnd.normal(size=(n, 4))
        x[: n // 3] = 1.0
    return [(int(k), [float(np.float32(v)) for v in row]) for k, row in zip(rnd.permutation(n) - 20, x)]


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "same"])
@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 7, "partition_rows": 20, "portion_bytes": 2_000}])
def test_top_products(spark, kind, sizes):
    rows = vectors(len(kind), kind)
    assert search(frame(spark, rows), **sizes) == brute(rows, 5, 5)


def test_coordinates_are_used(monkeypatch):
    """Clusters along the axes leave few candidates on a query's axis."""
    rows = np.floor(256 * np.array([r[1] for r in vectors(8, "clusters")])).astype(np.int64)
    norms = (rows * rows).sum(axis=1)
    order = np.argsort(-norms)
    b = {"_part": 0, "_bucket": 0, "_norms": norms[order], "_codes": rows[order].ravel(), "_ids": order}
    score = rows[:20] @ rows.T
    bounds = np.sort(score, axis=1)[:, -5].astype(float)
    own = np.array([(0, 0, int(np.flatnonzero(order == q)[0])) for q in range(20)])
    portion = products.Portion(np.arange(20), rows[:20], norms[:20], own, bounds)
    best, sizes = products.Best(bounds, 5), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda q, s, i: (sizes.append(len(set(q.tolist()))), add(q, s, i)))
    products._search_bucket(portion, b, best, 5)
    best.settle()
    assert len(sizes) >= 15  # one call a query by coordinate, one a block by length
    for q in range(20):
        want = sorted((-int(s), i) for i, s in enumerate(score[q]) if i != q)[:4]
        got = [(-s, i) for k, s, i in zip(*(x.tolist() for x in best.held)) if k == q]
        assert got[:4] == want


def test_awkward_vectors(spark):
    rnd = random.Random(3)
    rows = [
        (0, None), (5, [None, 1.0]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, []), (25, []),
        (30, [1.0, -1.0]), (30, [1.0, -1.0]), (None, [1.0, -1.0]), (35, [0.0, 0.0]), (40, [1.0, 2.0, 3.0]),
        (45, [-1e-9, 1e-9]), (-50, [1e6, -1e6]), (7, [-1.0, 1.0]),
    ]
    rows += [(k, [rnd.uniform(-2, 2), rnd.uniform(-2, 2)]) for k in range(100, 140)]
    rows += [(None, [1.5, -1.5])]
    for sizes in ({}, {"bucket_rows": 3, "partition_rows": 4}):
        assert search(frame(spark, rows), **sizes) == brute(rows, 5, 5)
    assert search(frame(spark, rows[:5])) == []
    assert search(frame(spark, rows[4:6])) == [(20, 1, 25, 0), (25, 1, 20, 0)]
    assert search(frame(spark, [])) == []


def test_large_components(spark):
    """Products beyond 53 bits stay exact; vectors too long for a long take no part."""
    rnd = random.Random(4)
    rows = [(k, [float(np.float32(rnd.uniform(-4e6, 4e6))) for _ in range(3)]) for k in range(60)]
    huge = [(100, [1e30, 0.0, 0.0]), (105, [3e7, 0.0, 0.0])]
    assert search(frame(spark, rows + huge), bucket_rows=8) == brute(rows, 5, 5)
