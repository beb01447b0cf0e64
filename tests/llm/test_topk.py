"""Exact top-k search against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk
from tests.llm.helpers import by_id

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, size int, query string, block int"


def brute(rows, k, scale=64):
    ok = [
        (r[0], [math.floor(scale * x) for x in np.array(r[1], np.float32).astype(float).tolist()])
        for r in rows
        if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    out = []
    for q in {i for i, _ in ok if i % 20 == 0}:
        best = {}
        for own in (v for i, v in ok if i == q):
            for i, v in ok:
                if i != q and len(v) == len(own):
                    s = sum(a * b for a, b in zip(own, v, strict=True))
                    best[i] = max(s, best.get(i, s))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n, i, s) for n, (i, s) in enumerate(ranked, 1)]
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(*r, 1, 2, 3, "q", 4) for r in rows], SCHEMA)
    return topk.top_k(df, F.coalesce(df["vec_id"] % 20 == 0, F.lit(False)), k)


def vectors(n, d, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(d)]) for i in range(n)]


def test_edges(spark):
    rows = vectors(90, 6, 1)
    rows += [(None, [1.0] * 6), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [math.inf] * 6)]
    rows += [(20, [0.5] * 6), (7, [3.0] * 6), (7, [3.0] * 6), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, []), (321, [])]
    rows += [(i, [0.25] * 6) for i in range(400, 460)]  # ties
    assert by_id(run(spark, rows, 20).collect()) == by_id(brute(rows, 20))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = vectors(700, 16, 2, 0.2)
    assert by_id(run(spark, rows, 5).collect()) == by_id(brute(rows, 5))


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(3)
    values = np.floor(64 * rng.standard_normal((3000, 3)) ** 3)
    queries = np.floor(64 * rng.standard_normal((20, 3)))
    rows, at, score = topk.search_block(values, np.arange(3000), queries, np.arange(-20, 0), 10)
    exact = (queries @ values.T).astype(np.int64)
    for i in range(20):
        want = sorted(range(3000), key=lambda j: (-exact[i, j], j))[:10]
        assert at[rows == i].tolist() == want and score[rows == i].tolist() == exact[i, want].tolist()


def test_large_numbers():
    values, queries = np.array([[2**40, 1], [2**40, 2]]), np.array([[2**20, 3]])
    _, at, score = topk.search_block(values, np.array([1, 2]), queries, np.array([9]), 2)
    assert at.tolist() == [1, 0] and score.tolist() == [2**60 + 6, 2**60 + 3]


def test_empty(spark):
    assert run(spark, [], 3).collect() == []
