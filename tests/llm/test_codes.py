"""Vector codes against k-means that looks at all entries, in integers of Python."""

import math
import random

import numpy as np
import pytest

from tessera.llm import codes
from tests.compare import compare, connect
from tests.llm.helpers import by_id

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, codes int, error int, part int"


def integers(vector, scale=1024):
    return [math.floor(scale * float(np.float32(v))) for v in vector]


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(r[0], r[2], integers(r[1])) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = [r for r in kept if len(r[2]) % parts == 0]
    sizes = [len(r[2]) for r in kept]
    usual = max(sorted(set(sizes)), key=sizes.count)
    kept = [r for r in kept if len(r[2]) == usual]
    width = usual // parts
    cut = [[tuple(r[2][p * width : (p + 1) * width]) for p in range(parts)] for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), at) for at, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for at, vs in members.items():
                books[p][at] = tuple(sum(v[i] for v in vs) // len(vs) for i in range(width))
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    out = [
        (r[0], r[1], bytes(at for _, at in f), e if (e := sum(d for d, _ in f)) < 2**63 else None)
        for r, f in zip(kept, found, strict=True)
    ]
    return out, [[list(e) for e in b] for b in books]


def result(df, **options):
    coded, books = codes.encode(df, **options)
    rows = [(r["vec_id"], r["label"], bytes(r["codes"]), r["error"]) for r in coded.collect()]
    return by_id(rows), books.tolist()


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    want, books = brute(rows, **options)
    assert result(df, **options) == (by_id(want), books)


def clustered(n, width, seed, spread=0.05):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [
        (i, [c + rng.gauss(0, spread) for c in rng.choice(centers)], rng.choice([None, 1, 2]))
        for i in rng.sample(range(10 * n), n)
    ]


def test_against_brute_force(spark):
    check(spark, clustered(300, 8, 1))
    check(spark, clustered(200, 4, 2), entries=20, rounds=6)
    check(spark, clustered(90, 16, 3, spread=2), entries=7, parts=2)


def test_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 40, [float(i % 3), 0.0, 1.0, -1.0] * 2, 1) for i in range(90)]  # few vectors, many ties
    rows += [(None, [0.5] * 8, None), (-3, [0.25] * 8, None), (-3, [0.125] * 8, 2), (7, None, 1), (8, [], 1)]
    rows += [(9, [nan] + [0.0] * 7, 1), (10, [inf] + [0.0] * 7, 1), (11, [None] + [0.0] * 7, 1)]
    rows += [(-9, [1.0] * 4, 1), (-8, [1.0] * 7, 1), (12, [-0.0001] * 8, 1)]
    check(spark, rows, entries=16)
    check(spark, rows[:3])


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 6, 12]) for _ in range(4)], 1) for i in range(60)]
    check(spark, rows, entries=9)


def test_empty(spark):
    for rows in ([], [(1, None, 1, 1, 1, 1, 1)]):
        coded, books = codes.encode(spark.createDataFrame(rows, SCHEMA))
        assert coded.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.encode(spark.createDataFrame([], SCHEMA), entries=257)


def test_balls_skip_work():
    """Rows near their entries look at few others; the result is that of the whole search."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-5000, 5000, (256, 16)).astype(float)
    own = rng.integers(0, 256, 4000)
    rows = entries[own] + rng.integers(-300, 300, (4000, 16))
    book = codes.Codebook(entries)
    want, far = codes.nearest(rows, book)
    got, found, looked = codes.nearest_in_balls(rows, book, own)
    assert (got == want).all() and (found == far).all()
    assert looked < 0.01 * 4000 * 256
    astray = rng.integers(0, 256, 4000)  # a wrong start gives the same
    got, found, _ = codes.nearest_in_balls(rows, book, astray)
    assert (got == want).all() and (found == far).all()


def test_statement(spark):
    sf = "/root/testdata/sf0.01"
    from tessera.llm.queries import ORACLES, QUERIES

    name = "op11_vector_codes"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
