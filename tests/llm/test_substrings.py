"""Substring dedup against brute force."""

import random
from collections import Counter

from tessera.llm import substrings
from tests.llm.helpers import by_id, edge_docs, edge_rows, no_docs, row, words


def brute(rows, span):
    split = [(r[1] or "").encode().split() for r in rows]
    runs = Counter(tuple(w[p : p + span]) for w in split for p in range(len(w) - span + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(w) - span + 1):
            if runs[tuple(w[p : p + span])] > 1:
                gone.update(range(p, p + span))
        kept = [x.decode() for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), " ".join(kept)))
    return out


def test_edges(spark):
    got = substrings.drop_repeated_runs(edge_docs(spark))
    assert by_id(got.collect()) == by_id(brute(edge_rows(), 35))


def test_shifted_passages(spark):
    """Passages at all offsets of the grid, overlapping, within one document, and periodic ones."""
    rng = random.Random(4)
    pool = [words(rng.randint(30, 60), s) for s in range(8)]
    rows = []
    for i in range(70):
        text = words(rng.randint(0, 45), 100 + i)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            text += p[rng.randint(0, 9) :] + words(rng.randint(0, 5), 500 + i)
        rows.append(row(i, " ".join(text)))
    rows += [row(100, "x y z " * 30), row(101, "q " * 34), row(102, "u " * 35), row(103, "v " * 36)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(5)
    assert by_id(substrings.drop_repeated_runs(docs).collect()) == by_id(brute(rows, 35))
    odd = substrings.drop_repeated_runs(docs, span=8, filter_bytes=8)
    assert by_id(odd.collect()) == by_id(brute(rows, 8))


def test_small_chunks(spark):
    docs = edge_docs(spark).select("doc_id", "text")
    chunks = substrings.chunked(docs, 500).collect()
    assert len(chunks) > 5
    rows = [t for c in chunks for t in substrings.unpacked(c["pack"]).to_pylist()]
    assert by_id((r["doc_id"], r["text"]) for r in rows) == by_id((r[0], r[1]) for r in edge_rows())


def test_empty_and_carried(spark):
    assert substrings.drop_repeated_runs(no_docs(spark)).collect() == []
    carried = substrings.drop_repeated_runs(edge_docs(spark), carry=["row", "lang"])
    assert carried.filter("row.row = 'r'").count() == len(edge_rows())
