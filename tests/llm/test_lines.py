"""Line dedup against brute force."""

from collections import defaultdict

import numpy as np

from tessera.llm import lines, seen
from tests.llm.helpers import by_id, edge_docs, edge_rows, no_docs, row

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    where = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            where[key(line)].add(r[0])
    out = []
    for r in rows:
        old = (r[1] or "").split("\n")
        kept = []
        for line in old:
            ids = {i for i in where[key(line)] if i is not None}
            gone = r[0] is not None and len(key(line)) >= 10 and len(ids) > 1 and r[0] != min(ids)
            if not gone:
                kept.append(line)
        out.append((r[0], len(old), len(old) - len(kept), "\n".join(kept)))
    return out


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def test_edges(spark):
    got = lines.drop_repeated_lines(edge_docs(spark))
    assert by_id(got.collect()) == by_id(brute(edge_rows()))


def test_random_lines_and_ties(spark):
    rows = [row(i, "\n".join(f"Line number {(i * j) % 37:04d} " + " " * (j % 3) for j in range(1, 15))) for i in range(60)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    got = lines.drop_repeated_lines(docs)
    assert by_id(got.collect()) == by_id(brute(rows))


def test_a_full_filter_changes_nothing(spark):
    got = lines.drop_repeated_lines(edge_docs(spark), filter_bytes=8)
    assert by_id(got.collect()) == by_id(brute(edge_rows()))


def test_empty_and_carried(spark):
    assert lines.drop_repeated_lines(no_docs(spark)).collect() == []
    carried = lines.drop_repeated_lines(edge_docs(spark), carry=["row", "source"])
    assert carried.select("row.row", "row.source").distinct().collect() == [("r", "s")]


def test_filters_miss_no_repeat(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 4000)
    df = spark.createDataFrame([(int(v),) for v in np.r_[values, values[:500], values[:20]]], "h bigint").repartition(7)

    def hashes_of(b):
        return [b.column("h").to_numpy().astype(np.uint64)]

    once, twice = seen.build(df, hashes_of, seen.size_for(5000, 1 << 20), want_once=True)
    values = values.astype(np.uint64)
    assert once.has(values).all()
    assert twice.has(values[:500]).all()
    assert twice.has(values[500:]).mean() < 0.05
    assert once.has(rng.integers(0, 2**63, 4000).astype(np.uint64)).mean() < 0.05
