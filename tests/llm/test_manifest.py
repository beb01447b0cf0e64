"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest
from tests.compare import compare, connect
from tests.llm.helpers import SCHEMA, by_id, edge_rows, no_docs, row


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def sides(levels, place):
    out = []
    for level in levels[:-1]:
        start = place // 8 * 8
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + 8])))
        place //= 8
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars, …"""
    groups = {}
    for r in rows:
        doc_id, text, lang, source, n = r[:5]
        own = leaf((doc_id, source, lang, n, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        shown = leaf((doc_id, source, lang, n, lowered(text))) if hit else own
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, shown, doc_id))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: grow([x[2] for x in sorted(groups[g])]) for g in order}
    top = grow([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for place, (_, _, own, shown, doc_id) in enumerate(sorted(groups[g])):
            path = sides(trees[g], place) + sides(top, at)
            for before, after in path:
                shown = digest(before + shown + after)
            root = top[-1][0]
            out.append((doc_id, own, trees[g][-1][0], root, digest("".join(b + a for b, a in path)), shown, shown == root))
    return out


def query(docs, levels=manifest.LEVELS):
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return manifest.verify_dataset(docs, tampered, levels=levels).drop("before", "after")


def many(n, langs, seed):
    rng = random.Random(seed)
    return [row(rng.randrange(n), rng.choice([f"Text {i}", "same", "SAME", None, ""]), rng.choice(langs)) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, ["en"]), (300, ["en", None, "", "de"]), (700, [f"l{i}" for i in range(90)])])
@pytest.mark.parametrize("levels", [1, manifest.LEVELS])
def test_against_brute_force(spark, n, langs, levels):
    rows = many(n, langs, n)
    got = query(spark.createDataFrame(rows, SCHEMA), levels).collect()
    assert by_id(got) == by_id(brute(rows))


def test_odd_rows(spark):
    # one id holds a third of all rows, in equal and in different texts
    rows = edge_rows() + [row(77, "A hot row")] * 12 + [row(77, f"Hot {i}") for i in range(5)]
    got = query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert by_id(got) == by_id(brute(rows))
    assert {r["verified"] for r in got} == {True, False}
    assert query(no_docs(spark)).collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame(many(40, ["en", "de"], 3), SCHEMA)
    plain = by_id(query(docs).collect())
    for name in ("g", "digest", "tree", "size", "at", "before", "after", "subroot", "written", "part", "tampered"):
        docs = docs.withColumn(name, F.lit(name))
    assert by_id(query(docs).collect()) == plain


def test_statement(spark):
    sf = "/root/testdata/sf0.01"
    from tessera.llm.queries import ORACLES, QUERIES

    name = "op12_merkle_manifest"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
