"""Near-duplicates against brute force."""

import random

from tessera.llm import graph, minhash
from tests.llm.helpers import by_id, edge_docs, edge_rows, no_docs, row, words


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if None not in (rows[i][0], rows[j][0]) and a and b:
                if 100 * len(a & b) >= 75 * len(a | b) or rows[i][0] == rows[j][0]:
                    root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        least = None if r[0] is None else min(groups[find(i)])
        out.append((r[0], len(sets[i]), least, r[0] is None or r[0] == least))
    return out


def test_edges(spark):
    got = minhash.link_near_duplicates(edge_docs(spark))
    assert by_id(got.collect()) == by_id(brute(edge_rows()))


def test_chains_of_near_copies(spark):
    """Copies of copies drift away: ends of a chain are joined only through the middle."""
    rng = random.Random(7)
    rows = []
    for g in range(12):
        text = words(rng.choice([6, 9, 40, 120]), g)
        for _ in range(12):
            rows.append(row(rng.randint(0, 10**9), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(1000)}"
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(4)
    assert by_id(minhash.link_near_duplicates(docs).collect()) == by_id(brute(rows))


def test_large_group_of_drifting_copies(spark):
    """Each document is a copy of a random earlier one with one word changed: 76 % in common."""
    rng = random.Random(11)
    texts = [words(41, 5)]
    for i in range(1, 2_000):
        text = list(rng.choice(texts))
        text[rng.randrange(8, 33)] = f"new{i}"
        texts.append(text)
    ids = rng.sample(range(10**6), len(texts))
    docs = spark.createDataFrame(
        [row(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], edge_docs(spark).schema
    ).repartition(4)
    got = minhash.link_near_duplicates(docs).collect()
    assert len(got) == len(texts)
    assert {r["component_id"] for r in got} == {min(ids)}


def test_work_grows_with_the_group(spark, monkeypatch):
    """Measured pairs and links that components follow, for one group of near copies of a text."""
    pairs, links = [], []
    measured, components = minhash.measured, graph.components
    monkeypatch.setattr(minhash, "measured", lambda p, *a: (pairs.append(p.count()), measured(p, *a))[1])
    for module in (minhash, graph):
        monkeypatch.setattr(module, "components", lambda e, *a: (links.append(e.count()), components(e, *a))[1])
    base, rng = words(80, 21), random.Random(2)
    for n in (500, 1_000, 2_000):
        pairs.clear()
        links.clear()
        rows = [row(1, " ".join(base))]
        for i in range(2, n + 1):
            text = list(base)
            text[rng.randrange(80)] = f"other{i}"
            rows.append(row(i, " ".join(text)))
        docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(4)
        assert {r["component_id"] for r in minhash.link_near_duplicates(docs).collect()} == {1}
        assert sum(pairs) < 2 * n and sum(links) < 2 * n


def groups_in_a_bucket(n, rng):
    """Rows of groups with a passage in common: near copies within a group, unlike texts across."""
    common, rows = words(60, 41), []
    for g in range(n):
        own = words(30, 100 + g)
        for i in range(3):
            text = common + own
            text[rng.randrange(60, 90)] = f"g{g}x{i}"
            rows.append(row(1000 + 10 * g + i, " ".join(text)))
    return rows


def test_few_pairs_follow_at_once(spark, monkeypatch):
    """Rounds of stars cost far more than the few pairs that are left in small buckets."""
    rounds, measured = [], minhash.measured
    monkeypatch.setattr(minhash, "measured", lambda *a: (rounds.append(1), measured(*a))[1])
    rows = groups_in_a_bucket(40, random.Random(3))
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(4)
    assert by_id(minhash.link_near_duplicates(docs).collect()) == by_id(brute(rows))
    assert len(rounds) == 2  # members with centers only: unlike texts are told by their parities


def test_many_pairs_follow_after_stars(spark, monkeypatch):
    """The rounds for large buckets, slices and shuffled edges give the same components."""
    monkeypatch.setattr(minhash, "PAIRS_A_PLACE", 0)
    monkeypatch.setattr(minhash, "TURN_PAIRS", 500)
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    rows = groups_in_a_bucket(25, random.Random(5)) + edge_rows()
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(4)
    assert by_id(minhash.link_near_duplicates(docs).collect()) == by_id(brute(rows))


def test_few_edges_without_a_shuffle(spark, monkeypatch):
    plans, saved = [], graph.saved
    monkeypatch.setattr(
        graph, "saved", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), saved(df, name))[1]
    )
    edges = saved(spark.range(40).selectExpr("id as a", "id + 1 as b"), "edges")
    assert {r["component"] for r in graph.components(edges, "a", "b").collect()} == {0}
    assert plans and not any("hashpartitioning" in plan for plan in plans)


def test_ids_with_several_sets(spark):
    """Rows of one id in several groups join these, whatever the sizes of their sets."""
    a, b, c = (words(n, s) for n, s in ((60, 31), (90, 32), (40, 33)))
    rows = []
    for i in range(30):
        for at, base in enumerate((a, b, c)):
            text = list(base)
            text[rng_place(i, len(text))] = f"v{i}x{at}"
            rows.append(row(100 * at + i + 1, " ".join(text)))
    rows += [row(5, " ".join(b)), row(5, " ".join(b[:-1])), row(105, " ".join(c)), row(105, " ".join(c))]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(4)
    assert by_id(minhash.link_near_duplicates(docs).collect()) == by_id(brute(rows))


def rng_place(i, n):
    return (7 * i + 3) % n


def test_extended_labels(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]

    def frame(rows):
        return spark.createDataFrame(rows, "a bigint, b bigint")

    labels = graph.components(frame(edges[:100]), "a", "b")
    for at in (100, 180):
        labels = graph.extended(labels, frame(edges[at : at + 80]), "a", "b")
    want = graph.components(frame([e for e in edges if e[0] != e[1]]), "a", "b")
    loops = {e[0] for e in edges if e[0] == e[1]}
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert {n: c for n, c in got.items() if n not in loops} == {
        r["node"]: r["component"] for r in want.collect() if r["node"] not in loops
    }


def test_empty(spark):
    assert minhash.link_near_duplicates(no_docs(spark)).collect() == []


def test_drop_keeps_columns(spark):
    kept = minhash.drop_near_duplicates(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and 8 not in ids and 5 not in ids and 4 in ids


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 200), (300, 300)]
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    want = [(i, 1) for i in range(1, 61)] + [(100, 100), (200, 100), (300, 300)]
    assert by_id(got.collect()) == by_id(want)
