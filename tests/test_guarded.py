"""Searches that judge queries first, with a limit or a budget per query."""

import json

import pytest

from tessera.limits import MAX_QUERY_BYTES
from tessera.plans import guarded, recall, search
from tests.helpers import simple_store
from tests.test_dense import M, vector
from tests.test_retrieval import index_of

N = 30
SCHEMA = (
    "query_id bigint, query string, scope_id bigint, include_global boolean, label_ids array<bigint>, "
    "before_id bigint, limit bigint, max_bytes bigint"
)
VECTORS = "query_id bigint, vector array<float>"
LIMIT = "limit must be between 1 and 50"
BUDGET = "max_bytes must be between 4000 and 32000"


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("guarded")
    store = simple_store(
        spark, root / "s", [(f"title {i}", "needle " + "hay " * 300) for i in range(N)],
        embeddings=[vector(i, (1.0, 0.0)) for i in range(1, N + 1)],
    )
    return store, index_of(spark, store, root / "i")


def batch(spark, cases):
    rows = [
        [i, c.get("query", "needle"), c.get("scope", 1), False, c.get("labels"), c.get("before"),
         c.get("limit"), c.get("max_bytes")]
        for i, c in enumerate(cases)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_query(df, order):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r[order] or 0)):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_search_refuses_and_limits_per_query(spark, ledger):
    store, index = ledger
    cases = [
        (dict(), None, 20),
        (dict(limit=3), None, 3),
        (dict(limit=50), None, 30),
        (dict(query=None, limit=2), None, 2),
        (dict(query=" \n", limit=4, before=4), None, 3),
        (dict(query="absent"), None, 0),
        (dict(labels=[1, 1], limit=5), None, 5),
        (dict(limit=0), LIMIT, 0),
        (dict(limit=51), LIMIT, 0),
        (dict(scope=0, limit=0), "scope_id must be positive", 0),
        (dict(scope=None), "scope_id must be positive", 0),
        (dict(query="é" * (MAX_QUERY_BYTES // 2) + "e"), "search query exceeds 256 bytes", 0),
        (dict(query="é" * (MAX_QUERY_BYTES // 2)), None, 0),
        (dict(labels=[0], scope=99), "label_ids must be positive", 0),
        (dict(labels=[1] * 101), "label_ids cannot contain more than 100 items", 0),
        (dict(before=0), "before_id must be positive", 0),
        (dict(scope=99, labels=[77]), "scope 99 does not exist", 0),
        (dict(labels=[1, 77]), "label does not exist", 0),
    ]
    got = by_query(guarded.search_records(store, index, batch(spark, [c for c, _, _ in cases])), "position")
    assert sorted(got) == list(range(len(cases)))
    for i, (case, reason, size) in enumerate(cases):
        rows = got[i]
        assert {r["reason"] for r in rows} == {reason}, case
        assert {r["outcome"] for r in rows} == {"answered" if reason is None else "refused"}
        ids = [r["record_id"] for r in rows if r["record_id"] is not None]
        assert len(ids) == size and len(rows) == max(1, size), case
        newest = (case.get("before") or N + 1) - 1
        assert ids == list(range(newest, newest - size, -1))
    assert [got[i][0]["next_before_id"] for i in (0, 1, 2, 3, 4)] == [11, 28, None, 29, None]


def test_a_bad_query_changes_no_other_answer(spark, ledger):
    store, index = ledger
    good = [dict(limit=3), dict(query="hay", limit=7)]
    alone = by_query(guarded.search_records(store, index, batch(spark, good)), "position")
    mixed = by_query(
        guarded.search_records(store, index, batch(spark, [*good, dict(limit=99), dict(scope=-1)])), "position"
    )
    assert all(mixed[i] == alone[i] for i in alone)
    plain = search.search_records(store, index, batch(spark, good[:1]).drop("limit"), 3)
    assert [r["record_id"] for r in by_query(plain, "position")[0]] == [r["record_id"] for r in alone[0]]


def test_no_rows_and_only_refusals(spark, ledger):
    store, index = ledger
    assert guarded.search_records(store, index, batch(spark, [{}]).limit(0)).collect() == []
    rows = guarded.search_records(store, index, batch(spark, [dict(limit=0)])).collect()
    assert [(r["outcome"], r["record_id"]) for r in rows] == [("refused", None)]


def test_semantic_limits_and_vectors(spark, ledger):
    store, _ = ledger
    cases = [dict(limit=2), dict(limit=50), {}, dict(limit=0), dict(), dict(), dict(scope=99)]
    vectors = [(1.0, 0.0)] * 4 + [(2.0, 0.0), None, (1.0, 0.0)]
    asked = spark.createDataFrame(
        [[i, [float(x) for x in v]] for i, v in enumerate(vectors) if v], VECTORS
    )
    embeddings = store.read("record_embeddings")
    got = by_query(guarded.semantic_search(store, embeddings, batch(spark, cases), asked, *M), "dense_rank")
    assert [len(got[i]) for i in range(3)] == [2, 30, 20]
    assert [r["record_id"] for r in got[0]] == [30, 29]
    assert [got[i][0]["reason"] for i in range(3, 7)] == [
        LIMIT, "embedding must be L2-normalized", "embedding has invalid dimensions or values",
        "scope 99 does not exist",
    ]
    late = embeddings.filter("record_id > 2")
    waiting = by_query(guarded.semantic_search(store, late, batch(spark, cases), asked, *M), "dense_rank")
    assert waiting[0][0]["reason"] == "embedding index has 2 pending records; run sync_embeddings"
    assert waiting[3][0]["reason"] == LIMIT and all(len(rows) == 1 for rows in waiting.values())


def test_recall_packs_by_each_budget(spark, ledger):
    store, index = ledger
    cases = [dict(max_bytes=4000), dict(max_bytes=32000), {}, dict(max_bytes=3999), dict(max_bytes=32001),
             dict(query=" "), dict(query="absent", scope=2, max_bytes=5000), dict(scope=99), dict(max_bytes=1, scope=0)]
    asked = spark.createDataFrame([[i, [1.0, 0.0]] for i in range(len(cases))], VECTORS)
    embeddings = store.read("record_embeddings")
    rows = guarded.recall_context(store, index, batch(spark, cases), asked, embeddings, *M).collect()
    got = {r["query_id"]: r for r in rows}
    assert len(rows) == len(cases)
    assert [got[i]["reason"] for i in range(len(cases))] == [
        None, None, None, BUDGET, BUDGET, "recall query must not be empty", None, "scope 99 does not exist", BUDGET,
    ]
    for i, budget in [(0, 4000), (1, 32000), (2, 12000), (6, 5000)]:
        result = json.loads(got[i]["result"])
        assert result["budget_bytes"] == budget
        assert result["used_bytes"] == got[i]["used_bytes"] == len(got[i]["result"].encode()) <= budget
        assert len(result["records"]) == got[i]["n_records"]
    assert got[0]["n_records"] <= got[1]["n_records"] == 5 and got[6]["n_records"] == 0
    assert got[0]["used_bytes"] < got[1]["used_bytes"]
    one = recall.recall_context(
        store, index, batch(spark, cases[:1]).drop("max_bytes"), asked, embeddings, *M, budget=4000
    ).first()
    assert one["result"] == got[0]["result"]


def test_hits_with_their_documents(spark, ledger):
    store, index = ledger
    cases = [dict(limit=2), dict(limit=0)]
    hits = guarded.search_records(store, index, batch(spark, cases))
    rows = by_query(guarded.with_documents(store, hits), "position")
    assert [(r["title"], r["scope_name"], r["n_revisions"]) for r in rows[0]] == [
        ("title 29", "work", 1), ("title 28", "work", 1),
    ]
    assert rows[1][0]["reason"] == LIMIT and rows[1][0]["title"] is None
