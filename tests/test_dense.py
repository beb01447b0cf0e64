import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, dense, views
from tessera.plans import recall, search
from tests.helpers import payload, rows_of, simple_store
from tests.test_retrieval import ask, found, index_of

M = ("m", "v1", 2)


def vector(record, values, revision=1, dims=None):
    return dict(record_id=record, revision=revision, model="m", model_revision="v1",
                dimensions=dims or len(values), vector=[float(v) for v in values])


BODIES = [("first", "no lexical match"), ("second", "dense needle"), ("third", "another body"),
          ("fourth", "another body"), ("fifth", "needle lexical only")]
VECTORS = [(0.8, 0.6), (1.0, 0.0), (0.6, 0.8), (0.6, 0.8), (0.0, 1.0)]


@pytest.fixture(scope="module")
def fused(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fused")
    store = simple_store(
        spark, root / "s", BODIES,
        embeddings=[vector(i, v) for i, v in enumerate(VECTORS, 1)],
    )
    return store, index_of(spark, store, root / "i")


def qvec(spark, *vectors):
    return spark.createDataFrame([[i, [float(x) for x in v]] for i, v in enumerate(vectors)],
                                 "query_id bigint, vector array<float>")


def test_dense_order_wins_and_lexical_fills_in(spark, fused):
    store, index = fused
    queries, vectors = ask(spark, "needle"), qvec(spark, (1, 0))
    rows = recall.recall_context(store, index, queries, vectors, store.read("record_embeddings"), *M,
                                 budget=4000, packed=False)
    assert found(rows, "position")[0] == [2, 1, 4, 3, 5]
    by_id = {r["record_id"]: r for r in rows.collect()}
    # 5 is in both lists; the shorter text ranks first lexically.
    assert by_id[2]["bm25_rank"] and by_id[5]["bm25_rank"]
    assert by_id[5]["dense_rank"] == 5 and by_id[1]["bm25_rank"] is None
    packed = recall.recall_context(store, index, queries, vectors, store.read("record_embeddings"), *M,
                                   budget=4000).first()
    assert '"strategy":"dense"' in packed["result"] and '"model":"m"' in packed["result"]


def test_recall_falls_back_when_a_vector_is_missing(spark, fused):
    store, index = fused
    some = store.read("record_embeddings").filter("record_id > 1")
    queries = ask(spark, "needle", "nothing here", " ")
    rows = recall.recall_context(store, index, queries, qvec(spark, (1, 0)), some, *M, budget=4000, packed=False)
    got = found(rows, "position")
    assert sorted(got[0]) == [2, 5] and 1 not in got
    packed = {
        r["query_id"]: r
        for r in recall.recall_context(store, index, queries, qvec(spark, (1, 0)), some, *M, budget=4000).collect()
    }
    assert '"strategy":"bm25","semantic_available":false,"model":null' in packed[0]["result"]
    assert packed[2]["error"] == "recall query must not be empty" and packed[2]["result"] is None
    assert packed[1]["n_records"] == 0 and packed[1]["used_bytes"] == len(packed[1]["result"].encode())


def test_semantic_search_is_gated(spark, fused):
    store, _ = fused
    some = store.read("record_embeddings").filter("record_id > 1")
    with pytest.raises(Exception, match="1 pending records"):
        search.semantic_search(store, some, ask(spark, "x"), qvec(spark, (1, 0)), *M).collect()


def brute(queries, records, k):
    out = {}
    for qid, v, scopes, kinds, lifecycles, labels in queries:
        hits = []
        for rid, scope, kind, life, w, held in records:
            if scope not in scopes or (kinds and kind not in kinds) or life not in (lifecycles or ["active"]):
                continue
            if not set(labels) <= set(held):
                continue
            hits.append((-round(sum(a * b for a, b in zip(v, w, strict=True)), 9), -rid))
        out[qid] = [-r for _, r in sorted(hits)[:k]]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("path", ["scan", "grid"])
def test_topk_against_brute_force(spark, path):
    rng = random.Random(11)

    def unit():
        # Few distinct directions, so equal vectors are common.
        a = rng.randint(0, 11) * math.pi / 12
        return [math.cos(a), math.sin(a)]

    kinds, lives = ["note", "idea"], ["active", "retracted"]
    records = [(i, rng.randint(1, 3), rng.choice(kinds), rng.choice(lives), unit(),
                rng.sample([1, 2, 3], rng.randint(0, 3))) for i in range(1, 301)]
    queries = [(q, unit(), rng.sample([1, 2, 3], rng.randint(1, 2)), rng.choice([[], ["idea"]]),
                rng.choice([[], ["retracted"], lives]), rng.choice([[], [1], [2, 3]])) for q in range(12)]
    vectors = spark.createDataFrame(
        [(i, s, k, life, [float(x) for x in v], held) for i, s, k, life, v, held in records],
        "record_id bigint, scope_id bigint, kind string, lifecycle string, vector array<double>, labels array<bigint>",
    ).repartition(5)
    asked = spark.createDataFrame(
        [(q, s, k, life, labels, v) for q, v, s, k, life, labels in queries],
        "query_id bigint, scope_ids array<bigint>, kinds array<string>, lifecycles array<string>, "
        "label_ids array<bigint>, query_vector array<double>",
    ).withColumn("before_id", F.lit(None).cast("bigint"))
    small = dict(broadcast_bytes=16, rows_per_cell=70, queries_per_cell=5) if path == "grid" else {}
    got = found(dense.dense_topk(asked, vectors, 2, 7, **small), "dense_rank")
    assert got == brute(queries, records, 7)


def test_index_life_cycle(spark):
    records = rows_of(spark, "records", [
        dict(id=i, scope_id=1, kind="note", lifecycle="active", current_revision=2 if i == 1 else 1, readable=i < 4)
        for i in range(1, 5)
    ])
    stored = rows_of(spark, "record_embeddings", [vector(i, (1, 0)) for i in range(1, 4)])
    status = dense.embedding_status(records, stored, *M).first()
    assert (status["eligible_records"], status["indexed_records"], status["pending_records"]) == (3, 2, 1)
    assert [r[0] for r in dense.embedding_pending(records, stored, *M).collect()] == [1]
    incoming = rows_of(spark, "record_embeddings", [
        vector(1, (0, 1), 1), vector(2, (0, 1)), vector(3, (0, 2)), vector(4, (1, 0)), vector(9, (1, 0)),
    ])
    after, outcome = dense.embedding_upsert(records, stored, incoming)
    assert {r["record_id"]: r["outcome"] for r in outcome.collect()} == {
        1: "stale", 2: "applied", 3: "invalid", 4: "missing", 9: "missing"}
    assert {r["record_id"]: list(r["vector"]) for r in after.collect()} == {
        1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.0]}
    current = rows_of(spark, "record_embeddings", [vector(1, (0, 1), 2)])
    after, _ = dense.embedding_upsert(records, after, current)
    assert dense.embedding_status(records, after, *M).first()["pending_records"] == 0


def test_sync_embeds_only_what_is_pending(spark):
    records = rows_of(spark, "records", [
        dict(id=i, scope_id=1, kind="note", lifecycle="active", current_revision=1, readable=True) for i in (1, 2)])
    revisions = rows_of(spark, "record_revisions", [
        dict(record_id=i, revision=1, title="t", payload=payload(body="b" * i)) for i in (1, 2)])
    stored = rows_of(spark, "record_embeddings", [vector(1, (1, 0))])

    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [3.0, 4.0] if t == "t bb" else [0.0, 0.0])

    after, outcome = dense.embedding_sync(records, revisions, stored, embed, *M)
    assert {r["record_id"]: [round(x, 6) for x in r["vector"]] for r in after.collect()} == {
        1: [1.0, 0.0], 2: [0.6, 0.8]}
    assert [r["record_id"] for r in outcome.collect()] == [2]


def test_budget(spark, tmp_path):
    lead, trail = "leading context " * 80, "trailing context " * 80
    bodies = [(f"Observation {i}", f"{lead}query-relevant-marker {trail}") for i in range(5)]
    sources = [dict(id=i * 10 + p, record_id=i, revision=1, position=p, identity=f"source-{p}", quote="q" * 500)
               for i in range(1, 6) for p in range(4)]
    store = simple_store(spark, tmp_path / "s", bodies, sources=sources)
    index = index_of(spark, store, tmp_path / "i")
    none = store.read("record_embeddings")
    import json

    row = recall.recall_context(store, index, ask(spark, "query-relevant-marker"), qvec(spark, (1, 0)), none, *M,
                                budget=4000).first()
    result = json.loads(row["result"])
    assert 3 <= len(result["records"]) <= 5
    assert result["used_bytes"] == row["used_bytes"] == len(row["result"].encode()) <= 4000
    for r in result["records"]:
        assert "query-relevant-marker" in r["excerpt"] and len(r["excerpt"].encode()) < 1000
        assert len(r["sources"]) == 3 and r["source_count"] == 4 and "quote" not in r["sources"][0]
    wide = recall.recall_context(store, index, ask(spark, "query-relevant-marker"), qvec(spark, (1, 0)), none, *M,
                                 budget=32000).first()
    assert len(json.loads(wide["result"])["records"]) == 5
    assert all(600 < len(r["excerpt"].encode()) <= 643 for r in json.loads(wide["result"])["records"])


def naive_pack(head, rows, budget):
    """The same rule with every trial encoded in full."""
    import json

    from tessera.functions.excerpt import centred, window

    def build(count, size):
        shown = [{**r["evidence"], "excerpt": window(*centred(r["text"], r["query"]), size)} for r in rows[:count]]
        result = {**head, "budget_bytes": budget, "used_bytes": 0, "records": shown}
        while True:
            text = json.dumps(result, ensure_ascii=False, separators=(",", ":"))
            if len(text.encode()) == result["used_bytes"]:
                return text
            result["used_bytes"] = len(text.encode())

    fits = lambda text: len(text.encode()) <= budget
    fewest = min(3, len(rows))
    for count in range(len(rows), fewest - 1, -1):
        if fits(build(count, 160)):
            best = max(s for s in range(160, 641) if s == 160 or fits(build(count, s)))
            return count, best, build(count, best)
    return fewest, None, build(fewest, 0)


def test_pack_against_trial_encoding():
    rng = random.Random(2)
    for _ in range(25):
        # Without accents the size grows with the excerpt, so halving finds the maximum.
        rows = [{"evidence": {"record_id": i, "excerpt": "", "pad": "x" * rng.randint(10, 900)},
                 "text": "word " * rng.randint(5, 300), "query": "none"} for i in range(rng.randint(0, 5))]
        budget = rng.randint(1500, 5000)
        head = {"strategy": "bm25", "semantic_available": False, "model": None, "model_revision": None}
        text, used, count, error = recall.pack(head, rows, budget)
        want_count, best, want = naive_pack(head, rows, budget)
        if best is not None:
            assert (count, text) == (want_count, want) and used == len(text.encode()) <= budget
        elif len(want.encode()) > budget:
            assert error and text is None
        else:
            assert used == len(text.encode()) <= budget and count == want_count


def test_hidden_records_stay_out_of_documents(spark, fused):
    store, _ = fused
    doc = {r["record_id"]: r for r in views.record_document(store).collect()}
    assert set(doc) == {1, 2, 3, 4, 5}
    assert [x["canonical"] for x in doc[1]["labels"]] == ["workflow:inbox"]


def test_vectors_meet_records_without_a_shuffle(spark, fused):
    store, _ = fused
    from tessera.sources.store import LedgerStore

    again = LedgerStore(spark, store.root)
    for s in (store, again):
        valid = dense.embedding_valid(s.read("records"), s.read("record_embeddings"), *M)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = valid._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange" not in plan and valid.count() == 5


def test_bucketed_folder_is_read_by_a_new_catalog_entry(spark, fused):
    store, _ = fused
    spark.sql(f"DROP TABLE {store._name('records')}")
    assert store.read("records").count() == 5


def test_values_are_made_in_bounded_pieces(monkeypatch):
    """Many queries and rows give small matrices, and the same result."""
    rng = np.random.default_rng(4)
    n, m, d = 500, 300, 8
    queries = pd.DataFrame({
        "query_id": range(m), "scope_ids": [[1]] * m, "kinds": [[]] * m, "lifecycles": [[]] * m,
        "label_ids": [[]] * m, "before_id": [None] * m, "query_vector": list(rng.standard_normal((m, d))),
    })
    block = pa.table({
        "record_id": pa.array(range(n), pa.int64()), "scope_id": pa.array([1 + i % 2 for i in range(n)], pa.int64()),
        "kind": ["note"] * n, "lifecycle": ["active"] * n, "labels": pa.nulls(n, pa.list_(pa.int64())),
        "vector": pa.array(list(rng.standard_normal((n, d)).astype(np.float32)), pa.list_(pa.float32())),
    })
    largest = []

    def values(asked, rows):
        largest.append(len(asked) * rows.num_rows)
        return dense.similarities(asked, rows)

    def result():
        best = blocks.BestRows(queries, 5, values, 9)
        best.add(block)
        return [(r["query_id"], r["record_id"], round(r["value"], 9)) for r in best.result().to_pylist()]

    whole = result()
    monkeypatch.setattr(blocks, "VALUES_AT_ONCE", 4_000)
    largest.clear()
    assert result() == whole and len(whole) == 5 * m
    assert max(largest) <= 4_000
