import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rt
from tessera.operators import textindex as ti
from tessera.plans import search
from tests.helpers import payload, simple_store


def index_of(spark, store, root, source="text"):
    docs = ti.indexed_documents(store.read("records"), store.read("record_revisions"), source)
    return ti.write_index(docs, str(root), buckets=3, spread=2)


def ask(spark, *queries, **columns):
    rows = [[i, q, 1, False] for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id bigint, query string, scope_id bigint, include_global boolean")


def found(df, rank=None):
    rows = df.collect()
    if rank:
        rows = sorted(rows, key=lambda r: (r["query_id"], r[rank]))
        out = {}
        for r in rows:
            out.setdefault(r["query_id"], []).append(r["record_id"])
        return out
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], set()).add(r["record_id"])
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    store = simple_store(
        spark, root / "s",
        [("one", "alpha only"), ("two", "alpha beta beta beta"), ("Tie", "equal terms"),
         ("Tie", "equal terms"), ("cross", "phrase one two three one two four"), ("x", "a a a a")],
    )
    return store, index_of(spark, store, root / "i")


def test_and_or_order(spark, small):
    store, index = small
    batch = rt.QueryBatch.of(ask(spark, "alpha beta", "equal", "? alpha", "..."))
    matches = rt.phrase_matches(index, batch)
    assert found(rt.search_and(matches, batch.phrases)) == {0: {2}, 1: {3, 4}}
    ranked = found(rt.bm25_topk(rt.bm25_scores(index, batch), 20), "bm25_rank")
    assert ranked[0] == [2, 1]
    assert ranked[1] == [4, 3]
    assert sorted(ranked[2]) == [1, 2]
    assert 3 not in ranked


def test_phrases_stay_in_one_column_and_order(spark, small):
    _, index = small
    batch = rt.QueryBatch.of(ask(spark, "one-two", "two-one", "one-two-four", "cross-phrase", "a-a", "a-a-a", "one-zzz"))
    rows = {(r["query_id"], r["record_id"]): r["tf"] for r in rt.phrase_matches(index, batch).collect()}
    assert rows == {(0, 5): 2, (2, 5): 1, (4, 6): 3, (5, 6): 2}


def test_large_batches_give_the_same(spark, small, monkeypatch):
    _, index = small
    queries = ask(spark, "alpha beta", "one-two three", "equal terms Tie")
    plain = rt.bm25_scores(index, rt.QueryBatch.of(queries)).collect()
    monkeypatch.setattr(rt, "BROADCAST_QUERIES", 0)
    batch = rt.QueryBatch.of(queries)
    assert not batch.bounded
    assert sorted(rt.bm25_scores(index, batch).collect()) == sorted(plain)


def test_json_index_finds_field_names(spark, small, tmp_path):
    store, _ = small
    index = index_of(spark, store, tmp_path / "j", "json")
    batch = rt.QueryBatch.of(ask(spark, "body"))
    assert len(found(rt.match_any(rt.phrase_matches(index, batch)))[0]) == 6


def brute_bm25(docs, query):
    tokens = {i: (t.lower().split(), b.lower().split()) for i, (t, b) in docs.items()}
    n = len(tokens)
    avg = sum(len(t) + len(b) for t, b in tokens.values()) / n

    def count(words, phrase):
        return sum(words[i : i + len(phrase)] == phrase for i in range(len(words)))

    scores = {}
    for term in query.lower().split():
        phrase = term.split("-")
        tf = {i: count(t, phrase) + count(b, phrase) for i, (t, b) in tokens.items()}
        hits = {i: c for i, c in tf.items() if c}
        idf = max(math.log((n - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6) if hits else 0
        for i, c in hits.items():
            dl = sum(map(len, tokens[i]))
            scores[i] = scores.get(i, 0) + idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avg))
    return scores


def test_bm25_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["red", "blue", "green", "tin", "oak", "elm"]
    bodies = [
        (rng.choice(vocabulary), " ".join(rng.choices(vocabulary, [9, 4, 2, 2, 1, 1], k=rng.randint(1, 30))))
        for _ in range(40)
    ]
    store = simple_store(spark, tmp_path / "s", bodies)
    index = index_of(spark, store, tmp_path / "i")
    queries = ["red blue", "red red elm", "oak-elm red", "red-red-blue tin", "green-tin-oak-elm", "elm none"]
    batch = rt.QueryBatch.of(ask(spark, *queries))
    got = {}
    for r in rt.bm25_scores(index, batch).collect():
        got.setdefault(r["query_id"], {})[r["record_id"]] = r["score"]
    docs = dict(enumerate(bodies, 1))
    for q, text in enumerate(queries):
        want = brute_bm25(docs, text)
        assert set(got.get(q, {})) == set(want)
        for i, score in want.items():
            assert got[q][i] == pytest.approx(score, abs=1e-12)


def test_refresh_replaces_old_text(spark, tmp_path):
    store = simple_store(
        spark, tmp_path / "s", [("t", "old searchable text"), ("u", "other")],
        revisions=[dict(record_id=1, revision=2, title="t", payload=payload(body="new searchable text"),
                        reason="r")],
    )
    records, revisions = store.read("records"), store.read("record_revisions")
    index = index_of(spark, store, tmp_path / "i")
    revised = records.filter("id = 1").replace(1, 2, ["current_revision"])
    fresh = ti.refresh_index(index, ti.indexed_documents(revised, revisions), str(tmp_path / "i2"))
    batch = rt.QueryBatch.of(ask(spark, "old", "new", "other"))
    assert found(rt.match_any(rt.phrase_matches(fresh, batch))) == {1: {1}, 2: {2}}
    assert fresh.n_docs == 2
    assert fresh.doc_stats().count() == 2


def test_filters_and_paging(spark, tmp_path):
    override = {
        2: dict(scope_id=2), 3: dict(lifecycle="retracted"), 4: dict(readable=False),
        5: dict(kind="idea"), 6: dict(scope_id=3),
    }
    store = simple_store(
        spark, tmp_path / "s", [("t", "filter needle")] * 9, override=override,
        scopes=[dict(id=1, name="work"), dict(id=2, name="global"), dict(id=3, name="other")],
        assertions=[dict(id=i, record_id=i, label_id=1) for i in range(1, 10)]
        + [dict(id=20, record_id=7, label_id=2)],
    )
    index = index_of(spark, store, tmp_path / "i")
    schema = ("query_id bigint, query string, scope_id bigint, include_global boolean, kinds array<string>, "
              "lifecycles array<string>, label_ids array<bigint>, before_id bigint")
    cases = [
        (False, [], [], [], None, [9, 8]),
        (False, [], [], [], 8, [7, 5]),
        (False, [], [], [], 5, [1]),
        (True, [], [], [], 6, [5, 2]),
        (False, ["idea"], [], [], None, [5]),
        (False, [], ["retracted"], [], None, [3]),
        (False, [], [], [1, 2], None, [7]),
        (False, [], [], [2], None, [7]),
    ]
    queries = spark.createDataFrame(
        [[i, "needle filter", 1, *case[:5]] for i, case in enumerate(cases)], schema
    )
    pages = search.search_records(store, index, queries, 2)
    got = found(pages, "position")
    assert [got.get(i) for i in range(len(cases))] == [c[5] for c in cases]
    cursors = {r["query_id"]: r["next_before_id"] for r in pages.collect()}
    assert [cursors[i] for i in range(4)] == [8, 5, None, 2]
    tags = pages.filter("query_id = 3").first()["match_explanation"]
    assert tags == ["fts:title_or_payload", "scope:exact_or_global", "lifecycle"]
    tags = pages.filter("query_id = 6").first()["match_explanation"]
    assert tags == ["fts:title_or_payload", "scope:exact", "lifecycle", "labels:all"]


def test_no_token_becomes_a_row_before_it_is_counted(spark):
    docs = spark.createDataFrame(
        [(1, 1, 1, "A b", "b a b"), (1, 1, 1, "b", "c a b b"), (1, 1, 1, None, "x"), (2, 1, None, "", "")],
        "record_id bigint, revision bigint, scope_id bigint, title string, body string",
    )
    rows = ti.postings(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("Aggregate"):]
    # Copies of one length are one document.
    got = {r["term"]: (r["dl"], r["tf"], r["title_pos"], r["body_pos"]) for r in rows.collect()}
    assert got == {"a": (5, 3, [0], [1, 1]), "b": (5, 6, [0, 1], [0, 2, 2, 3]), "c": (5, 1, [], [0])}


def test_index_files_are_written_by_as_many_tasks_as_a_shuffle_has(spark):
    rows = spark.range(20_000).selectExpr("id AS record_id", "cast(id % 8 AS int) AS bucket")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "96")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r[0] for r in ti.dealt(rows, "bucket", None).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # 8 buckets by 4 were 32 pieces, whatever the size of the index.
    assert len(sizes) > 80 and max(sizes) < 4 * 20_000 / 96


def test_postings_are_written_where_their_documents_are(spark):
    docs = spark.createDataFrame(
        [(i, 1, 1, "a b", f"b c{i}") for i in range(40)],
        "record_id bigint, revision bigint, scope_id bigint, title string, body string",
    )
    rows = ti.postings(docs).withColumn("bucket", ti.bucket_of(F.col("term"), 3))

    def shuffles(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("Repartition")

    assert shuffles(ti.arranged(rows, None)) == shuffles(rows) == 0
    assert shuffles(ti.arranged(rows, 2)) == 1
    assert ti.arranged(rows, None).exceptAll(ti.arranged(rows, 2)).isEmpty()


def test_texts_are_dealt_to_more_tasks_the_more_text_there_is(spark, small, monkeypatch):
    store, _ = small
    records, revisions = store.read("records"), store.read("record_revisions")
    usual = ti.text_tasks(revisions)
    assert usual == ti.shuffle_partitions(spark)
    monkeypatch.setattr(ti, "TEXT_PER_TASK", 1)
    size = len("alpha only" + "alpha beta beta beta" + 2 * "equal terms" + "phrase one two three one two four" + "a a a a")
    assert ti.text_tasks(revisions) == max(usual, size)
    plan = ti.indexed_documents(records, revisions)._jdf.queryExecution().optimizedPlan().toString()
    assert f"{size}" in plan[plan.index("RepartitionByExpression"):].splitlines()[0]


def test_queries_share_matches_and_get_the_same_records(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, 1, 1, "alpha", "beta gamma one two"), (2, 1, 1, "alpha", "one"), (2, 1, 1, "alpha", "beta two one two"),
         (3, 1, 1, "beta", "alpha alpha gamma"), (4, 1, 1, "gamma", "two one"), (5, 1, 1, None, "")],
        "record_id bigint, revision bigint, scope_id bigint, title string, body string",
    )
    index = ti.write_index(docs, str(tmp_path / "i"), buckets=3)
    asked = ["alpha beta", "alpha alpha", "alpha", "one-two alpha", "? alpha", "...", "alpha none", "gamma beta alpha",
             "two", "", "one two alpha beta"] + 20 * ["beta alpha"]
    batch = rt.QueryBatch.of(ask(spark, *asked))
    matches = rt.phrase_matches(index, batch)
    plain = sorted(rt.search_and(matches, batch.phrases).collect())
    shared = rt.phrase_matches(index, batch, shared=True)
    # Asked for by 26 queries, alpha has one row for each of its postings.
    assert matches.filter("record_id = 3").join(batch.phrases, ["query_id", "term_ix"]).filter("term = 'alpha'").count() > 26
    assert shared.filter("record_id = 3").groupBy("phrase_id").count().filter("count > 1").isEmpty()
    for bounded in (True, False):
        assert sorted(rt.search_and(shared, batch.phrases, bounded).collect()) == plain
    got = found(rt.search_and(shared, batch.phrases, True))
    assert got[0] == {1, 3} and got[1] == {1, 3} and got[10] == {1}
    # The copies of record 2 count twice for alpha, as they did before.
    assert got[7] == {1, 2, 3} and got[4] == got[6] == {2}
    assert not got.keys() & {5, 9}


def test_and_search_makes_no_row_per_query_and_match(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, 1, 1, "common", f"usual w{i}") for i in range(50)],
        "record_id bigint, revision bigint, scope_id bigint, title string, body string",
    )
    index = ti.write_index(docs, str(tmp_path / "i"), buckets=3)
    batch = rt.QueryBatch.of(ask(spark, *[f"common w{i} usual" for i in range(40)]))
    rows = rt.search_and(rt.phrase_matches(index, batch, shared=True), batch.phrases, batch.bounded)
    assert sorted(rows.collect()) == [(i, i) for i in range(40)]
    # Records are shuffled, each with its phrases; before, each (query, record) pair with a match was.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(record_id" in plan
    assert rt.phrase_matches(index, batch, shared=True).count() == 50 + 50 + 40


def test_shared_matches_need_a_batch_without_scopes(spark, small):
    store, index = small
    batch = rt.QueryBatch.of(ask(spark, "alpha"), store.read("scopes"))
    with pytest.raises(ValueError, match="scopes"):
        rt.phrase_matches(index, batch, shared=True)


def test_postings_are_counted_in_batches(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Ähre", "wort", "x1", "-", ""]
    texts = [[" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(2)] for _ in range(60)]
    rows = [(i // 2 if i < 20 else i, 1, None if i == 30 else 1, t, b) for i, (t, b) in enumerate(texts)]
    rows += [(100, 1, 1, None, "a"), (101, 1, 1, "a", None), (102, 1, 1, "", ""), (None, 1, 1, "a", "b a"),
             (103, 1, 1, "a b", "c"), (103, 1, 1, "a", "b a"), (103, 1, 1, "a", "c")]
    docs = spark.createDataFrame(rows, "record_id bigint, revision bigint, scope_id bigint, title string, body string")
    monkeypatch.setattr(ti, "BATCH_ROWS", 7)
    found = ti.postings(docs)
    # Words are counted outside of Spark's lambda functions, which took most of the build.
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in ti.counted(docs).filter("places IS NOT NULL").collect():
        for term, place in sorted(r["places"]):
            sides = want.setdefault((r["record_id"], r["scope_id"], r["dl"], term), ([], []))
            sides[place >= ti.BODY].append(place % ti.BODY)
    got = {tuple(r)[:4]: (r["title_pos"], r["body_pos"]) for r in found.collect()}
    assert got == want and found.count() == len(want)
    assert found.filter("tf <> size(title_pos) + size(body_pos)").isEmpty()
    assert ti.postings(docs.limit(0)).isEmpty()
