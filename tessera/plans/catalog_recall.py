"""Named queries: vector index, dense retrieval, recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.excerpt import excerpts
from tessera.functions.vectors import dot, l2_normalize, squared_norm, vector_error
from tessera.limits import BUDGET_DEFAULT, BUDGET_MIN
from tessera.operators import dense
from tessera.operators import retrieval as rt
from tessera.plans import guarded, recall, search
from tessera.plans.registry import MODEL, QUERIES, on_ledger, pair_queries, query, query_batch
from tessera.sources import corpus


def partial(store):
    return store.read_as("record_embeddings", "partial_embeddings")


@on_ledger
def embedding_valid(store):
    return dense.embedding_valid(store.read("records"), partial(store), *MODEL).select("record_id")


@on_ledger
def embedding_pending(store):
    return dense.embedding_pending(store.read("records"), partial(store), *MODEL)


@on_ledger
def embedding_status(store):
    return dense.embedding_status(store.read("records"), partial(store), *MODEL)


@on_ledger
def index_gate(store):
    """Strategy with the incomplete and with the complete index."""
    records = store.read("records")
    gates = [
        dense.index_gate(dense.embedding_status(records, vectors, *MODEL)).withColumn(
            "index", F.lit(name)
        )
        for name, vectors in [("partial", partial(store)), ("full", store.read("record_embeddings"))]
    ]
    return gates[0].unionByName(gates[1])


@query
def vector_valid(spark, sf_dir):
    """Stored vectors as they are, with a wrong size, and scaled."""
    rows = corpus.table(spark, sf_dir, "embeddings").withColumn("size", F.size("embedding"))
    scaled = F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float"))
    return rows.select(
        "vec_id",
        vector_error(F.col("embedding"), F.col("size")).alias("as_stored"),
        vector_error(F.col("embedding"), F.col("size") + F.col("label") % 2).alias("other_size"),
        vector_error(scaled, F.col("size")).alias("scaled"),
    )


@query
def l2_normalize_(spark, sf_dir):
    """Vectors scaled by their label (0 gives the zero vector) and made unit again."""
    rows = corpus.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        l2_normalize(F.transform("embedding", lambda x: x * F.col("label"))).alias("unit"),
    )
    return rows.select(
        "vec_id",
        F.round(squared_norm(F.col("unit")), 4).alias("norm"),
        F.round(dot(F.col("unit"), F.col("embedding")), 4).alias("cosine"),
    )


QUERIES["l2_normalize"] = QUERIES.pop("l2_normalize_")


@query
def dense_score(spark, sf_dir):
    """Similarity of every (query, record) pair that text retrieval found."""
    store = corpus.ledger(spark, sf_dir)
    index = corpus.text_index(spark, sf_dir)
    pairs = rt.match_any(rt.phrase_matches(index, query_batch(store)))
    scored = dense.dense_score(
        pairs, store.read("record_embeddings"), corpus.query_vector_table(store)
    )
    return scored.select("query_id", "record_id", F.round("similarity", 6).alias("similarity"))


def _dense_hits(store, k: int) -> DataFrame:
    vectors = dense.embedding_valid(store.read("records"), store.read("record_embeddings"), *MODEL)
    asked = dense.dense_queries(
        corpus.query_table(store), corpus.query_vector_table(store), store.read("scopes")
    )
    return dense.dense_topk(asked, vectors, MODEL[2], k)


@on_ledger
def dense_topk(store):
    return _dense_hits(store, 20).select(
        "query_id", "dense_rank", "record_id", F.round("similarity", 6).alias("similarity")
    )


@on_ledger
def semantic_search(store):
    """Gated search with kind and label filters."""
    asked = corpus.query_table(store).withColumns(
        {
            "kinds": F.array(F.lit("note"), F.lit("metric"), F.lit("idea")),
            "label_ids": F.array(F.lit(121).cast("bigint")),
        }
    )
    hits = search.semantic_search(
        store, store.read("record_embeddings"), asked, corpus.query_vector_table(store), *MODEL,
        limit=10,
    )
    return hits.select(
        "query_id",
        "dense_rank",
        "record_id",
        F.round("similarity", 6).alias("similarity"),
        F.array_join("match_explanation", ",").alias("tags"),
    )


@query
def search_records(spark, sf_dir):
    """Word-pair queries in the text's scope, one page of 10, with kind and label filters."""
    store = corpus.ledger(spark, sf_dir)
    item = F.col("item_id")
    asked = pair_queries(spark, sf_dir, " ").select(
        "query_id",
        "query",
        (item % 20 + 1).alias("scope_id"),
        (item % 2 == 0).alias("include_global"),
        F.array(*[F.lit(k) for k in ("note", "metric", "idea", "snippet")]).alias("kinds"),
        F.array(F.lit("active"), F.lit("retracted")).alias("lifecycles"),
        F.array(F.lit(121).cast("bigint")).alias("label_ids"),
    )
    return search.search_records(store, corpus.text_index(spark, sf_dir), asked, 10).select(
        "query_id",
        "position",
        "record_id",
        "next_before_id",
        F.array_join("match_explanation", ",").alias("tags"),
    )


@query
def search_blank(spark, sf_dir):
    """Blank queries list: per benchmark item its scope, from its cursor on, with filters."""
    store = corpus.ledger(spark, sf_dir)
    item = F.col("item_id")
    n = corpus.n_documents(spark, sf_dir)
    asked = corpus.table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"),
        F.lit(" \n").alias("query"),
        (item % 20 + 1).alias("scope_id"),
        (item % 2 == 0).alias("include_global"),
        F.when(item % 3 == 0, F.array(F.lit("note"), F.lit("metric"))).alias("kinds"),
        F.when(item % 5 == 0, F.array(F.lit(121).cast("bigint"))).alias("label_ids"),
        F.when(item % 4 > 0, n - item * 7).alias("before_id"),
    )
    return search.search_records(store, corpus.text_index(spark, sf_dir), asked, 10).select(
        "query_id",
        "position",
        "record_id",
        "next_before_id",
        F.array_join("match_explanation", ",").alias("tags"),
    )


@query
def query_guards(spark, sf_dir):
    """Benchmark items ask in scopes and for labels of which some do not exist."""
    store = corpus.ledger(spark, sf_dir)
    asked = corpus.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (F.col("item_id") % 25 + 1).alias("scope_id"),
        F.array(F.lit(1).cast("bigint"), F.col("item_id") % 4 + 1).alias("label_ids"),
    )
    return search.query_guards(asked, store.read("scopes"), store.read("labels"))


@on_ledger
def embedding_upsert(store):
    """Incoming vectors against the ledger: outcomes, and what is stored afterwards."""
    incoming = partial(store).withColumn(
        "dimensions", F.col("dimensions") + F.when(F.col("record_id") % 10 == 0, 1).otherwise(0)
    )
    stored, outcome = dense.embedding_upsert(
        store.read("records"),
        partial(store).filter(F.col("revision") > 1),
        incoming,
    )
    return (
        outcome.select(F.lit("outcome").alias("part"), "record_id", "revision", "outcome")
        .unionByName(stored.select(F.lit("stored").alias("part"), "record_id", "revision",
                                   F.lit("").alias("outcome")))
    )


def letter_vectors(store) -> DataFrame:
    """The stored vectors as if the letter model had made them: a third has another size, the
    rest is a unit vector, of the current revision or of another."""
    other = F.col("record_id") % 3 == 1
    unit = F.array(*[F.lit(float(i == 0)).cast("float") for i in range(4)])
    return partial(store).select(
        "record_id",
        "revision",
        F.lit("letters").alias("model"),
        F.lit("v1").alias("model_revision"),
        F.when(other, F.col("dimensions")).otherwise(F.lit(4)).cast("bigint").alias("dimensions"),
        F.when(other, F.col("vector")).otherwise(unit).alias("vector"),
    )


def letter_model(texts: pd.Series) -> pd.Series:
    """Stand-in model: how often four letters occur, plus one."""
    return texts.map(lambda t: [float(t.count(c) + 1) for c in "aent"])


@on_ledger
def embedding_sync(store):
    """Pending records embedded by the caller's model; valid vectors stay, others are replaced."""
    records = store.read("records")
    stored, _ = dense.embedding_sync(
        records,
        store.read("record_revisions"),
        letter_vectors(store),
        letter_model,
        "letters",
        "v1",
        4,
    )
    pick = [F.round(F.col("vector")[i].cast("double"), 5).alias(f"v{i}") for i in range(4)]
    return stored.select("record_id", "revision", *pick)


def _fused(spark, sf_dir) -> DataFrame:
    store = corpus.ledger(spark, sf_dir)
    return recall.recall_candidates(
        store, corpus.text_index(spark, sf_dir), corpus.query_table(store), _dense_hits(store, 20)
    )


@query
def candidate_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id",
        "record_id",
        "bm25_rank",
        F.round("bm25_score", 6).alias("bm25_score"),
        "dense_rank",
        F.round("dense_similarity", 6).alias("dense_similarity"),
    )


@query
def recall_candidates(spark, sf_dir):
    """Candidates when the vector index is not complete: the lexical list alone."""
    store = corpus.ledger(spark, sf_dir)
    return recall.recall_candidates(
        store, corpus.text_index(spark, sf_dir), corpus.query_table(store), None
    ).select("query_id", "record_id", "bm25_rank", "dense_rank",
             F.round("bm25_score", 6).alias("bm25_score"))


@query
def rrf_score(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", "record_id", F.round(recall.rrf_score(), 9).alias("rrf_score")
    )


@query
def matched_by(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", "record_id", F.array_join(recall.matched_by(), ",").alias("matched_by")
    )


@query
def recall_order(spark, sf_dir):
    return recall.recall_order(_fused(spark, sf_dir)).select("query_id", "position", "record_id")


@query
def recall_explanation(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", "record_id", recall.recall_explanation(True).alias("text")
    )


@query
def recall_explanation_bm25(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    rows = recall.recall_candidates(
        store, corpus.text_index(spark, sf_dir), corpus.query_table(store), None
    )
    return rows.select("query_id", "record_id", recall.recall_explanation(False).alias("text"))


@on_ledger
def recall_sources(store):
    rows = recall.recall_sources(store.read("source_references"))
    return rows.select(
        "record_id",
        "revision",
        F.array_join(F.transform("sources", lambda s: s["identity"]), ",").alias("identities"),
        F.array_join(
            F.transform("sources", lambda s: F.coalesce(s["content_hash"], F.lit("-"))), ","
        ).alias("hashes"),
        "source_count",
    )


def _context(spark, sf_dir, full: bool, budget: int, packed: bool) -> DataFrame:
    store = corpus.ledger(spark, sf_dir)
    return recall.recall_context(
        store,
        corpus.text_index(spark, sf_dir),
        corpus.query_table(store),
        corpus.query_vector_table(store),
        store.read("record_embeddings") if full else partial(store),
        *MODEL,
        budget=budget,
        packed=packed,
    )


@query
def recall_context(spark, sf_dir):
    """Ordered evidence per query with ranks and scores."""
    return _context(spark, sf_dir, True, BUDGET_DEFAULT, False).select(
        "query_id",
        "position",
        "record_id",
        "bm25_rank",
        F.round("bm25_score", 6).alias("bm25_score"),
        "dense_rank",
        F.round("dense_similarity", 6).alias("dense_similarity"),
        F.round(recall.rrf_score(), 9).alias("rrf_score"),
    )


@query
def recall_context_bm25(spark, sf_dir):
    """The same with an incomplete vector index: lexical order."""
    return _context(spark, sf_dir, False, BUDGET_DEFAULT, False).select(
        "query_id", "position", "record_id", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score")
    )


@query
def excerpt(spark, sf_dir):
    """Excerpts of the selected records at three sizes."""
    store = corpus.ledger(spark, sf_dir)
    ordered = recall.recall_order(_fused(spark, sf_dir))
    rows = recall.evidence(store, ordered, corpus.query_table(store), True)
    return rows.select(
        "query_id",
        "position",
        *[
            excerpts(F.col("text"), F.col("query"), F.lit(n)).alias(f"excerpt_{n}")
            for n in (160, 400, 640)
        ],
    )


@query
def recall_pack(spark, sf_dir):
    """Packed results within the smallest budget."""
    return _context(spark, sf_dir, True, BUDGET_MIN, True)


@query
def used_bytes(spark, sf_dir):
    """Stated and true size of each packed result."""
    packed = _context(spark, sf_dir, True, BUDGET_DEFAULT, True)
    stated = F.get_json_object("result", "$.used_bytes").cast("bigint")
    true = F.octet_length("result").cast("bigint")
    return packed.select(
        "query_id",
        (stated == true).alias("exact"),
        (true <= BUDGET_DEFAULT).alias("within_budget"),
        (F.col("n_records") <= 5).alias("at_most_five"),
    )


@on_ledger
def record_text(store):
    """What a model embeds for each record's current revision."""
    return dense.record_text(store.read("records"), store.read("record_revisions"))


def _tags() -> Column:
    return F.array_join("match_explanation", ",").alias("tags")


@query
def guarded_search(spark, sf_dir):
    """Word-pair queries with a page size each. Some name a scope or label that does not exist, ask for
    too much, or are too long."""
    store = corpus.ledger(spark, sf_dir)
    item, number = F.col("item_id"), F.col("query_id")
    held = F.array(F.lit(121).cast("bigint"))
    asked = pair_queries(spark, sf_dir, " ").select(
        "query_id",
        F.when(number % 41 == 0, F.concat("query", F.repeat(F.lit(" x"), F.lit(130))))
        .otherwise(F.col("query"))
        .alias("query"),
        (item % 25).alias("scope_id"),
        (item % 2 == 0).alias("include_global"),
        F.when(number % 13 == 0, F.array_append(held, F.lit(9_999_999).cast("bigint")))
        .otherwise(held)
        .alias("label_ids"),
        F.when(number % 9 > 0, number % 60).alias("limit"),
    )
    pages = guarded.search_records(store, corpus.text_index(spark, sf_dir), asked)
    return pages.select(
        "query_id", "outcome", "reason", "position", "record_id", "next_before_id", _tags()
    )


@on_ledger
def guarded_semantic(store):
    """Query vectors with a number of hits each; some are absent, too short or not of unit length."""
    number = F.col("query_id")
    asked = corpus.query_table(store).withColumns(
        {
            "scope_id": F.when(number % 17 == 0, 999_999).otherwise(F.col("scope_id")).cast("bigint"),
            "limit": number % 60,
        }
    )
    short, doubled = F.slice("vector", 1, 63), F.transform("vector", lambda x: x + x)
    vectors = (
        corpus.query_vector_table(store)
        .filter(number % 19 > 0)
        .withColumn(
            "vector",
            F.when(number % 13 == 0, short).when(number % 11 == 0, doubled).otherwise(F.col("vector")),
        )
    )
    hits = guarded.semantic_search(store, store.read("record_embeddings"), asked, vectors, *MODEL)
    return hits.select(
        "query_id", "outcome", "reason", "dense_rank", "record_id",
        F.round("similarity", 6).alias("similarity"),
    )


@query
def guarded_recall(spark, sf_dir):
    """Recall with a budget per query: the first three records of each result and its size."""
    store = corpus.ledger(spark, sf_dir)
    number = F.col("query_id")
    asked = corpus.query_table(store).withColumns(
        {
            "query": F.when(number % 23 == 0, " ").otherwise(F.col("query")),
            "max_bytes": F.when(number % 7 > 0, number % 32 * 1000 + 2000),
        }
    )
    packed = guarded.recall_context(
        store,
        corpus.text_index(spark, sf_dir),
        asked,
        corpus.query_vector_table(store),
        store.read("record_embeddings"),
        *MODEL,
    )

    def stated(path: str) -> Column:
        return F.get_json_object("result", path).cast("bigint")

    budget = stated("$.budget_bytes")
    return packed.select(
        "query_id",
        "outcome",
        "reason",
        budget.alias("budget_bytes"),
        *[stated(f"$.records[{i}].record_id").alias(f"record_{i + 1}") for i in range(3)],
        (stated("$.used_bytes") == F.octet_length("result")).alias("exact"),
        (F.col("used_bytes") <= budget).alias("within_budget"),
    )
