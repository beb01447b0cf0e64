"""Searches that judge every query first.

A refused query gets one row with its reason, every other one its answer by its own ``limit`` or
``max_bytes`` (null or absent: the default). What one query gets does not depend on the others.
Query ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.functions.vectors import vector_error
from tessera.limits import BUDGET_DEFAULT, PAGE_DEFAULT
from tessera.operators import dense, quality, views
from tessera.operators.textindex import TextIndex
from tessera.plans import recall, search
from tessera.session import cut
from tessera.sources.store import LedgerStore

ANSWERED, REFUSED = "answered", "refused"


def with_default(queries: DataFrame, name: str, default: int) -> DataFrame:
    """Queries with a whole number in column ``name``."""
    own = F.col(name) if name in queries.columns else F.lit(None)
    return queries.withColumn(name, F.coalesce(own.cast("bigint"), F.lit(default).cast("bigint")))


def _labels(queries: DataFrame) -> list[Column]:
    if "label_ids" not in queries.columns:
        return []
    return [quality.ids("label_ids", F.col("label_ids"))]


def _cursor(queries: DataFrame) -> list[Column]:
    if "before_id" not in queries.columns:
        return []
    before = F.col("before_id")
    return [F.when(before.isNotNull(), quality.positive("before_id", before))]


def judge(
    queries: DataFrame, store: LedgerStore, first: list[Column], last: list[Column] = ()
) -> DataFrame:
    """Queries with ``reason``: the first of the rules that they break, null for a good one.

    The rules of ``first`` look at the query alone, then comes what it names but does not exist, then
    ``last``. The rows are kept in the shared folder, since both the refusals and the search read them.
    """
    guards = search.query_guards(queries, store.read("scopes"), store.read("labels"))
    rules = F.coalesce(*first, F.col("guard"), *last)
    return cut(
        queries.join(guards, "query_id").withColumn("reason", rules.cast("string")).drop("guard")
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NULL").drop("reason")


def answers(judged: DataFrame, found: DataFrame) -> DataFrame:
    """At least one row per query: its refusal, its rows, or a row without a record."""
    verdict = judged.select(
        "query_id",
        F.when(F.col("reason").isNull(), ANSWERED).otherwise(REFUSED).alias("outcome"),
        "reason",
    )
    return verdict.join(found, "query_id", "left")


def search_records(store: LedgerStore, index: TextIndex, queries: DataFrame) -> DataFrame:
    """Pages of :func:`search.search_records`, judged first.

    (query_id, outcome, reason, position, record_id, next_before_id, match_explanation). A null or
    blank query lists.
    """
    asked = with_default(queries, "limit", PAGE_DEFAULT)
    rules = [
        quality.positive("scope_id", F.col("scope_id")),
        quality.page_limit(F.col("limit")),
        quality.query_text(F.col("query")),
        *_labels(asked),
        *_cursor(asked),
    ]
    judged = judge(asked, store, rules)
    return answers(judged, search.search_records(store, index, accepted(judged)))


def semantic_search(
    store: LedgerStore,
    embeddings: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    model: str,
    model_revision: str,
    dimensions: int,
) -> DataFrame:
    """Hits of :func:`search.semantic_search`, judged first.

    (query_id, outcome, reason, dense_rank, record_id, similarity, match_explanation). A query needs
    one valid vector. While records lack theirs, every good query is refused.
    """
    asked = _with_vector(with_default(queries, "limit", PAGE_DEFAULT), query_vectors)
    status = dense.embedding_status(
        store.read("records"), embeddings, model, model_revision, dimensions
    )
    pending = status.first()["pending_records"]
    rules = [
        vector_error(F.col("query_vector"), F.lit(dimensions)),
        quality.positive("scope_id", F.col("scope_id")),
        quality.page_limit(F.col("limit")),
        *_labels(asked),
    ]
    gate = [F.lit(dense.PENDING % pending)] if pending else []
    judged = judge(asked, store, rules, gate)
    good = accepted(judged)
    hits = search.semantic_search(
        store,
        embeddings,
        good.drop("query_vector"),
        _vectors(good),
        model,
        model_revision,
        dimensions,
    )
    return answers(judged.drop("query_vector"), hits)


def recall_context(
    store: LedgerStore,
    index: TextIndex,
    queries: DataFrame,
    query_vectors: DataFrame,
    embeddings: DataFrame,
    model: str,
    model_revision: str,
    dimensions: int,
) -> DataFrame:
    """Results of :func:`recall.recall_context`, judged first and packed by each query's ``max_bytes``.

    (query_id, outcome, reason, n_records, used_bytes, result). A vector is asked for only if the
    vector index is complete. A result that does not fit its budget is a refusal as well.
    """
    records = store.read("records")
    status = dense.embedding_status(records, embeddings, model, model_revision, dimensions)
    complete = dense.index_gate(status).first()["strategy"] == "dense"
    asked = _with_vector(with_default(queries, "max_bytes", BUDGET_DEFAULT), query_vectors)
    empty = F.coalesce(F.size(words(F.col("query"))), F.lit(0)) < 1
    rules = [
        quality.recall_budget(F.col("max_bytes")),
        quality.positive("scope_id", F.col("scope_id")),
        quality.query_text(F.col("query")),
        F.when(empty, search.EMPTY_RECALL),
        *_labels(asked),
    ]
    vector = [vector_error(F.col("query_vector"), F.lit(dimensions))] if complete else []
    judged = judge(asked, store, rules, vector)
    good = accepted(judged)
    packed = recall.recall_context(
        store,
        index,
        good.drop("query_vector"),
        _vectors(good),
        embeddings,
        model,
        model_revision,
        dimensions,
    )
    reason = F.coalesce("reason", "error")
    return answers(judged.drop("query_vector"), packed).select(
        "query_id",
        F.when(reason.isNull(), ANSWERED).otherwise(REFUSED).alias("outcome"),
        reason.alias("reason"),
        F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"),
        "used_bytes",
        "result",
    )


def with_documents(store: LedgerStore, hits: DataFrame) -> DataFrame:
    """Rows of a search with the documents of their records; rows without a record stay.

    Tables are narrowed to the records of the hits, at most a page per query, before anything is
    nested or redacted.
    """
    ids = cut(hits.filter("record_id IS NOT NULL").select("record_id").distinct())
    return hits.join(views.record_document(store, ids), "record_id", "left")


def _with_vector(queries: DataFrame, query_vectors: DataFrame) -> DataFrame:
    vectors = query_vectors.select("query_id", F.col("vector").alias("query_vector"))
    return queries.join(vectors, "query_id", "left")


def _vectors(queries: DataFrame) -> DataFrame:
    return queries.filter("query_vector IS NOT NULL").select(
        "query_id", F.col("query_vector").alias("vector")
    )
