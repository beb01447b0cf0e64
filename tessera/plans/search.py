"""Whole searches: filtered text search with paging, semantic search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import words
from tessera.limits import MAX_PAGE
from tessera.operators import dense, views
from tessera.operators.blocks import best_rows, newest_first, with_filters
from tessera.operators.retrieval import QueryBatch, phrase_matches, search_and, top_k
from tessera.operators.textindex import TextIndex
from tessera.sources.store import LedgerStore


# Wording of the refusals.
MISSING_SCOPE = "scope %d does not exist"
MISSING_LABEL = "label does not exist"
EMPTY_RECALL = "recall query must not be empty"


def query_guards(queries: DataFrame, scopes: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, guard): what a query names that does not exist, else null. A label need not be
    active to be asked for."""
    known = scopes.select(F.col("id").alias("scope_id"), F.lit(True).alias("known"))
    rows = queries.join(known, "scope_id", "left")
    guard = F.when(F.col("known").isNull(), F.format_string(MISSING_SCOPE, "scope_id"))
    if "label_ids" in queries.columns:
        unknown = (
            queries.select("query_id", F.explode("label_ids").alias("id"))
            .join(labels.select("id"), "id", "left_anti")
            .select("query_id", F.lit(True).alias("bad_label"))
            .distinct()
        )
        rows = rows.join(unknown, "query_id", "left")
        guard = guard.when(F.col("bad_label"), MISSING_LABEL)
    return rows.select("query_id", guard.alias("guard"))


def is_blank(queries: DataFrame) -> DataFrame:
    """Queries without any term: a search lists, a recall refuses."""
    return queries.withColumn(
        "blank", F.coalesce(F.size(words(F.col("query"))), F.lit(0)) < 1
    )


def list_records(store: LedgerStore, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, record_id, position): newest ``k`` records that pass each query's filters."""
    rows = store.read("records").filter("readable").select(
        F.col("id").alias("record_id"), "scope_id", "kind", "lifecycle"
    )
    if "label_ids" in queries.columns:
        rows = dense.labelled(rows, _held(store))
    hits = best_rows(with_filters(queries, store.read("scopes")), rows, k, newest_first)
    return top_k(hits.drop("value"), k, F.desc("record_id"), rank="position")


def _held(store: LedgerStore) -> DataFrame:
    return views.active_assertions(store.read("label_assertions"), store.read("label_retractions"))


def search_records(
    store: LedgerStore, index: TextIndex, queries: DataFrame, limit: int = 20
) -> DataFrame:
    """Records that hold every term of the query and pass its filters, newest first.

    One page per query: (query_id, position, record_id, next_before_id, match_explanation).
    A column ``before_id`` continues an earlier page. A column ``limit`` gives each query its own page
    size, at most 50. A blank query lists all records that pass.
    """
    most = MAX_PAGE if "limit" in queries.columns else limit
    judged = is_blank(queries)
    any_blank = not judged.filter("blank").isEmpty()
    asked = judged.filter("NOT blank").drop("blank") if any_blank else queries
    batch = QueryBatch.of(asked, store.read("scopes"))
    found = search_and(phrase_matches(index, batch), batch.phrases)
    held = _held(store) if "label_ids" in queries.columns else None
    rows = views.eligible_candidates(found, store.read("records"), asked, held)
    if "before_id" in queries.columns:
        rows = (
            rows.join(asked.select("query_id", "before_id"), "query_id")
            .filter(F.col("before_id").isNull() | (F.col("record_id") < F.col("before_id")))
            .drop("before_id")
        )
    fetched = top_k(rows, most + 1, F.desc("record_id"), rank="position")
    if any_blank:
        blank = judged.filter("blank").drop("blank")
        fetched = fetched.unionByName(list_records(store, blank, most + 1))
    tags = judged.select(
        "query_id",
        own_limit(queries, limit).alias("most"),
        F.when(F.col("blank"), _search_tags(False, queries))
        .otherwise(_search_tags(True, queries))
        .alias("match_explanation"),
    )
    # The extra row only says that there is a next page.
    whole = Window.partitionBy("query_id")
    last = F.when(F.col("position") == F.col("most"), F.col("record_id"))
    return (
        fetched.join(tags, "query_id")
        .filter(F.col("position") <= F.col("most") + 1)
        .withColumns({"fetched": F.count("*").over(whole), "last_id": F.max(last).over(whole)})
        .filter(F.col("position") <= F.col("most"))
        .select(
            "query_id",
            "position",
            "record_id",
            F.when(F.col("fetched") > F.col("most"), F.col("last_id")).alias("next_before_id"),
            "match_explanation",
        )
    )


def own_limit(queries: DataFrame, limit: int) -> Column:
    """Each query's own number of rows, or ``limit``."""
    if "limit" not in queries.columns:
        return F.lit(limit)
    return F.coalesce(F.col("limit"), F.lit(limit))


def _search_tags(text: bool, queries: DataFrame) -> Column:
    return views.match_explanation(
        text,
        F.col("include_global"),
        views.given(queries, "kinds"),
        views.given(queries, "label_ids"),
    )


def semantic_search(
    store: LedgerStore,
    embeddings: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    model: str,
    model_revision: str,
    dimensions: int,
    limit: int = 20,
) -> DataFrame:
    """Nearest eligible records per query; fails unless every readable record has a vector.

    A column ``limit`` gives each query its own number of hits, at most 50.
    """
    most = MAX_PAGE if "limit" in queries.columns else limit
    records = store.read("records")
    status = dense.embedding_status(records, embeddings, model, model_revision, dimensions)
    vectors = dense.embedding_valid(records, embeddings, model, model_revision, dimensions)
    if "label_ids" in queries.columns:
        vectors = dense.labelled(vectors, _held(store))
    asked = dense.dense_queries(queries, query_vectors, store.read("scopes"))
    hits = dense.dense_topk(asked, dense.require_complete(vectors, status), dimensions, most)
    explained = views.match_explanation(
        False,
        F.col("include_global"),
        views.given(queries, "kinds"),
        views.given(queries, "label_ids"),
        f"{model}@{model_revision}",
    )
    tags = queries.select(
        "query_id", own_limit(queries, limit).alias("most"), explained.alias("match_explanation")
    )
    return hits.join(tags, "query_id").filter(F.col("dense_rank") <= F.col("most")).select(
        "query_id", "dense_rank", "record_id", "similarity", "match_explanation"
    )
