"""Recall: both candidate lists fused, ordered, and packed into a byte budget."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.excerpt import centred, window
from tessera.functions.payload import payload_text
from tessera.functions.text import squeeze
from tessera.limits import (
    BUDGET_DEFAULT,
    EXCERPT_MAX_BYTES,
    EXCERPT_MIN_BYTES,
    RECALL_CANDIDATES,
    RECALL_MAX_RESULTS,
    RECALL_MIN_RESULTS,
    RECALL_SOURCES,
    RRF_K,
)
from tessera.operators import dense, views
from tessera.operators.legacy import visible_revisions
from tessera.operators.retrieval import QueryBatch, bm25_scores, bm25_topk, few, top_k
from tessera.operators.textindex import TextIndex
from tessera.plans.search import EMPTY_RECALL, is_blank
from tessera.session import cut
from tessera.sources.store import LedgerStore

# Wording of the explanations.
BOTH = "Dense rank %d with cosine %.4f; BM25 rank %d with score %.6f. Dense ordering is used because the semantic index is complete."
DENSE_ONLY = "Dense rank %d with cosine %.4f; no top-20 BM25 match. Dense ordering is used because the semantic index is complete."
BM25_ONLY = "BM25 rank %d with score %.6f; no top-20 dense match."
BM25_ALONE = "BM25 rank %d with score %.6f; semantic retrieval is unavailable."
NEITHER = "Eligible deterministic retrieval candidate."
TOO_SMALL = "recall budget is too small for {} evidence records"


def candidate_fusion(lexical: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """One row per (query, record) found by either retrieval, with both ranks and scores."""
    left = lexical.select("query_id", "record_id", "bm25_rank", F.col("score").alias("bm25_score"))
    if semantic is None:
        return left.withColumns(
            {
                "dense_rank": F.lit(None).cast("bigint"),
                "dense_similarity": F.lit(None).cast("double"),
            }
        )
    right = semantic.select(
        "query_id", "record_id", "dense_rank", F.col("similarity").alias("dense_similarity")
    )
    return left.join(right, ["query_id", "record_id"], "full_outer")


def rrf_score() -> Column:
    """Reciprocal rank fusion, reported beside the order."""

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.col(rank) + RRF_K), F.lit(0.0))

    return part("bm25_rank") + part("dense_rank")


def matched_by() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("bm25_rank").isNotNull(), "bm25"),
            F.when(F.col("dense_rank").isNotNull(), "dense"),
        )
    )


def recall_order(candidates: DataFrame, keep: int = RECALL_MAX_RESULTS) -> DataFrame:
    """Dense rank, then BM25 rank, then newest record; absent ranks go last."""
    return top_k(
        candidates,
        keep,
        F.asc_nulls_last("dense_rank"),
        F.asc_nulls_last("bm25_rank"),
        F.desc("record_id"),
        rank="position",
    )


def recall_explanation(semantic_available: bool) -> Column:
    rank, score = F.col("bm25_rank"), F.col("bm25_score")
    d_rank, cosine = F.col("dense_rank"), F.col("dense_similarity")
    return (
        F.when(
            d_rank.isNotNull() & rank.isNotNull(), F.format_string(BOTH, d_rank, cosine, rank, score)
        )
        .when(d_rank.isNotNull(), F.format_string(DENSE_ONLY, d_rank, cosine))
        .when(
            rank.isNotNull(),
            F.format_string(BM25_ONLY if semantic_available else BM25_ALONE, rank, score),
        )
        .otherwise(NEITHER)
    )


def recall_sources(sources: DataFrame) -> DataFrame:
    """First sources of each revision without their quotes, and how many there are."""
    kept = F.transform(
        F.slice("sources", 1, RECALL_SOURCES),
        lambda s: F.struct(
            s["id"].alias("id"),
            s["identity"].alias("identity"),
            s["locator"].alias("locator"),
            s["version"].alias("version"),
            s["content_hash"].alias("content_hash"),
            s["anchor"].alias("anchor"),
        ),
    )
    return views.record_sources(sources).select(
        "record_id",
        "revision",
        kept.alias("sources"),
        F.size("sources").cast("bigint").alias("source_count"),
    )


def recall_candidates(
    store: LedgerStore,
    index: TextIndex,
    queries: DataFrame,
    semantic: DataFrame | None,
    limit: int = RECALL_CANDIDATES,
) -> DataFrame:
    """Top lexical hits fused with the given dense hits."""
    held = None
    if "label_ids" in queries.columns:
        held = views.active_assertions(
            store.read("label_assertions"), store.read("label_retractions")
        )
    scores = bm25_scores(index, QueryBatch.of(queries, store.read("scopes")))
    allowed = views.eligible_candidates(scores, store.read("records"), queries, held)
    return candidate_fusion(bm25_topk(allowed, limit), semantic)


def evidence(
    store: LedgerStore, ordered: DataFrame, queries: DataFrame, semantic_available: bool
) -> DataFrame:
    """The selected rows with everything the result shows.

    The selection, at most five rows per query, is kept in the shared folder and then meets the
    tables; for a batch of checked size it is sent to their scans, so no text is shuffled that
    is not shown.
    """
    bounded = few(queries)
    picked = cut(ordered.join(queries.select("query_id", "query"), "query_id"))

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if bounded else df

    ledger = store.read("records")
    records = ledger.select(
        F.col("id").alias("record_id"), "scope_id", "kind", "title", "lifecycle", "current_revision"
    )
    scopes = store.read("scopes").select(
        F.col("id").alias("scope_id"), F.col("name").alias("scope_name")
    )
    keys = records.select("record_id", "current_revision").join(
        hint(picked.select("record_id").distinct()), "record_id", "left_semi"
    )
    # Only what is shown is redacted.
    chosen = hint(picked.select(F.col("record_id").alias("id")).distinct())
    current = store.read("record_revisions").join(
        hint(keys.withColumnRenamed("current_revision", "revision")),
        ["record_id", "revision"],
        "left_semi",
    )
    shown_revisions = visible_revisions(ledger.join(chosen, "id", "left_semi"), current, ledger)
    revisions = shown_revisions.select(
        "record_id",
        F.col("revision").alias("current_revision"),
        "payload",
        "created_at",
        "actor",
        "thread",
        "client",
    )
    known = records.join(hint(picked), "record_id").join(scopes, "scope_id")
    sources = recall_sources(
        store.read("source_references")
        .withColumnRenamed("revision", "current_revision")
        .join(hint(keys), ["record_id", "current_revision"], "left_semi")
        .withColumnRenamed("current_revision", "revision")
    ).withColumnRenamed("revision", "current_revision")
    rows = (
        revisions.join(hint(known), ["record_id", "current_revision"])
        .join(sources, ["record_id", "current_revision"], "left")
        .withColumn("text", squeeze(payload_text(F.col("payload"))))
        .withColumn("server_time", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    shown = F.struct(
        "record_id",
        "kind",
        "title",
        F.lit("").alias("excerpt"),
        F.struct(F.col("scope_id").alias("id"), F.col("scope_name").alias("name")).alias("scope"),
        "lifecycle",
        "current_revision",
        F.struct("server_time", "actor", "thread", "client").alias("provenance"),
        F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)).alias("sources"),
        F.coalesce("source_count", F.lit(0).cast("bigint")).alias("source_count"),
        F.struct(
            matched_by().alias("matched_by"),
            "bm25_rank",
            "bm25_score",
            "dense_rank",
            "dense_similarity",
            rrf_score().alias("rrf_score"),
        ).alias("retrieval"),
        recall_explanation(semantic_available).alias("match_explanation"),
    )
    return rows.select(
        "query_id",
        "position",
        "query",
        "text",
        F.to_json(shown, {"ignoreNullFields": "false"}).alias("evidence"),
    )


def encoded(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_bytes(value: object) -> int:
    return len(encoded(value).encode())


def own_size(other_bytes: int) -> int:
    """Size of a text that states its own size, given the bytes beside that number."""
    size = other_bytes + 1
    while other_bytes + len(str(size)) != size:
        size = other_bytes + len(str(size))
    return size


def pack(head: dict, rows: list[dict], budget: int) -> tuple[str | None, int, int, str | None]:
    """(result JSON, used bytes, records, error) of at most five ordered rows.

    Most records at the smallest excerpt size come first; then the largest excerpt size that
    still fits, found by halving. Sizes are added up; only the final result is encoded.
    """
    texts = [centred(r["text"], r["query"]) for r in rows]
    bare = [json_bytes({**r["evidence"], "excerpt": ""}) for r in rows]
    frame = {**head, "budget_bytes": budget, "used_bytes": 0, "records": []}
    frame_bytes = json_bytes(frame) - 1

    def size(count: int, excerpt_bytes: int) -> int:
        shown = sum(
            bare[i] + json_bytes(window(*texts[i], excerpt_bytes)) - 2 for i in range(count)
        )
        return own_size(frame_bytes + shown + max(0, count - 1))

    def result(count: int, excerpt_bytes: int) -> tuple[str, int, int, None]:
        shown = [
            {**rows[i]["evidence"], "excerpt": window(*texts[i], excerpt_bytes)}
            for i in range(count)
        ]
        used = size(count, excerpt_bytes)
        return encoded({**frame, "used_bytes": used, "records": shown}), used, count, None

    fewest = min(len(rows), RECALL_MIN_RESULTS)
    count = len(rows)
    while count > fewest and size(count, EXCERPT_MIN_BYTES) > budget:
        count -= 1
    best = EXCERPT_MIN_BYTES
    if size(count, best) > budget:
        best = 0
        if size(count, best) > budget:
            return None, 0, 0, TOO_SMALL.format(fewest)
    low, high = EXCERPT_MIN_BYTES, EXCERPT_MAX_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if size(count, middle) <= budget:
            low = best = middle
        else:
            high = middle - 1
    return result(count, best)


_PACKED = "query_id bigint, n_records bigint, used_bytes bigint, result string, error string"


def recall_pack(
    rows: DataFrame,
    semantic_available: bool,
    model: str | None = None,
    model_revision: str | None = None,
) -> DataFrame:
    """Packed result per query, by its ``budget``. A group is the at most five rows of
    :func:`recall_order`, or one row without evidence for a query that found nothing."""
    head = {
        "strategy": "dense" if semantic_available else "bm25",
        "semantic_available": semantic_available,
        "model": model if semantic_available else None,
        "model_revision": model_revision if semantic_available else None,
    }

    def pack_query(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("position")
        items = [
            {"evidence": json.loads(r.evidence), "text": r.text, "query": r.query}
            for r in ordered.itertuples()
            if r.evidence is not None
        ]
        text, used, count, error = pack(head, items, int(group["budget"].iloc[0]))
        return pd.DataFrame(
            {
                "query_id": [group["query_id"].iloc[0]],
                "n_records": [count],
                "used_bytes": [used],
                "result": [text],
                "error": [error],
            }
        )

    return rows.groupBy("query_id").applyInPandas(pack_query, _PACKED)


def recall_context(
    store: LedgerStore,
    index: TextIndex,
    queries: DataFrame,
    query_vectors: DataFrame,
    embeddings: DataFrame,
    model: str,
    model_revision: str,
    dimensions: int,
    budget: int = BUDGET_DEFAULT,
    packed: bool = True,
) -> DataFrame:
    """Whole recall for a batch of queries. A column ``max_bytes`` gives each its own budget.

    Dense order is used when the vector index is complete, else the lexical order alone. The
    status is read once, so both retrievals and the order agree on the strategy.
    """
    records = store.read("records")
    status = dense.embedding_status(records, embeddings, model, model_revision, dimensions)
    complete = dense.index_gate(status).first()["strategy"] == "dense"
    answerable = is_blank(queries).filter("NOT blank").drop("blank")
    semantic = None
    if complete:
        vectors = dense.embedding_valid(records, embeddings, model, model_revision, dimensions)
        if "label_ids" in queries.columns:
            held = views.active_assertions(
                store.read("label_assertions"), store.read("label_retractions")
            )
            vectors = dense.labelled(vectors, held)
        asked = dense.dense_queries(answerable, query_vectors, store.read("scopes"))
        semantic = dense.dense_topk(asked, vectors, dimensions, RECALL_CANDIDATES)
    ordered = recall_order(recall_candidates(store, index, answerable, semantic))
    if not packed:
        return ordered
    own = F.lit(budget)
    if "max_bytes" in queries.columns:
        own = F.coalesce(F.col("max_bytes"), own)
    found = evidence(store, ordered, answerable, complete)
    rows = answerable.select("query_id", own.alias("budget")).join(found, "query_id", "left")
    results = recall_pack(rows, complete, model, model_revision)
    return (
        is_blank(queries)
        .select("query_id", "blank")
        .join(results, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("n_records", F.lit(0)).alias("n_records"),
            F.coalesce("used_bytes", F.lit(0)).cast("bigint").alias("used_bytes"),
            "result",
            F.when(F.col("blank"), EMPTY_RECALL).otherwise(F.col("error")).alias("error"),
        )
    )
