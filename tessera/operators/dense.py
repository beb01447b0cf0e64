"""Vector index state and exact dense retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.payload import payload_text
from tessera.functions.text import normalized
from tessera.functions.vectors import dot, l2_normalize, vector_error
from tessera.operators.blocks import QUERY_BYTES, best_rows, with_filters
from tessera.operators.legacy import visible_revisions
from tessera.operators.retrieval import top_k

# Similarities are ranked after rounding to this many decimals, so equal vectors tie whatever
# block they are scored in.
RANK_DECIMALS = 9
# Fixed value: wording of the refusal.
PENDING = "embedding index has %d pending records; run sync_embeddings"


def of_model(embeddings: DataFrame, model: str, model_revision: str) -> DataFrame:
    return embeddings.filter(
        (F.col("model") == model) & (F.col("model_revision") == model_revision)
    )


def embedding_valid(
    records: DataFrame, embeddings: DataFrame, model: str, model_revision: str, dimensions: int
) -> DataFrame:
    """Vectors of the current revision of readable records: (record_id, scope_id, kind,
    lifecycle, vector)."""
    current = records.filter("readable").select(
        F.col("id").alias("record_id"),
        F.col("current_revision").alias("revision"),
        "scope_id",
        "kind",
        "lifecycle",
    )
    stored = of_model(embeddings, model, model_revision).filter(F.col("dimensions") == dimensions)
    # Both tables hold a record once and are bucketed by its id. The revision is compared after
    # the join, so that the id alone is the join key and neither vectors nor records are shuffled.
    return (
        stored.select("record_id", F.col("revision").alias("embedded"), "vector")
        .join(current, "record_id")
        .filter(F.col("embedded") - F.col("revision") == 0)
        .drop("embedded")
    )


def embedding_pending(
    records: DataFrame, embeddings: DataFrame, model: str, model_revision: str, dimensions: int
) -> DataFrame:
    """Readable records whose vector is missing, stale or of another size."""
    stored = of_model(embeddings, model, model_revision).select(
        "record_id", F.col("revision").alias("embedded"), "dimensions"
    )
    return (
        records.filter("readable")
        .select(F.col("id").alias("record_id"), F.col("current_revision").alias("revision"))
        .join(stored, "record_id", "left")
        .filter(
            F.col("embedded").isNull()
            | (F.col("embedded") != F.col("revision"))
            | (F.col("dimensions") != dimensions)
        )
        .select("record_id", "revision")
    )


def embedding_status(
    records: DataFrame, embeddings: DataFrame, model: str, model_revision: str, dimensions: int
) -> DataFrame:
    """One row: eligible, indexed and pending records."""
    stored = (
        of_model(embeddings, model, model_revision)
        .filter(F.col("dimensions") == dimensions)
        .select("record_id", F.col("revision").alias("embedded"))
    )
    indexed = F.col("embedded") == F.col("current_revision")
    counted = (
        records.filter("readable")
        .select(F.col("id").alias("record_id"), "current_revision")
        .join(stored, "record_id", "left")
        .agg(F.count("*").alias("eligible_records"), F.count_if(indexed).alias("indexed_records"))
    )
    return counted.select(
        F.lit(model).alias("model"),
        F.lit(model_revision).alias("model_revision"),
        F.lit(dimensions).cast("bigint").alias("dimensions"),
        "eligible_records",
        "indexed_records",
        (F.col("eligible_records") - F.col("indexed_records")).alias("pending_records"),
    )


def index_gate(status: DataFrame) -> DataFrame:
    """Which retrieval the index allows: dense only when no record in any scope is pending."""
    return status.select(
        "pending_records",
        F.when(F.col("pending_records") == 0, "dense").otherwise("bm25").alias("strategy"),
    )


def require_complete(rows: DataFrame, status: DataFrame) -> DataFrame:
    """``rows``, failing when the index is not complete."""
    pending = status.select("pending_records").scalar()
    message = F.format_string(PENDING, pending)
    return rows.filter(F.when(pending > 0, F.raise_error(message)).otherwise(F.lit(True)))


def embedding_upsert(
    records: DataFrame, embeddings: DataFrame, incoming: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(stored vectors afterwards, outcome per incoming vector).

    A vector is applied when it is well formed and of the record's current revision; a stale
    one is ignored, one for a hidden or unknown record is refused.
    """
    current = records.filter("readable").select(F.col("id").alias("record_id"), "current_revision")
    outcome = incoming.join(current, "record_id", "left").withColumn(
        "outcome",
        F.when(vector_error(F.col("vector"), F.col("dimensions")).isNotNull(), "invalid")
        .when(F.col("current_revision").isNull(), "missing")
        .when(F.col("current_revision") != F.col("revision"), "stale")
        .otherwise("applied"),
    )
    key = ["record_id", "model", "model_revision"]
    applied = outcome.filter("outcome = 'applied'").select(*incoming.columns)
    stored = embeddings.join(applied.select(*key), key, "left_anti").unionByName(applied)
    return stored, outcome


def record_text(
    records: DataFrame,
    revisions: DataFrame,
    wanted: DataFrame | None = None,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """(record_id, revision, text) that a model embeds: normalized title and payload text.

    ``wanted`` narrows the revisions by (record_id, revision) before any text is made; ``ledger``
    has all records if ``records`` has not.
    """
    current = wanted
    if current is None:
        current = records.select(
            F.col("id").alias("record_id"), F.col("current_revision").alias("revision")
        )
    rows = (
        visible_revisions(records, revisions, ledger)
        .select("record_id", "revision", "title", "payload")
        .join(current, ["record_id", "revision"], "left_semi")
        .select(
            "record_id",
            "revision",
            F.concat_ws("\n", "title", payload_text(F.col("payload"))).alias("text"),
        )
    )
    return normalized(rows, "text")


def embedding_sync(
    records: DataFrame,
    revisions: DataFrame,
    embeddings: DataFrame,
    embed: Callable[[pd.Series], pd.Series],
    model: str,
    model_revision: str,
    dimensions: int,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Embed every pending record with the caller's model and upsert the vectors.

    ``embed`` maps a batch of texts to a batch of vectors; it runs on Arrow batches inside the
    tasks. Vectors are scaled to unit length before they are stored.
    """
    pending = embedding_pending(records, embeddings, model, model_revision, dimensions)
    texts = record_text(records, revisions, pending, ledger)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield embed(batch)

    embedded = texts.select("record_id", "revision", vectors("text").alias("raw"))
    incoming = embedded.select(
        "record_id",
        "revision",
        F.lit(model).alias("model"),
        F.lit(model_revision).alias("model_revision"),
        F.lit(dimensions).cast("bigint").alias("dimensions"),
        l2_normalize(F.col("raw")).alias("vector"),
    )
    return embedding_upsert(records, embeddings, incoming)


def dense_score(pairs: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Similarity of given (query_id, record_id) pairs."""
    return (
        pairs.join(vectors.select("record_id", "vector"), "record_id")
        .join(query_vectors.select("query_id", F.col("vector").alias("query_vector")), "query_id")
        .withColumn("similarity", dot(F.col("vector"), F.col("query_vector")))
        .drop("vector", "query_vector")
    )


def labelled(rows: DataFrame, active_assertions: DataFrame) -> DataFrame:
    """Rows with the ids of the record's active labels (at most the label catalogue), which
    queries with a label filter need."""
    held = active_assertions.groupBy("record_id").agg(F.collect_set("label_id").alias("labels"))
    return rows.join(held, "record_id", "left")


def dense_queries(queries: DataFrame, query_vectors: DataFrame, scopes: DataFrame) -> DataFrame:
    """Queries with their vector, the scopes they may read, and their filters."""
    return with_filters(queries, scopes).join(
        query_vectors.select("query_id", F.col("vector").alias("query_vector")), "query_id"
    )


def similarities(queries: pd.DataFrame, block: pa.Table) -> Callable[[np.ndarray, int], np.ndarray]:
    """Values of a block as one matrix product, in double precision."""
    asked = np.array(queries["query_vector"].tolist(), dtype=np.float64)
    flat = block.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    scores = flat.astype(np.float64).reshape(block.num_rows, -1) @ asked.T
    return lambda rows, q: scores[rows, q]


def dense_topk(
    queries: DataFrame, vectors: DataFrame, dimensions: int, k: int, **sizes: int
) -> DataFrame:
    """Best ``k`` vectors per query by exact similarity, then newest record.

    ``queries`` come from :func:`dense_queries`, ``vectors`` from :func:`embedding_valid`;
    ``sizes`` are those of :func:`best_rows`.
    """
    hits = best_rows(
        queries,
        vectors,
        k,
        similarities,
        ["vector"],
        RANK_DECIMALS,
        query_bytes=QUERY_BYTES + dimensions * 8,
        **sizes,
    ).withColumnRenamed("value", "similarity")
    ranked = F.round("similarity", RANK_DECIMALS)
    return top_k(hits, k, F.desc(ranked), F.desc("record_id"), rank="dense_rank")
