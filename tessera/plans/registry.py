"""Registry of named queries, and inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.ordering import allocate_ids
from tessera.operators.retrieval import QueryBatch
from tessera.sources import corpus
from tessera.sources.store import LedgerStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MODEL = (corpus.MODEL, corpus.MODEL_REVISION, 64)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def on_ledger(fn: Callable[[LedgerStore], DataFrame]):
    """Register a query that needs the derived ledger only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(corpus.ledger(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def assertions(store: LedgerStore) -> tuple[DataFrame, DataFrame]:
    return store.read("label_assertions"), store.read("label_retractions")


def pair_queries(spark: SparkSession, sf_dir: str, glue: str) -> DataFrame:
    """Whole benchmark texts, cut into consecutive pairs of words."""
    at = F.sequence(F.lit(0), F.size("ws") - 1, F.lit(2))
    pairs = (
        corpus.table(spark, sf_dir, "benchmark")
        .select("item_id", words(F.col("text")).alias("ws"))
        .select("item_id", "ws", F.posexplode(at).alias("part", "start"))
        .select(
            "item_id",
            "part",
            F.array_join(F.slice("ws", F.col("start") + 1, F.lit(2)), glue).alias("query"),
        )
    )
    return allocate_ids(pairs, ["item_id", "part"], 0, "query_id").drop("part")


def query_batch(store: LedgerStore) -> QueryBatch:
    return QueryBatch.of(corpus.query_table(store), store.read("scopes"))
