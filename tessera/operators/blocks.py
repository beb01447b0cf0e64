"""Top records per query over blocks of rows, without a row per (query, record) pair.

A task looks at its rows block by block and keeps the best k per query; only those leave the
task. A query batch of checked size is sent to every task. A larger one meets the rows in a
grid of cells: queries are repeated per block of rows and rows per block of queries, and every
cell holds a bounded number of both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.limits import GLOBAL_SCOPE

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_CELL = 50_000
QUERIES_PER_CELL = 2_000
# Values of (query, row) pairs that a task holds at once, 8 bytes each.
VALUES_AT_ONCE = 4_000_000
# Beside its vector a query holds a few short lists.
QUERY_BYTES = 512
FILTER_COLUMNS = ["record_id", "scope_id", "kind", "lifecycle", "labels"]

# (queries, block) -> function of (row numbers, query number) -> values, larger is better
Values = Callable[[pd.DataFrame, pa.Table], Callable[[np.ndarray, int], np.ndarray]]


def with_filters(queries: DataFrame, scopes: DataFrame, *columns: str) -> DataFrame:
    """Queries with the scopes they may read and their filter lists; absent ones are empty."""
    global_id = scopes.filter(F.col("name") == GLOBAL_SCOPE).select("id").scalar()
    allowed = F.when(F.col("include_global"), F.array("scope_id", global_id)).otherwise(
        F.array("scope_id")
    )

    def listed(name: str, kind: str) -> Column:
        empty = F.array().cast(f"array<{kind}>")
        return (F.coalesce(name, empty) if name in queries.columns else empty).alias(name)

    before = F.col("before_id") if "before_id" in queries.columns else F.lit(None)
    return queries.select(
        "query_id",
        F.array_compact(allowed).alias("scope_ids"),
        listed("kinds", "string"),
        listed("lifecycles", "string"),
        listed("label_ids", "bigint"),
        before.cast("bigint").alias("before_id"),
        *columns,
    )


class BlockFilter:
    """Which rows of a block each query may see."""

    def __init__(self, queries: pd.DataFrame):
        self.scopes = [set(s) for s in queries["scope_ids"]]
        self.kinds = [set(s) for s in queries["kinds"]]
        self.lifecycles = [set(s) or {"active"} for s in queries["lifecycles"]]
        self.labels = [set(s) for s in queries["label_ids"]]
        self.before = [None if pd.isna(b) else int(b) for b in queries["before_id"]]

    def open(self, block: pa.Table) -> Callable[[int], np.ndarray]:
        """Function of a query number that gives its row numbers in this block."""
        columns = {c: block.column(c).to_numpy() for c in FILTER_COLUMNS[:4]}
        seen: dict = {}

        def mask(column: str, wanted: set) -> np.ndarray:
            key = (column, frozenset(wanted))
            if key not in seen:
                seen[key] = np.isin(columns[column], list(wanted))
            return seen[key]

        if any(self.labels):
            held = block.column("labels").combine_chunks()
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(block.num_rows), sizes)
            flat = held.flatten().to_numpy(zero_copy_only=False)

        def has_label(label: int) -> np.ndarray:
            if ("label", label) not in seen:
                on = np.zeros(block.num_rows, dtype=bool)
                on[owner[flat == label]] = True
                seen["label", label] = on
            return seen["label", label]

        def rows(q: int) -> np.ndarray:
            keep = mask("scope_id", self.scopes[q]) & mask("lifecycle", self.lifecycles[q])
            if self.kinds[q]:
                keep = keep & mask("kind", self.kinds[q])
            for label in self.labels[q]:
                keep = keep & has_label(label)
            if self.before[q] is not None:
                keep = keep & (columns["record_id"] < self.before[q])
            return np.flatnonzero(keep)

        return rows


class BestRows:
    """Best k records per query over the blocks it is shown; equal values prefer larger ids."""

    def __init__(self, queries: pd.DataFrame, k: int, values: Values, decimals: int | None):
        self.queries, self.k, self.values, self.decimals = queries, k, values, decimals
        self.ids = queries["query_id"].to_numpy()
        self.filter = BlockFilter(queries)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.ids)

    def add(self, block: pa.Table) -> None:
        if block.num_rows == 0 or len(self.ids) == 0:
            return
        records = block.column("record_id").to_numpy()
        rows_of = self.filter.open(block)
        # Values are made for some queries at a time, however many queries and rows there are.
        step = max(1, VALUES_AT_ONCE // block.num_rows)
        for q in range(len(self.ids)):
            if q % step == 0:
                value_of = self.values(self.queries.iloc[q : q + step], block)
            rows = rows_of(q)
            values, ids = value_of(rows, q % step), records[rows]
            if self.best[q] is not None:
                values = np.concatenate([self.best[q][0], values])
                ids = np.concatenate([self.best[q][1], ids])
            ranked = values if self.decimals is None else np.round(values, self.decimals)
            if len(ranked) > self.k:
                floor = np.partition(ranked, -self.k)[-self.k]
                above = np.flatnonzero(ranked >= floor)
                values, ids, ranked = values[above], ids[above], ranked[above]
            order = np.lexsort((-ids, -ranked))[: self.k]
            self.best[q] = (values[order], ids[order])

    def result(self) -> pa.Table:
        kept = [(q, *b) for q, b in zip(self.ids, self.best, strict=True) if b is not None]
        parts = {
            "query_id": [np.full(len(ids), q) for q, _, ids in kept],
            "record_id": [ids for _, _, ids in kept],
            "value": [values for _, values, _ in kept],
        }
        types = {"query_id": pa.int64(), "record_id": pa.int64(), "value": pa.float64()}
        return pa.table(
            {
                name: pa.array(np.concatenate(arrays) if arrays else [], types[name])
                for name, arrays in parts.items()
            }
        )


_HITS = "query_id bigint, record_id bigint, value double"


def best_rows(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    values: Values,
    columns: list[str] = (),
    decimals: int | None = None,
    query_bytes: int = QUERY_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_cell: int = ROWS_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """(query_id, record_id, value): at most k rows per query and task or cell.

    ``queries`` come from :func:`with_filters`; ``rows`` have the filter columns (``labels`` may
    be absent) and ``columns``.
    """
    if "labels" not in rows.columns:
        rows = rows.withColumn("labels", F.lit(None).cast("array<bigint>"))
    rows = rows.select(*FILTER_COLUMNS, *columns)
    room = broadcast_bytes // query_bytes
    if queries.limit(room + 1).count() <= room:
        sent = rows.sparkSession.sparkContext.broadcast(queries.toPandas())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = BestRows(sent.value, k, values, decimals)
            for batch in batches:
                best.add(pa.Table.from_batches([batch]))
            yield from best.result().to_batches()

        return rows.mapInArrow(scan, _HITS)

    # Ids are unique, so hashing them fills the cells evenly.
    high = max(1, math.ceil(rows.count() / rows_per_cell))
    wide = max(1, math.ceil(queries.count() / queries_per_cell))

    def numbers(n: int) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))

    left = queries.withColumn("cell_q", F.pmod(F.xxhash64("query_id"), F.lit(wide))).withColumn(
        "cell_r", F.explode(numbers(high))
    )
    right = rows.withColumn("cell_r", F.pmod(F.xxhash64("record_id"), F.lit(high))).withColumn(
        "cell_q", F.explode(numbers(wide))
    )

    def cell(q: pa.Table, r: pa.Table) -> pa.Table:
        best = BestRows(q.to_pandas(), k, values, decimals)
        best.add(r)
        return best.result()

    return (
        left.groupBy("cell_q", "cell_r")
        .cogroup(right.groupBy("cell_q", "cell_r"))
        .applyInArrow(cell, _HITS)
    )


def newest_first(queries: pd.DataFrame, block: pa.Table) -> Callable[[np.ndarray, int], np.ndarray]:
    """Listing order: the value of a record is its id."""
    ids = block.column("record_id").to_numpy()
    return lambda rows, q: ids[rows]
