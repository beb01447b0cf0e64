"""Exact top-k search by inner product: sorted lists read in sequence, bounds, early stop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Rows of a block of candidates, and of a block of queries; a pair of blocks is one task's work.
CANDIDATES, QUERIES = 4096, 2048
#: Queries whose bounds are held at once.
SLICE = 256
#: Depths to which the lists are read, as shares of their length; the last reads them whole.
DEPTHS = (1 / 8, 1 / 2, 1.0)
#: Outsiders are resolved singly once this share of the pairs is left.
FEW = 0.05
SCALE = 64


class Lists:
    """For each dimension the values of a block of candidates, sorted, to be read from both ends.

    A query reads a dimension from the top if its weight is positive, else from the bottom. What it
    has not read yet lies between the list's other end and the last value read.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        kind = np.float64
        self.values = values.astype(kind)
        order = np.argsort(self.values, axis=0, kind="stable")
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.values, order, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values with the unread ones at their upper and lower bound: from the top, from the bottom."""
        top = self.place >= self.n - depth
        bottom = self.place < depth
        return (
            np.where(top, self.values, self.sorted[self.n - depth]),
            np.where(bottom, self.values, self.sorted[depth - 1]),
            np.where(top, self.values, self.sorted[0]),
            np.where(bottom, self.values, self.sorted[-1]),
        )


def _number_kind(queries: np.ndarray, values: np.ndarray):
    """The fastest type in which all sums are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(1, queries.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _best(scores: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores; ties to the smaller column."""
    at = np.flatnonzero(alive)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def search_block(
    values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates with another id.

    All lists are read to the same depth in turn. A candidate's bounds add up what was read and, for
    the rest, the bounds of what was not. Once no outsider's upper bound reaches the k-th best lower
    bound but for a few, these are resolved by their whole rows. Candidates must be sorted by id.
    """
    n, m = len(values), len(queries)
    if not n or not m:
        return (np.empty(0, np.int64),) * 3
    kind = _number_kind(queries, values)
    if kind is object:  # beyond doubles: whole numbers of any size
        scores = queries.astype(np.int64).astype(object) @ values.astype(np.int64).astype(object).T
        alive = ids[None, :] != query_ids[:, None]
        found = [_best(scores[i], alive[i], k) for i in range(m)]
        rows = np.repeat(np.arange(m), [len(f) for f in found])
        at = np.concatenate(found)
        return rows, at, np.array([int(s) for s in scores[rows, at]], np.int64)
    lists = Lists(values)
    depths = sorted({max(1, min(n, int(n * d))) for d in DEPTHS})
    bounds = {d: [x.astype(kind).T for x in lists.read(d)] for d in depths if d < n}
    whole = np.ascontiguousarray(values.astype(kind).T)
    rows, columns, best = [], [], []
    for start in range(0, m, SLICE):
        q = queries[start : start + SLICE].astype(kind)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        alive = ids[None, :] != query_ids[start : start + SLICE, None]
        low = None
        for depth in depths:
            if depth == n:
                break
            high_top, high_bottom, low_top, low_bottom = bounds[depth]
            # a negative weight is highest at the least value, which is read from the bottom
            high = plus @ high_top + minus @ high_bottom
            low = np.where(alive, plus @ low_top + minus @ low_bottom, -np.inf)
            if n > k:
                kth = -np.partition(-low, k - 1, axis=1)[:, k - 1]
                alive &= high >= kth[:, None]
            if alive.sum() <= FEW * alive.size:
                break
        else:
            depth = n
        few = depth < n and low is not None and alive.sum() <= FEW * alive.size
        scores = None if few else q @ whole
        for i in range(len(q)):
            if few:
                at = np.flatnonzero(alive[i])
                exact = np.full(n, -np.inf)
                exact[at] = whole[:, at].T @ q[i]
            else:
                exact = scores[i]
                if alive[i].sum() > 4 * k:
                    own = np.where(alive[i], exact, -np.inf)
                    kth = -np.partition(-own, k - 1)[k - 1]
                    alive[i] &= exact >= kth
            at = _best(exact, alive[i], k)
            rows.append(np.full(len(at), start + i))
            columns.append(at)
            best.append(exact[at])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(best).astype(np.int64)


def search_repeated(
    values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best ids; candidates sorted by id may share ids.

    The first rows of all ids are one block, their second rows the next, and so on; after each
    block the k best ids of a query are kept.
    """
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
    turn = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    best = (np.empty(0, np.int64),) * 3
    for t in range(int(turn.max(initial=-1)) + 1):
        own = np.flatnonzero(turn == t)
        row, at, score = search_block(values[own], ids[own], queries, query_ids, k)
        found = row, ids[own][at], score
        if t:
            row, which, score = (np.concatenate(x) for x in zip(best, found, strict=True))
            order = np.lexsort((-score, which, row))
            row, which, score = row[order], which[order], score[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1])][: len(row)]
            row, which, score = row[new], which[new], score[new]
            order = np.lexsort((which, -score, row))
            row, which, score = row[order], which[order], score[order]
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
            found = tuple(x[place < k] for x in (row, which, score))
        best = found
    return best


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """The k rows with the highest inner product for each query row, exactly.

    Components become floor(scale * x). Returns ``query_id, rank, vec_id, score``: rank from 1, ties
    to the smaller id, fewer than k rows if there are fewer candidates.

    - Rows with a null id or vector, or a null or non-finite component, take no part. Vectors of
      different lengths don't meet. A vector of length 0 scores 0.
    - Rows with the query's own id are no candidates. Rows with equal ids count once, with their
      best score. An empty table gives an empty result; other columns are ignored.
    - Scores must fit a long.

    Candidates and queries are dealt to blocks of CANDIDATES and QUERIES rows. Each pair of blocks
    is one group and reads the block's sorted lists without random access (see ``search_block``);
    it sends k rows per query. The final ranking keeps k rows per query and task before it shuffles.
    """
    x = vectors[vector_col]
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), x.alias("x"), is_query.alias("query")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & _finite(F.col("x"))
    )
    rows = rows.select(
        "id",
        "query",
        F.transform("x", lambda v: F.floor(v.cast("double") * scale)).alias("values"),
        F.size("x").alias("size"),
    )
    n, m = rows.select(F.count("*"), F.count_if("query")).first()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    block = F.pmod(F.xxhash64("id", "values"), F.lit(blocks)).cast("bigint").alias("block")
    group = F.pmod(F.xxhash64("id", "values"), F.lit(groups)).cast("bigint").alias("group")
    every_block, every_group = (
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(top - 1).cast("bigint"))).alias(name)
        for name, top in (("block", blocks), ("group", groups))
    )
    candidates = rows.select("size", block, every_group, "id", "values")
    queries = rows.filter("query").select("size", every_block, group, "id", "values")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        parts = []
        for side in (left, right):
            flat = side["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            parts.append((flat.reshape(side.num_rows, -1) if side.num_rows else flat.reshape(0, 0), side["id"].to_numpy()))
        (values, ids), (wanted, query_ids) = parts
        at, which, score = search_repeated(values, ids, wanted, query_ids, k)
        return pa.table({"query_id": query_ids[at], "vec_id": which, "score": score})

    keys = ["size", "block", "group"]
    found = (
        candidates.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.coalesce(vectors["vec_id"] % 20 == 0, F.lit(False)), 20)
