"""Vector codes: every part of a vector is named by its nearest codebook entry, found by ball k-means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, table
from tessera.llm.store import drop, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members of an entry that search the same list of neighbours.
TOGETHER = 64


class Codebook:
    """The entries of one part: an array [entry, position] of integers, and their neighbours.

    ``near[e]`` are all entries in order of their distance from e (itself, or an equal entry, first),
    ``apart[e]`` the squared distances. Integers of Python where doubles aren't exact.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart, self.near = distances(entries, entries), None
        self.near = np.argsort(self.apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(self.apart, self.near, axis=1)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows and entries, exact in either number type."""
    squares = (rows * rows).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :]
    return squares - 2 * (rows @ entries.T)


def nearest(rows: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row, ties to the lower entry, by looking at all entries."""
    all_of = distances(rows, book.entries)
    best = all_of.argmin(axis=1)
    return best, all_of[np.arange(len(rows)), best]


def nearest_in_balls(rows: np.ndarray, book: Codebook, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, for rows whose entry of the round before is known; also the pairs looked at.

    Rows with the same ``own`` entry form a ball around it. An entry at distance d from the center
    can be nearer to a member, or as near, only if the member is at least d / 2 from the center:
    so only entries within twice the ball's radius are neighbours, members nearer than half the
    way to the closest neighbour are the stable core and stay, and a member in the ring between two
    such halves looks at no neighbour beyond its ring.
    """
    gaps = rows - book.entries[own]
    to_own = (gaps * gaps).sum(axis=1)
    best, least, looked = own.copy(), to_own.copy(), 0
    order = np.lexsort((to_own, own))  # members of a ball from its center outwards
    starts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]][: len(order)])
    for start, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
        members = order[start:end]
        center = own[members[0]]
        near, apart = book.near[center], book.apart[center]
        neighbours = np.searchsorted(apart, 4 * to_own[members[-1]], side="right")  # the last is the radius
        rings = np.searchsorted(apart[:neighbours], 4 * to_own[members], side="right")
        outside = np.searchsorted(rings, 1, side="right")  # one entry in reach: the center itself
        for at in range(outside, len(members), TOGETHER):
            some = members[at : at + TOGETHER]
            reach = rings[at : at + TOGETHER]
            asked = np.sort(near[: reach[-1]])  # lower entries first, for ties
            found = distances(rows[some], book.entries[asked])
            place = found.argmin(axis=1)
            best[some], least[some] = asked[place], found[np.arange(len(some)), place]
            looked += found.size
    return best, least, looked


def size_of(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min())) if a.size else 0


def number_type(rows: np.ndarray, entries: np.ndarray) -> type:
    """float, if all squared distances between them are exact as doubles, else object."""
    most = max(size_of(rows), size_of(entries))
    return float if 4 * rows.shape[-1] * most * most < 1 << 53 else object


class Books:
    """Codebooks of all parts, [part, entry, position], for rows cut into as many parts."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.made = entries, {}

    def assign(self, rows: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both [row, part], of rows [row, part, position]."""
        kind = number_type(rows, self.entries)
        if kind not in self.made:
            self.made[kind] = [Codebook(part.astype(kind)) for part in self.entries]
        codes = np.empty(rows.shape[:2], np.uint8)
        far = np.empty(rows.shape[:2], np.int64 if kind is float else object)
        for p, book in enumerate(self.made[kind]):
            part = rows[:, p].astype(kind)
            if own is None:
                codes[:, p], far[:, p] = nearest(part, book)
            else:
                codes[:, p], far[:, p], _ = nearest_in_balls(part, book, own[:, p].astype(np.int64))
        return codes, far


def whole(vector: Column) -> Column:
    """True if a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def of_batch(b: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, parts, -1)


def kept_rows(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, label, x, codes = null) of vectors with the usual length, components as integers; and the table read."""
    x = vectors[vector_col]
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[label_col].alias("label"), x.alias("x"))
    rows = rows.filter(whole(F.col("x")) & (F.size("x") > 0) & (F.size("x") % parts == 0))
    table_of_rows = saved(
        rows.select(
            "vec_id",
            "label",
            F.transform("x", lambda v: F.floor(v.cast("double") * scale)).alias("x"),
            F.lit(None).cast("binary").alias("codes"),
        ),
        "vectors",
    )
    sizes = table_of_rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size")
    usual = sizes.first()
    return table_of_rows.filter(F.size("x") == (usual["size"] if usual else 0)), table_of_rows


def assigned(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """``rows`` with the codes of the nearest entries, and ``error``: the squared distances summed over parts.

    The codebooks go to every task; they have ENTRIES vectors, however many rows there are. Rows
    that have codes keep to the balls of these.
    """
    parts = entries.shape[0]
    label = rows.schema["label"].dataType.simpleString()
    to_tasks = rows.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(to_tasks.value)
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("codes")
            own = None if codes.null_count else np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts)
            new, far = books.assign(of_batch(b, parts), own)
            error = [x if x < 1 << 63 else None for x in far.sum(axis=1).tolist()]
            columns = [b.column("vec_id"), b.column("label"), b.column("x")]
            columns += [pa.array([c.tobytes() for c in new], pa.binary()), pa.array(error, pa.int64())]
            yield pa.record_batch(columns, names=["vec_id", "label", "x", "codes", "error"])

    schema = f"vec_id bigint, label {label}, x array<bigint>, codes binary, error bigint"
    return map_batches(rows.select("vec_id", "label", "x", "codes"), run, schema)


def means(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries moved to the floors of the means of their rows; those without rows stay.

    Every task sends at most one number per entry and position, so what reaches the driver is as
    large as the codebooks.
    """
    parts, count, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * count, np.int64), np.zeros((parts * count, width), object)
        for b in batches:
            x = of_batch(b, parts)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            flat = (codes.astype(np.int64) + np.arange(parts) * count).ravel()
            order = np.argsort(flat, kind="stable")
            which, start = np.unique(flat[order], return_index=True)
            if not len(which):
                continue
            values = x.reshape(-1, width)[order]
            if size_of(values) * len(values) >= 1 << 62:
                values = values.astype(object)
            total[which] += np.add.reduceat(values, start, axis=0).astype(object)
            n[which] += np.diff(np.append(start, len(flat)))
        used = np.flatnonzero(n)
        yield pa.record_batch(
            [
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(np.repeat(n[used], width), pa.int64()),
                pa.array([str(v) for v in total[used].ravel()], pa.string()),
            ],
            names=["entry", "place", "n", "total"],
        )

    sums = map_batches(rows.select("x", "codes"), run, "entry int, place int, n bigint, total string")
    sums = sums.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = entries.copy()
    flat = new.reshape(parts * count, width)
    for row in sums.collect():
        flat[row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return new


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks: an array [part, entry, position] of integers.

    Returns (vec_id, label, x, codes, error): the components as integers floor(scale * x), a byte per
    part, and the squared distance to the entries. At most 256 entries a part.

    - Vectors that are null or hold null or non-finite components are dropped. So are vectors
      without components, with a number of them that isn't a multiple of ``parts``, or with
      another number than most vectors have (the smaller of equally frequent numbers).
    - The codebooks start as the vectors with the smallest ids; of equal ids the smaller vector
      comes first, null ids come last. With fewer vectors the codebooks are smaller.
    - Equal vectors are vectors of their own. An empty table gives an empty result and no entries.
    - Integers are exact: where doubles can't hold the distances, they are integers of Python. A
      component beyond the range of a long is the last of that range; an error beyond it is null.

    Ball k-means: the first round looks at all entries. In later rounds a row knows its entry;
    rows that share one form a ball, whose radius names the entries that any of them could move to,
    and rings within it name those of each member (see ``nearest_in_balls``). Balls are those
    of a batch of rows: smaller than the whole ball, so their neighbours are fewer. The
    integers and codes are a table that each round writes anew, after which the one it read goes;
    nothing but sums is shuffled.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    rows, before = kept_rows(vectors, id_col, vector_col, label_col, parts, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return rows.withColumn("error", F.lit(None).cast("bigint")), np.empty((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        rows = saved(assigned(rows, books), "codes")
        drop(before)
        before, books = rows, means(rows, books)
    return saved(assigned(rows, books), "codes"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    text = ",".join(str(v) for v in books.ravel().tolist())
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"),
    )
