"""Helpers that several operators share: inputs, word hashes, windows, small sides of joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to Python at once, whatever the number of rows.
BATCH_BYTES = 8 << 20
#: Ids that a broadcast may hold (8 bytes each); more of them are joined by a shuffle.
SMALL_IDS = 4_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000

#: Text that one task should see at least, where a task works once per distinct word.
TASK_BYTES = 256 << 20

BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: its powers differ in all but few low bits
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` and, if columns are carried, ``row``: no other name can clash."""
    columns = [docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")]
    if carry:
        columns.append(F.struct(*[docs[c] for c in carry]).alias("row"))
    return docs.select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Limits the bytes, not only the rows, of a batch that goes to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def large_tasks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with small partitions read together, as long as all cores have one.

    For work that is done once per distinct word and task: small tasks repeat it.
    """
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(cores, size // TASK_BYTES))


def give_back() -> None:
    """Returns memory that earlier tasks of this Python worker have freed to the system.

    Workers are used again by later stages and else keep what the largest of these took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column) -> list[bytes | None]:
    """The strings of an Arrow column as bytes."""
    return pc.cast(column, pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what bytes.split() separates by."""
    return text.split() if text else []


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``docs`` joined on doc_id with ``ids``, which is broadcast while its counted rows are few.

    ``ids`` should be cheap to count. Beyond SMALL_IDS rows the join shuffles both sides.
    """
    few = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", how)


class WordHashes(dict):
    """64-bit hash of a word (bytes); remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Windows:
    """Hashes of all runs of k consecutive values, in time that doesn't grow with k."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 4096)
            with np.errstate(over="ignore"):
                for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                    steps = np.full(n, factor, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def of(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values)
        if n < k:
            return np.empty(0, np.uint64)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values * self.inverses[:n], out=sums[1:])
            return mix((sums[k:] - sums[:-k]) * self.powers[k - 1 : n])


def batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, types[n])
            for n, c in columns.items()
        ],
        names=list(columns),
    )
