"""Two Bloom filters over 64-bit hashes of a whole table: seen once, seen twice.

A filter is an array of 64-bit words; a hash picks one word and sets BITS bits of it. Every task
fills the parts that its own rows touch and sends them as sparse shards. Shards merge by

    once = once_a | once_b,    twice = twice_a | twice_b | (once_a & once_b)

A hash that two tasks hold has all its bits in both, so no repeat is ever missed. A hash that was
not repeated is taken for repeated now and then, which the reader's exact check removes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches

#: Bits that a hash sets, in one word of the filter.
BITS = 4
#: Words (8 bytes each) of a shard.
SHARD = 1 << 13
#: Hashes that a task holds before it sends its shards.
HELD = 1_000_000
_U = np.uint64


def size_for(hashes: int, max_bytes: int) -> int:
    """Words of a filter for that many hashes: 16 to 32 bits each, at most ``max_bytes`` in all.

    Past the limit the filter takes more hashes for repeats; results stay exact.
    """
    words = SHARD
    while words < hashes / 4 and words * 16 <= max_bytes:
        words *= 2
    return words


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of every hash; ``words`` is a power of two."""
    masks = np.zeros(len(hashes), np.uint64)
    for i in range(BITS):
        masks |= _U(1) << ((hashes >> _U(6 * i)) & _U(63))
    return (hashes >> _U(24)) & _U(words - 1), masks


class Filter:
    """A whole filter, for probing."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at, masks = places(hashes, len(self.words))
        return (self.words[at] & masks) == masks


def _packed(at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> bytes:
    data = at.astype("<u2").tobytes() + once.tobytes() + twice.tobytes()
    return zlib.compress(data, 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 18
    at = np.frombuffer(raw, "<u2", n)
    masks = np.frombuffer(raw, np.uint64, 2 * n, 2 * n)
    return at, masks[:n], masks[n:]


def _merged(at: np.ndarray, once: np.ndarray, twice: np.ndarray):
    """One entry per word: bits of any entry, and bits of two entries or already twice."""
    order = np.argsort(at, kind="stable")
    at, once, twice = at[order], once[order], twice[order]
    while len(at):
        new = np.r_[True, at[1:] != at[:-1]]
        if new.all():
            break
        starts = np.flatnonzero(new)
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        even = np.flatnonzero(rank % 2 == 0)
        paired = even[np.r_[~new[1:], False][even]]  # the next entry is of the same word
        twice[paired] |= twice[paired + 1] | (once[paired] & once[paired + 1])
        once[paired] |= once[paired + 1]
        at, once, twice = at[even], once[even], twice[even]
    return at, once, twice


def _task_shards(values: list[np.ndarray], words: int) -> pa.RecordBatch:
    """Shards of one task. Its own repeats are known exactly: equal hashes, not equal bits."""
    hashes, counts = np.unique(np.concatenate(values), return_counts=True)
    at, masks = places(hashes, words)
    order = np.argsort(at, kind="stable")
    at, masks, counts = at[order], masks[order], counts[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    once = np.bitwise_or.reduceat(masks, starts)
    twice = np.bitwise_or.reduceat(np.where(counts > 1, masks, _U(0)), starts)
    at = at[starts]
    shard = at // _U(SHARD)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    packs = [
        _packed(at[a:b] % _U(SHARD), once[a:b], twice[a:b])
        for a, b in zip(first, np.r_[first[1:], len(at)], strict=True)
    ]
    return pa.record_batch(
        [pa.array(shard[first].astype(np.int64)), pa.array(packs, pa.binary())],
        names=["shard", "pack"],
    )


def build(
    df: DataFrame,
    hashes_of: Callable[[pa.RecordBatch], list[np.ndarray]],
    words: int,
    want_once: bool,
) -> tuple[Filter | None, Filter]:
    """The filters of all hashes that ``hashes_of`` returns for batches of ``df``.

    Shards meet in one small group each: a task sends a word once, however often it saw it.
    The result reaches the driver; ``words`` bounds its size.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        held = 0
        for b in batches:
            got = [v for v in hashes_of(b) if len(v)]
            values += got
            held += sum(map(len, got))
            if held > HELD:
                yield _task_shards(values, words)
                values, held = [], 0
        if values:
            yield _task_shards(values, words)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(p) for p in group["pack"]]
        at, once, twice = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "pack": [_packed(at, once, twice)]})

    shards = map_batches(df, fill, "shard bigint, pack binary")
    merged = shards.groupBy("shard").applyInPandas(join, "shard bigint, pack binary")
    once, twice = np.zeros(words if want_once else 0, np.uint64), np.zeros(words, np.uint64)
    for row in merged.collect():
        at, one, two = _unpacked(row["pack"])
        place = at.astype(np.int64) + row["shard"] * SHARD
        twice[place] = two
        if want_once:
            once[place] = one
    return (Filter(once) if want_once else None), Filter(twice)
