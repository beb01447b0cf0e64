"""Substring dedup: fixed blocks as anchors, rolling windows as probes, exact repeats of windows.

Any run of SPAN words holds a whole block of BLOCK words of its document's fixed grid, as
SPAN >= 2 * BLOCK - 1. So a run that occurs twice covers, in each document, either a place off the
grid that equals some block, or a block that equals another block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import seen
from tessera.llm.common import WordHashes, Windows, keyed, map_batches, table, utf8
from tessera.llm.store import saved

SPAN = 35
#: Limit of each of the two filters, which are broadcast.
FILTER_BYTES = 64 << 20
#: Bytes of text in a chunk, and (about) of text per bucket of window keys.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20

_SECOND = 0xC2B2AE3D27D4EB4F | 3  # another base: keys of windows have 128 bits


class Runs:
    """Hashes of the runs of a document."""

    def __init__(self, span: int):
        self.span, self.block = span, (span + 1) // 2
        self.hashes, self.one, self.two = WordHashes(), Windows(), Windows(_SECOND)

    def blocks(self, text: bytes | None) -> np.ndarray:
        values = self.hashes.of((text or b"").split())
        return self.one.of(values, self.block)[:: self.block]

    def candidates(
        self, words: list[bytes], once: seen.Filter, twice: seen.Filter
    ) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs that cover an anchor, and their 128-bit keys (n x 2)."""
        if len(words) < self.span:
            return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
        values = self.hashes.of(words)
        probe = self.one.of(values, self.block)
        hit = once.has(probe)
        hit[:: self.block] = twice.has(probe[:: self.block])
        inside = np.r_[0, np.cumsum(hit)]
        reach = self.span - self.block + 1  # block starts that a run covers
        starts = np.flatnonzero(inside[reach:] - inside[:-reach])
        keys = np.stack([self.one.of(values, self.span)[starts], self.two.of(values, self.span)[starts]], 1)
        return starts, keys


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents packed into compressed chunks (chunk, pack), saved so that chunks stay the same.

    A chunk is closed at ``chunk_bytes`` of text; a longer document is a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack"])

        for b in batches:
            sizes = [len(t or b"") for t in utf8(b.column("text"))]
            first = 0
            for i, n in enumerate(sizes):
                if size and size + n > chunk_bytes:
                    if i > first:
                        held.append(b.slice(first, i - first))
                    yield closed()
                    held, size, first = [], 0, i
                size += n
            if len(sizes) > first:
                held.append(b.slice(first))
        if held:
            yield closed()

    packs = map_batches(docs, run, "pack binary")
    return saved(packs.select(F.monotonically_increasing_id().alias("chunk"), "pack"), "chunks")


def unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


class ChunkKeys:
    """The distinct candidate keys of a chunk, by bucket."""

    def __init__(self, texts: list[bytes | None], runs: Runs, once: seen.Filter, twice: seen.Filter, buckets: int):
        self.words = [(t or b"").split() for t in texts]
        found = [runs.candidates(w, once, twice) for w in self.words]
        self.starts = [f[0] for f in found]
        keys = np.concatenate([f[1] for f in found]) if found else np.empty((0, 2), np.uint64)
        bucket = keys[:, 0] % np.uint64(buckets)
        order = np.lexsort((keys[:, 1], keys[:, 0], bucket))
        keys = keys[order]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][: len(keys)]
        self.place = np.empty(len(keys), np.int64)  # of each occurrence, among the distinct keys
        self.place[order] = np.cumsum(new) - 1
        self.keys = keys[new]
        self.twice = np.bincount(self.place, minlength=len(self.keys)) > 1
        self.bucket = bucket[order][new].astype(np.int64)
        first = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]][: len(self.keys)])
        self.parts = list(zip(first, np.append(first, len(self.keys))[1:], strict=True))

    def packets(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, keys, marks of those that the chunk itself holds twice)."""
        for a, b in self.parts:
            yield int(self.bucket[a]), self.keys[a:b].tobytes(), np.packbits(self.twice[a:b]).tobytes()


def _repeats(table: pa.Table) -> pa.Table:
    """For one bucket: each chunk's marks of the keys that occur twice anywhere."""
    packs = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in table["keys"].to_pylist()]
    sizes = [len(k) for k in packs]
    keys = np.concatenate(packs)
    marks = np.concatenate(
        [np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(table["marks"].to_pylist(), sizes, strict=True)]
    ).astype(bool)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    same = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    marks[order[1:]] |= same
    marks[order[:-1]] |= same
    # a key that one chunk holds twice and no other holds keeps its own mark
    ends = np.cumsum(sizes)
    out = [np.packbits(marks[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "marks": pa.array(out, pa.binary())})


def drop_repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    filter_bytes: int = FILTER_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Removes every word that lies in a run of ``span`` words which also starts elsewhere.

    Returns ``doc_id, n_words, n_removed, text[, row]``: the kept words joined by one space, and
    the carried columns as a struct. One row per input row.

    - Elsewhere means any other place of any row, of the same document too; runs are judged on the
      input, so all copies of a passage go.
    - Null, empty and blank texts have no words and come back as the empty string. Ids play no
      part: rows with equal or null ids are different places. An empty table gives an empty result.

    The blocks of every document's fixed grid fill two filters: seen once, seen twice. Every
    rolling window of a block's length probes them, and the runs that cover a hit are candidates.
    Their 128-bit keys are confirmed exactly: chunks of documents send each distinct key once, in
    packets to buckets, and get a bit per key back. A passage that every document holds is one key
    per chunk. Overlapping repeated runs join to maximal repeats where words are removed.
    """
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col, carry)
    chunks = chunked(docs)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    block = (span + 1) // 2

    def hashes_of(b: pa.RecordBatch) -> list[np.ndarray]:
        runs = Runs(span)
        return [runs.blocks(t) for p in b.column("pack").to_pylist() for t in utf8(unpacked(p)["text"])]

    # a word of text has two bytes at least, six on the average
    once, twice = seen.build(chunks, hashes_of, seen.size_for(size // (4 * block), filter_bytes), True)
    filters = spark.sparkContext.broadcast((once.words, twice.words))

    def keys_of(pack: bytes, runs: Runs) -> tuple[pa.Table, ChunkKeys]:
        rows = unpacked(pack)
        once, twice = filters.value
        return rows, ChunkKeys(utf8(rows["text"]), runs, seen.Filter(once), seen.Filter(twice), buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(span)
        for b in batches:
            for chunk, pack in zip(b.column("chunk").to_pylist(), b.column("pack").to_pylist(), strict=True):
                packets = list(keys_of(pack, runs)[1].packets())
                if packets:
                    at, keys, marks = zip(*packets, strict=True)
                    yield pa.record_batch(
                        [
                            pa.array([chunk] * len(at), pa.int64()),
                            pa.array(at, pa.int64()),
                            pa.array(keys, pa.binary()),
                            pa.array(marks, pa.binary()),
                        ],
                        names=["chunk", "bucket", "keys", "marks"],
                    )

    packets = map_batches(chunks, send, "chunk bigint, bucket bigint, keys binary, marks binary")
    marked = packets.groupBy("bucket").applyInArrow(_repeats, "chunk bigint, bucket bigint, marks binary")
    marked = marked.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks")).alias("marked"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(span)
        for b in batches:
            for pack, marked in zip(b.column("pack").to_pylist(), b.column("marked").to_pylist(), strict=True):
                rows, own = keys_of(pack, runs)
                by_bucket = {m["bucket"]: m["marks"] for m in marked or ()}
                repeated = np.zeros(len(own.keys), bool)
                for a, z in own.parts:
                    bits = np.unpackbits(np.frombuffer(by_bucket[int(own.bucket[a])], np.uint8))
                    repeated[a:z] = bits[: z - a]
                counts, removed, texts = [], [], []
                at = 0
                for words, starts in zip(own.words, own.starts, strict=True):
                    hits = starts[repeated[own.place[at : at + len(starts)]]]
                    at += len(starts)
                    kept = words
                    if len(hits):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, hits, 1)
                        np.add.at(edge, hits + span, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    counts.append(len(words))
                    removed.append(len(words) - len(kept))
                    texts.append(b" ".join(kept))
                columns = [
                    rows["doc_id"].combine_chunks(),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ] + ([rows["row"].combine_chunks()] if carry else [])
                names = ["doc_id", "n_words", "n_removed", "text", "row"]
                yield pa.record_batch(columns, names=names[: len(columns)])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, text string"
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"
    return map_batches(chunks.join(marked, "chunk", "left").select("pack", "marked"), apply, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_runs(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
