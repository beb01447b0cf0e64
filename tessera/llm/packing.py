"""Packing: token counts of documents into sequences, best fit in decreasing order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, keyed, large_tasks, map_batches, table, utf8
from tessera.session import cut

WINDOW = 2048
#: The id that ends every document.
END = 1
#: Pieces that one task packs.
SHARD_PIECES = 20_000
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000


class Tokens(dict):
    """Ids (little-endian unsigned 32-bit) of a text's words between blanks.

    Right for tokenizers that lower-case, drop white space and never look across it, as
    word_bpe_49k does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.rstrip(b".,;:!?")
        if core != word and core[-1:].isalpha():  # ASCII letters never join what follows them
            found = self[word] = self[core] + self[word[len(core) :]]
            return found
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(word) < 100:
            self[word] = found
        return found

    def of(self, text: bytes | None) -> bytes:
        text = text or b""
        if b"<|" not in text:  # special tokens are found in the text as it stands
            text = text.lower()
        return b"".join([self[word] for word in text.split()])


class OpenWindows:
    """Windows by the room they have left; a segment tree over capacities finds the tightest."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, which: int) -> None:
        if room <= 0:
            return
        self.held[room].append(which)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least ``need``, or None."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at % 2 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        which = self.held[room].pop()
        if not self.held[room]:
            while at and not (at < self.leaves and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at //= 2
        return room, which


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces go in the order given, longest first."""
    open_windows = OpenWindows(window)
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = 0
    for i, need in enumerate(lengths.tolist()):
        found = open_windows.take(need) if need < window else None
        if found is None:
            found, count = (window, count), count + 1
        room, w = found
        which[i], offset[i] = w, window - room
        open_windows.add(room - need, w)
    return which, offset


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every document cut into windows.

    Small partitions of the input are read together: the tokenizer is asked once per word and task.
    """
    docs = large_tasks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # before the vocabulary is loaded
        tokens = Tokens(tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                ids = tokens.of(text) + np.array([END], "<u4").tobytes()
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return map_batches(docs, run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    A document's ids end with END. Longer documents are first cut into full windows and a rest.
    Pieces are dealt at random to shards of about ``shard_pieces``; each shard packs its pieces
    longest first, each into the open sequence with the least room that holds it. A shard wastes
    about as much as one big packing would, as it has thousands of short pieces for the gaps.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per
    piece. Sequence ids are unique: shard + number of shards * sequence within the shard.

    - Null and empty texts are one piece, the end id. Rows with equal or null ids are packed one by
      one. An empty table gives an empty result; other columns are ignored.

    Only the pieces' lengths are shuffled, never their ids. They are checkpointed, so the dealing
    sees one fixed set of rows even if executors are lost.
    """
    cut_up = cut(pieces(keyed(docs, id_col, text_col), tokenizer, window))
    shards = max(1, -(-cut_up.count() // shard_pieces))
    columns = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

    def best(group: pa.Table) -> pa.Table:
        group = group.sort_by(
            [("length", "descending")] + [(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
        )
        which, offset = best_fit(group["length"].to_numpy(), window)
        ids = group["shard"].to_numpy() + shards * which
        group = group.drop_columns(["shard"])
        return group.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    row = F.coalesce("doc_id", F.monotonically_increasing_id())
    dealt = cut_up.withColumn("shard", F.pmod(F.xxhash64(row, "start"), F.lit(shards)).cast("bigint"))
    return dealt.groupBy("shard").applyInArrow(best, f"{columns}, sequence_id bigint, offset bigint")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
