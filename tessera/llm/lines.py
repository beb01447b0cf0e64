"""Line dedup: two Bloom filters find the lines that may repeat; only those are shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import seen
from tessera.llm.common import keyed, map_batches, table, utf8
from tessera.session import cut

#: Lines with fewer code points in their key are never dropped.
MIN_CHARS = 10
#: Limit of each filter, which is broadcast.
FILTER_BYTES = 64 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer white space, A-Z lower-cased; None if it is too short."""
    key = line.strip().lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in (text or b"").split(b"\n")}
    found.discard(None)
    return found


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    filter_bytes: int = FILTER_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drops lines whose key occurs in two documents, but for the one with the smallest id.

    Returns ``doc_id, n_lines, n_dropped, text[, row]``: lines before dropping, dropped lines, the
    kept lines joined by a line feed, and the carried columns as a struct. One row per input row.

    - Null or empty text is one empty line; it comes back as the empty string.
    - Rows with one id count as one document. A row with a null id comes back whole and doesn't
      make another document's line a repeat.
    - Short lines (under ``min_chars`` code points) stay. Lines repeated inside one document only
      stay; in the document that keeps a line, all its occurrences stay.
    - An empty table gives an empty result. Other columns are ignored unless carried.

    A first pass fills the filters: they hold hashes only. A second sends the keys that the
    twice-seen filter has to be grouped, as text, to their smallest and largest id (combined before
    the shuffle, so a line that every document has is one row per task). A third sends 16-byte
    digests of the suspected keys to meet the confirmed ones; Spark may split a hot digest, as
    both sides come straight from a shuffle. The drops of a document, a list no longer than its
    lines, then meet its text.
    """
    docs = keyed(docs, id_col, text_col, carry)
    lines = docs.select(
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    ).first()[0]
    words = seen.size_for(lines or 0, filter_bytes)
    with_id = docs.filter("doc_id is not null").select("doc_id", "text")

    def hashes_of(b: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for text in utf8(b.column("text")):
            keys = keys_of(text, min_chars)
            out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
        return out

    _, twice = seen.build(with_id, hashes_of, words, want_once=False)
    shared = docs.sparkSession.sparkContext.broadcast(twice.words)

    def suspects(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = seen.Filter(shared.value)
            for b in batches:
                ids, found = [], []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                    keys = list(keys_of(text, min_chars))
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                    some = [keys[i] for i in np.flatnonzero(probe.has(hashes))]
                    ids += [doc_id] * len(some)
                    found += some
                digests = [xxhash.xxh3_128_digest(k) for k in found]
                columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary())]
                if whole:
                    columns.append(pa.array(found, pa.binary()))
                yield pa.record_batch(columns, names=["doc_id", "digest", "line"][: len(columns)])

        schema = "doc_id bigint, digest binary" + (", line binary" if whole else "")
        return map_batches(with_id, run, schema)

    repeated = cut(
        suspects(whole=True)
        .groupBy("digest", "line")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("digest", "first")
    )
    drops = (
        suspects(whole=False)
        .join(repeated, "digest")
        .filter("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("drops"))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, dropped, texts = [], [], []
            for text, drops in zip(utf8(b.column("text")), b.column("drops").to_pylist(), strict=True):
                old = (text or b"").split(b"\n")
                kept = old
                if drops:
                    gone = set(drops)
                    kept = []
                    for line in old:
                        key = line_key(line, min_chars)
                        if key is None or xxhash.xxh3_128_digest(key) not in gone:
                            kept.append(line)
                counts.append(len(old))
                dropped.append(len(old) - len(kept))
                texts.append(b"\n".join(kept))
            columns = [
                b.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ] + ([b.column("row")] if carry else [])
            names = ["doc_id", "n_lines", "n_dropped", "text", "row"]
            yield pa.record_batch(columns, names=names[: len(columns)])

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"
    return map_batches(docs.join(drops, "doc_id", "left"), apply, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
