"""Quality rules: log-likelihood ratio of hashed n-grams between trusted text and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import (
    WordHashes,
    Windows,
    keyed,
    map_batches,
    mix,
    of_ids,
    table,
    utf8,
    words_of,
)

#: Buckets of hashed n-grams; an n-gram is this many consecutive bytes, or one whole word.
BUCKETS = 1 << 16
GRAM = 3
#: Scores are whole multiples of 1 / SCALE per n-gram, so that sums don't depend on their order.
SCALE = 1 << 16
#: Bins of scores among which the threshold lies.
BINS = 4096
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(text: bytes, words: np.ndarray) -> np.ndarray:
    """Buckets of a document's n-grams: words, and runs of GRAM bytes with digits as one."""
    raw = np.frombuffer(text, np.uint8)
    out = [mix(words) & np.uint64(BUCKETS - 1)]
    if len(raw) >= GRAM:
        value = np.zeros(len(raw) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            value = (value << np.uint64(8)) | raw[i : len(raw) - GRAM + 1 + i]
        out.append(mix(value) & np.uint64(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def _hashes() -> WordHashes:
    return WordHashes()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, trusted, raw) over all rows of (text, trusted boolean), one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, good in zip(utf8(b.column("text")), b.column("trusted").to_pylist(), strict=True):
                if text:
                    found = np.bincount(grams(text, hashes.of(words_of(text))), minlength=BUCKETS)
                    total[1] += found
                    if good:
                        total[0] += found
        at = np.flatnonzero(total[1])
        yield pa.record_batch(
            [pa.array(x) for x in (at, total[0][at], total[1][at])],
            names=["bucket", "trusted", "raw"],
        )

    rows = map_batches(docs, count, "bucket bigint, trusted bigint, raw bigint")
    return rows.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def weights(counts: DataFrame) -> np.ndarray:
    """log p(trusted) / p(raw) of every bucket, in multiples of 1 / SCALE.

    Both multinomials are smoothed by one count per bucket. At most BUCKETS rows reach the driver.
    """
    total = np.zeros((2, BUCKETS), np.float64)
    for bucket, trusted, raw in counts.collect():
        total[:, bucket] = trusted, raw
    p = np.log(total + 1) - np.log(total.sum(axis=1, keepdims=True) + BUCKETS)
    return np.rint((p[0] - p[1]) * SCALE).astype(np.int64)


def measures(text: bytes | None, hashes: WordHashes, windows: Windows) -> tuple[list[int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the word hashes."""
    words = words_of(text)
    values = hashes.of(words)
    if not words:
        raw = np.frombuffer(text or b"", np.uint8)
        return [0, 0, int(_SYMBOL[raw].sum()), 0, 0], values
    raw = np.frombuffer(text, np.uint8)
    starts_char = (raw & 0xC0) != 0x80
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if len(values) >= 3:
        _, back, n = np.unique(windows.of(values, 3), return_inverse=True, return_counts=True)
        marks = np.zeros(len(values), bool)
        for at in range(3):
            marks[at : len(values) - 2 + at] |= n[back] > 1
        repeat = int(marks.sum())
    return [
        len(words),
        int((starts_char & ~blank).sum()),
        int(_SYMBOL[raw].sum()),
        len(lines) - len(set(lines)),
        repeat,
    ], values


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def scored(docs: DataFrame, table_of_weights: np.ndarray) -> DataFrame:
    """Rows of (doc_id, text, …) with the measures and ``score``, the mean weight of the n-grams.

    The text goes; all other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table_of_weights)
    others = [c for c in docs.columns if c != "text"]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows = _hashes(), Windows()
        for b in batches:
            rows, scores = [], []
            for text in utf8(b.column("text")):
                row, values = measures(text, hashes, windows)
                rows.append(row)
                at = grams(text, values) if text else ()
                scores.append(int(shared.value[at].sum()) / SCALE / len(at) if len(at) else None)
            columns = np.array(rows, np.int64).reshape(-1, len(names)).T
            yield pa.record_batch(
                [b.column(c) for c in others]
                + [pa.array(np.ascontiguousarray(c)) for c in columns]
                + [pa.array(scores, pa.float64())],
                names=[*others, *names, "score"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in others)
    return map_batches(docs, score, f"{kept}, {COLUMNS}, score double")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def threshold(labelled: DataFrame) -> float:
    """The score that parts trusted from untrusted rows of (score, trusted) with the best balance.

    Candidates are BINS equal steps of [-2, 2]; at most that many counts reach the driver. Of
    equally good ones the lowest wins, so that fewer documents go. With one kind of rows only,
    nothing is parted: minus infinity.
    """
    place = F.floor((F.least(F.greatest(F.col("score"), F.lit(-2.0)), F.lit(1.999)) + 2) * (BINS / 4))
    counts = np.zeros((2, BINS), np.int64)
    rows = labelled.filter("score is not null").groupBy(place.cast("int").alias("bin"), "trusted")
    for at, trusted, n in rows.agg(F.count("*")).collect():
        counts[int(trusted), at] = n
    if not counts.sum(axis=1).all():
        return float("-inf")
    below = np.cumsum(counts, axis=1) - counts
    good, bad = counts.sum(axis=1)[1], counts.sum(axis=1)[0]
    right = (good - below[1]) / good + below[0] / bad
    return int(right.argmax()) * 4 / BINS - 2


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted: str = "quality = 1 and toxic = 0",
    untrusted: str = "quality = 0",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Judges every document by plain rules and by how much its n-grams look trusted.

    N-grams (words and runs of three bytes) are hashed to BUCKETS. Two multinomials are counted
    over whole texts: one of the documents that ``labels`` trusts, one of the whole corpus. The
    score is the mean of log p(trusted) / p(raw), so it doesn't grow with length. The threshold is
    the score that best parts all trusted from all untrusted labelled documents that pass the plain
    rules; scores are exact sums of whole numbers, so the verdict is the same in every run.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed, kept[, row]``, one row per input row.

    - Null, empty and blank texts have no words: base_failed, not kept, score null if no bytes.
    - Labels with null in any column count for neither side; a document labelled twice is trusted
      if any of its labels is. Labels without a document and documents without a label are fine.
    - Rows with equal or null ids are judged one by one. Empty tables give empty results, empty
      labels a score of about 0 for all and no threshold.

    Labelled ids are broadcast while few (see ``of_ids``), so texts aren't shuffled.
    """
    docs = keyed(docs, id_col, text_col, carry)
    known = (
        labels.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.when(F.expr(trusted), True).when(F.expr(untrusted), False).alias("trusted"),
        )
        .filter("doc_id is not null and trusted is not null")
        .groupBy("doc_id")
        .agg(F.max("trusted").alias("trusted"))
    )
    labelled = of_ids(docs, known, "left")
    table_of_weights = weights(gram_counts(labelled.select("text", "trusted")))
    judged = scored(labelled.filter("trusted is not null").select("doc_id", "text", "trusted"), table_of_weights)
    limit = threshold(judged.filter(~base_failed()))
    out = scored(docs, table_of_weights).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(limit), F.lit(False))
    return out.withColumn("kept", kept)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules(docs, labels)
