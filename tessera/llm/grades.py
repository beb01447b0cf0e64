"""Quality classifier: cumulative-link regression of ordered grades on hashed text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, map_batches, of_ids, table, utf8

#: Buckets of hashed features.
BUCKETS = 1 << 20
#: The fit reads at most this many labelled documents, those with the smallest hash of their id,
#: and of each at most this many features, those with the smallest hash.
SAMPLE = 12_000
SAMPLE_FEATURES = 4096
#: The model takes the FEATURES buckets whose share of documents differs most between two grades,
#: if by MIN_Z standard errors and found in MIN_DOCS documents of the sample.
FEATURES, MIN_DOCS, MIN_Z = 300, 5, 4.0
#: … and no more than one feature for so many documents of the sample.
SAMPLE_PER_FEATURE = 20
#: Weight of the penalty on large weights.
DECAY = 3e-5
PREFIXES = (4, 5, 6, 7)
#: Documents are kept from this probability of the wanted grade on.
TAIL = 0.5

GRADE = "case when quality = 0 then 0 when toxic = 1 then 1 when quality = 1 and toxic = 0 then 2 end"

_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


class WordFeatures(dict):
    """Buckets of a word and its prefixes; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = [_bucket(word)] + [_bucket(b"^" + word[:k]) for k in PREFIXES if len(word) > k]
        return found


def features(text: bytes | None, words: WordFeatures) -> np.ndarray:
    """Distinct buckets of a text: its words, their prefixes, and how it is made up.

    Words are runs of letters and digits, A-Z lower-cased. The last features are the text's length,
    its share of symbols and its share of distinct words, each as one of a few steps.
    """
    low = (text or b"").lower()
    parts = low.translate(_LETTERS).split()
    distinct = set(parts)
    n = max(1, len(parts))
    symbols = sum(low.count(s) for s in (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS))))
    size, spread = n.bit_length(), int(9.99 * len(distinct) / n)
    made = (b"symbols %d" % min(9, 20 * symbols // n), b"spread %d" % spread, b"size %d" % size, b"%d of %d" % (spread, size))
    found = {_bucket(x) for x in made}
    for word in distinct:
        found.update(words[word])
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = sigmoid(thresholds[k] - sum of weights of a text's features)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        below = _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])
        edges = np.c_[np.zeros(len(below)), below, np.ones(len(below))]
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screened(rows: list[np.ndarray], grades: np.ndarray, k: int) -> np.ndarray:
    """Buckets whose share of documents differs most between two grades."""
    counts = np.zeros((k, BUCKETS), np.float64)
    for row, grade in zip(rows, grades, strict=True):
        counts[grade, row] += 1
    sizes = np.bincount(grades, minlength=k)
    most = np.zeros(BUCKETS)
    for a in range(k):
        for b in range(a):
            if not sizes[a] or not sizes[b]:
                continue
            both = counts[a] + counts[b]
            share = (both + 1) / (sizes[a] + sizes[b] + 2)
            error = np.sqrt(share * (1 - share) * (1 / sizes[a] + 1 / sizes[b]))
            gap = np.abs(counts[a] / sizes[a] - counts[b] / sizes[b])
            most = np.maximum(most, np.where(both >= MIN_DOCS, gap / error, 0))
    best = np.argsort(-most, kind="stable")[: min(FEATURES, len(rows) // SAMPLE_PER_FEATURE)]
    return np.sort(best[most[best] > MIN_Z])


def fit(rows: list[np.ndarray], grades: np.ndarray, decay: float = DECAY, steps: int = 50) -> Model:
    """Maximum likelihood with a penalty of decay / 2 * n * |weights|^2, by Newton's method.

    The likelihood of ordered thresholds under a logistic link is concave, so halved Newton steps
    reach its only maximum. Grades are 0 ... K-1. Without rows, or with one grade only, no feature
    has a weight and the thresholds give each grade its smoothed share.
    """
    k = max(2, int(grades.max()) + 1) if len(grades) else 2
    shares = np.cumsum(np.bincount(grades, minlength=k) + 1.0)[:-1] / (len(grades) + k)
    limits = np.log(shares / (1 - shares))
    weights = np.zeros(BUCKETS)
    ids = screened(rows, grades, k) if len(rows) else np.empty(0, np.int64)
    if not len(ids):
        return Model(weights, limits)
    n, size = len(rows), len(ids)
    new = np.full(BUCKETS, -1)
    new[ids] = np.arange(size)
    has = np.zeros((n, size), np.float32)
    for i, r in enumerate(rows):
        at = new[r]
        has[i, at[at >= 0]] = 1
    # the limits above and below a row's grade, as columns; the outermost are infinite
    above, below = np.eye(k + 1)[grades + 1][:, 1:k], np.eye(k + 1)[grades][:, 1:k]
    w = np.zeros(size)

    def at_limits(w: np.ndarray, limits: np.ndarray):
        score = has @ w
        edges = np.r_[-np.inf, limits, np.inf]
        high, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        high, low = np.where(grades == k - 1, 1.0, high), np.where(grades == 0, 0.0, low)
        likely = np.maximum(high - low, 1e-12)
        if k > 2 and (np.diff(limits) <= 0).any():
            return np.inf, high, low, likely
        return -np.log(likely).sum() + decay / 2 * n * (w @ w), high, low, likely

    loss, high, low, likely = at_limits(w, limits)
    for _ in range(steps):
        up, down = high * (1 - high) / likely, low * (1 - low) / likely
        slope = np.r_[-has.T @ (down - up) + decay * n * w, below.T @ down - above.T @ up]
        up_up, down_down = up * up - up * (1 - 2 * high), down * down + down * (1 - 2 * low)
        both = -up * down
        total = up_up + down_down + 2 * both
        by_limit = above * (up_up + both)[:, None] + below * (down_down + both)[:, None]
        curve = np.zeros((size + k - 1, size + k - 1))
        curve[:size, :size] = has.T @ (has * total[:, None].astype(np.float32)) + decay * n * np.eye(size)
        curve[:size, size:] = -has.T @ by_limit
        curve[size:, :size] = curve[:size, size:].T
        curve[size:, size:] = above.T @ (above * up_up[:, None]) + below.T @ (below * down_down[:, None])
        cross = above.T @ (below * both[:, None])
        curve[size:, size:] += cross + cross.T + 1e-9 * n * np.eye(k - 1)
        step = np.linalg.solve(curve, slope)
        for _ in range(30):
            tried = at_limits(w - step[:size], limits - step[size:])
            if tried[0] <= loss:
                break
            step /= 2
        else:
            break
        gain = loss - tried[0]
        w, limits = w - step[:size], limits - step[size:]
        loss, high, low, likely = tried
        if gain < 1e-7 * n:
            break
    weights[ids] = w
    return Model(weights, limits)


def train(docs: DataFrame, labels: DataFrame, grade: str = GRADE, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents (doc_id, text).

    ``sample`` bounds the labelled ids and, as a document may have several rows, the rows read.
    """
    graded = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(grade).cast("int").alias("grade"))
        .filter("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        for b in batches:
            packs = []
            for text in utf8(b.column("text")):
                row = features(text, words)
                if len(row) > SAMPLE_FEATURES:
                    row = np.sort(row[np.argsort(row * 0x9E3779B1 % (1 << 32), kind="stable")[:SAMPLE_FEATURES]])
                packs.append(row.astype("<i4").tobytes())
            yield pa.record_batch(
                [b.column("doc_id"), b.column("grade"), pa.array(packs, pa.binary())],
                names=["doc_id", "grade", "pack"],
            )

    joined = of_ids(docs.select("doc_id", "text"), chosen, "inner")
    got = (
        map_batches(joined, extract, "doc_id bigint, grade int, pack binary")
        .orderBy("doc_id", "pack")
        .limit(sample)
        .collect()
    )
    rows = [np.frombuffer(r["pack"], "<i4") for r in got]
    return fit(rows, np.array([r["grade"] for r in got], np.int64))


def grade_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade: str = GRADE,
    wanted: int = 2,
    tail: float = TAIL,
    sample: int = SAMPLE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Expected grade and probability of at least the wanted grade, for every document.

    Grades are ordered whole numbers from 0, by default 0 for low quality, 1 for toxic, 2 for
    good. One weight per hashed feature is shared by all grades; the thresholds between grades are
    ordered. The fit reads ``sample`` labelled documents at most; all whole texts are judged.

    Returns ``doc_id, expected_grade, tail_probability, kept[, row]``, one row per input row;
    kept means a tail probability of at least ``tail``.

    - Null and empty texts have no words; they are judged by length alone.
    - Labels with null that leave the grade open are ignored; of several labels of one document
      the lowest grade counts. Rows with equal or null ids are judged one by one.
    - No labels, or none of a known document: equal shares for two grades and, as the wanted grade
      was never seen, a tail probability of 0. An empty table gives an empty result.
    """
    docs = keyed(docs, id_col, text_col, carry)
    model = train(docs.filter("doc_id is not null"), labels, grade, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = Model(*shared.value), WordFeatures()
        for b in batches:
            texts = utf8(b.column("text"))
            score = np.array([model.weights[features(t, words)].sum() for t in texts], np.float64)
            p = model.probabilities(score)
            expected = p @ np.arange(p.shape[1])
            above = p[:, wanted:].sum(axis=1)
            columns = [b.column("doc_id"), pa.array(expected), pa.array(above)]
            if carry:
                columns.append(b.column("row"))
            names = ["doc_id", "expected_grade", "tail_probability", "row"]
            yield pa.record_batch(columns, names=names[: len(columns)])

    schema = "doc_id bigint, expected_grade double, tail_probability double"
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"
    out = map_batches(docs, judge, schema)
    return out.withColumn("kept", F.col("tail_probability") >= tail)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return grade_documents(docs, labels)
