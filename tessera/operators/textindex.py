"""Inverted index in Parquet: postings by term, document lengths, corpus statistics.

A posting row carries the document length and the scope, both fixed for a revision, so ranking
needs no join back to the documents and a scoped query reads only its scope's postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.payload import payload_encode, payload_text
from tessera.functions.text import tokens
from tessera.limits import BM25_IDF_FLOOR
from tessera.operators.legacy import visible_revisions

_INTS = T.ArrayType(T.IntegerType())
POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("scope_id", T.LongType()),
        T.StructField("tf", T.LongType()),
        T.StructField("dl", T.LongType()),
        T.StructField("title_pos", _INTS),
        T.StructField("body_pos", _INTS),
        T.StructField("bucket", T.IntegerType()),
    ]
)
DOC_STATS = T.StructType(
    [T.StructField("record_id", T.LongType()), T.StructField("dl", T.LongType())]
)
TERM_STATS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
_RUNS = (
    "record_id bigint, scope_id bigint, dl bigint, term string, tf bigint, title_pos array<int>, body_pos array<int>"
)
BUCKETS = 8
#: Bytes of words that a Python worker counts at once, and postings that it gives back at once.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1 << 16
#: Bytes of indexed text in one task. Its postings take about 15 times as much while they are sorted.
TEXT_PER_TASK = 16 << 20
# Above every position in a text.
BODY = 1 << 32


def index_text(payload: Column, index_source: str = "text") -> Column:
    """What is indexed beside the title: the text projection, or the raw JSON."""
    return payload_encode(payload) if index_source == "json" else payload_text(payload)


def cut_up(documents: DataFrame) -> DataFrame:
    """(record_id, revision, scope_id, title, body) -> (record_id, scope_id, copies): the words of title and
    body of all rows of a document.

    The grouping keys contain those of the join that found the current revisions, so texts are not shuffled
    again, and no token becomes a row.
    """
    copies = documents.groupBy("record_id", "revision", "scope_id").agg(
        F.collect_list(F.struct("title", "body")).alias("copies")
    )

    def cut(copy: Column) -> Column:
        return F.struct(tokens(copy["title"]).alias("title"), tokens(copy["body"]).alias("body"))

    return copies.select("record_id", "scope_id", F.transform("copies", cut).alias("copies"))


def counted(documents: DataFrame) -> DataFrame:
    """(record_id, revision, scope_id, title, body) -> (record_id, scope_id, dl, places): a document's
    (term, place) pairs. Copies of equal length are one document.

    Places in the title come first, those in the body from ``BODY`` on.
    """

    def length(copy: Column) -> Column:
        return (F.size(copy["title"]) + F.size(copy["body"])).cast("bigint")

    def placed(words: Column, start: int) -> Column:
        return F.transform(
            words, lambda t, i: F.struct(t.alias("term"), (i + F.lit(start).cast("bigint")).alias("place"))
        )

    def pairs(copy: Column) -> Column:
        return F.concat(placed(copy["title"], 0), placed(copy["body"], BODY))

    rows = cut_up(documents)
    rows = rows.withColumn("dl", F.explode(F.array_distinct(F.transform("copies", length))))
    same = F.filter("copies", lambda copy: length(copy) == F.col("dl"))
    return rows.select(
        "record_id", "scope_id", "dl", F.flatten(F.transform(same, pairs)).alias("places")
    )


def postings(documents: DataFrame) -> DataFrame:
    """(record_id, revision, scope_id, title, body) -> one row per (term, record).

    A document is counted in the task that tokenizes it and only finished postings are shuffled. Copies of
    equal length are one document; a copy without a title or a body has no postings.
    """
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = term_runs(batch)
            for start in range(0, rows.num_rows, BATCH_ROWS):
                yield rows.slice(start, BATCH_ROWS)

    return cut_up(documents).mapInArrow(runs, _RUNS)


def term_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of a batch of documents from :func:`cut_up`."""
    lists = batch.column("copies")
    copies = lists.flatten()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    sides = [pc.struct_field(copies, "title"), pc.struct_field(copies, "body")]
    sizes = [pc.fill_null(pc.list_value_length(s), -1).to_numpy(zero_copy_only=False).astype(np.int64) for s in sides]
    whole = (sizes[0] >= 0) & (sizes[1] >= 0)
    length = np.where(whole, sizes[0] + sizes[1], 0)
    most = length.max(initial=0) + 1
    found, group = np.unique(row * most + length, return_inverse=True)
    several = len(found) < len(row)

    words, of_copy, at = [], [], []
    for side, size in zip(sides, sizes, strict=True):
        n = np.maximum(size, 0)
        copy = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
        kept = whole[copy]
        words.append(side.flatten().filter(pa.array(kept)))
        of_copy.append(copy[kept])
        at.append(place[kept])
    coded = pa.concat_arrays(words).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms = max(len(coded.dictionary), 1)
    in_body = np.repeat([False, True], [len(a) for a in at])
    at = np.concatenate(at)
    key = group[np.concatenate(of_copy)] * n_terms + code
    # Title before body and by place they come already, unless copies are put together.
    order = np.lexsort((at, in_body, key)) if several else np.argsort(key, kind="stable")
    key, at, in_body = key[order], at[order].astype(np.int32), in_body[order]

    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(starts[1:], len(key))
    before = np.concatenate([[0], np.cumsum(in_body)])
    bodies = np.append(before[starts], before[-1])
    titles = np.append(starts, len(key)) - bodies
    doc, term = np.divmod(key[starts], n_terms)
    source = pa.array(found[doc] // most)
    columns = {
        "record_id": batch.column("record_id").take(source),
        "scope_id": batch.column("scope_id").take(source),
        "dl": pa.array(found[doc] % most),
        "term": coded.dictionary.take(pa.array(term)),
        "tf": pa.array(ends - starts),
        "title_pos": pa.ListArray.from_arrays(pa.array(titles, pa.int32()), pa.array(at[~in_body])),
        "body_pos": pa.ListArray.from_arrays(pa.array(bodies, pa.int32()), pa.array(at[in_body])),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def indexed_documents(
    records: DataFrame,
    revisions: DataFrame,
    index_source: str = "text",
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Title and text of the current revision of every readable record, links to hidden records
    redacted; ``ledger`` has all records if ``records`` has not."""
    current = records.filter("readable").select(
        F.col("id").alias("record_id"), "scope_id", F.col("current_revision").alias("revision")
    )
    if ledger is None:
        # All texts are read. Adaptive execution would merge the partitions of the joins by the size
        # of the texts, of which postings are a multiple; a number that is asked for stays.
        revisions = revisions.repartition(text_tasks(revisions), "record_id", "revision")
    shown = visible_revisions(records, revisions, ledger)
    return current.join(
        shown.select("record_id", "revision", "title", "payload"), ["record_id", "revision"]
    ).select(
        "record_id",
        "revision",
        "scope_id",
        "title",
        index_text(F.col("payload"), index_source).alias("body"),
    )


def doc_stats(documents: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """Length of every document, read off the postings; a document without tokens has 0."""
    lengths = posting_rows.groupBy("record_id").agg(F.max("dl").alias("dl"))
    return (
        documents.select("record_id")
        .join(lengths, "record_id", "left")
        .select("record_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    )


def term_stats(posting_rows: DataFrame) -> DataFrame:
    """Document frequency per term."""
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """Number of indexed documents and their mean length, one row."""
    return stats.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"),
    )


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_tasks(revisions: DataFrame) -> int:
    """Tasks that texts are dealt to: as many as a shuffle has, or more by the size of the texts."""
    sizes = F.octet_length(payload_text(F.col("payload"))).cast("bigint")
    total = revisions.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]
    return max(shuffle_partitions(revisions.sparkSession), -(-total // TEXT_PER_TASK))


def dealt(rows: DataFrame, folder: str, spread: int | None) -> DataFrame:
    """Rows with every value of ``folder`` spread over ``spread`` tasks by record: by default so many
    that the partitions of a shuffle get several pieces each, whatever the number of folders."""
    spread = spread or max(4, shuffle_partitions(rows.sparkSession) // 2)
    return rows.repartition(folder, F.pmod(F.xxhash64("record_id"), F.lit(spread)))


@dataclass(frozen=True)
class TextIndex:
    """A written index. ``n_docs`` and ``avgdl`` are its one-row corpus statistics."""

    spark: SparkSession
    root: str
    buckets: int
    n_docs: int
    avgdl: float

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings")

    def doc_stats(self) -> DataFrame:
        return self.spark.read.schema(DOC_STATS).parquet(f"{self.root}/doc_stats")

    def term_stats(self) -> DataFrame:
        return self.spark.read.schema(TERM_STATS).parquet(f"{self.root}/term_stats")

    def bucket(self, term: Column) -> Column:
        return bucket_of(term, self.buckets)

    def idf(self, df: Column) -> Column:
        n = F.lit(float(self.n_docs))
        return F.greatest(
            F.log((n - df + 0.5) / (df + 0.5)), F.lit(BM25_IDF_FLOOR)
        )


def write_index(
    documents: DataFrame, root: str, buckets: int = BUCKETS, spread: int | None = None
) -> TextIndex:
    """Tokenize documents and store the index below ``root``.

    Files are laid out by term bucket. Every bucket is spread over tasks by record, so the bucket that
    holds the most frequent term is not one task's work. Without ``spread`` a task writes the postings of
    its documents, a file per bucket; with it every bucket has that many pieces (``dealt``).
    """
    rows = postings(documents).withColumn("bucket", bucket_of(F.col("term"), buckets))
    return store_index(rows, documents.select("record_id"), root, buckets, spread)


def arranged(rows: DataFrame, spread: int | None) -> DataFrame:
    """Postings in the tasks that write them, in the order of the files."""
    rows = rows.select(*POSTINGS.names)
    if spread is not None:
        rows = dealt(rows, "bucket", spread)
    return rows.sortWithinPartitions("bucket", "term", "record_id")


def store_index(
    rows: DataFrame, documents: DataFrame, root: str, buckets: int, spread: int | None = None
) -> TextIndex:
    spark = rows.sparkSession
    arranged(rows, spread).write.partitionBy("bucket").parquet(f"{root}/postings")
    written = spark.read.schema(POSTINGS).parquet(f"{root}/postings")
    (
        term_stats(written)
        .withColumn("bucket", bucket_of(F.col("term"), buckets))
        .repartition("bucket")
        .write.partitionBy("bucket")
        .parquet(f"{root}/term_stats")
    )
    doc_stats(documents, written).write.parquet(f"{root}/doc_stats")
    return open_index(spark, root, buckets)


def open_index(spark: SparkSession, root: str, buckets: int = BUCKETS) -> TextIndex:
    row = corpus_stats(spark.read.schema(DOC_STATS).parquet(f"{root}/doc_stats")).first()
    return TextIndex(spark, root, buckets, row["n_docs"], row["avgdl"])


def refreshed(index: TextIndex, changed: DataFrame) -> DataFrame:
    """Postings with the rows of the ``changed`` documents replaced."""
    fresh = postings(changed).withColumn("bucket", index.bucket(F.col("term")))
    kept = index.postings().join(changed.select("record_id"), "record_id", "left_anti")
    return kept.select(*POSTINGS.names).unionByName(fresh.select(*POSTINGS.names))


def refresh_index(index: TextIndex, changed: DataFrame, root: str) -> TextIndex:
    """A new index generation below ``root``; the old one stays readable meanwhile."""
    ids = index.doc_stats().select("record_id").union(changed.select("record_id")).distinct()
    return store_index(refreshed(index, changed), ids, root, index.buckets)
