"""A text index in segments: a refresh writes what changed, reading merges, compaction folds.

A segment holds the postings and lengths of the documents it indexed, the change that it makes to
document frequencies, and the ids it speaks for. A row of a segment counts as long as no later
segment speaks for its record. The manifest row of a generation names its segments and is written
last, so a refresh that was broken off changes nothing and may be run again. One writer at a time;
readers keep the generation they opened until ``sweep`` deletes what it had.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.textindex import (
    BUCKETS,
    POSTINGS,
    TERM_STATS,
    TextIndex,
    bucket_of,
    counted,
    dealt,
    postings,
    term_stats,
)

DOCUMENTS = "record_id bigint, dl bigint, terms array<string>, part int"
IDS = "record_id bigint, fresh boolean"
MANIFEST = (
    "segments array<string>, sizes array<bigint>, buckets int, n_docs bigint, total_dl bigint, "
    "generation int"
)
# Ids of later segments up to this number go to every task; beyond it, reading shuffles on the id.
BROADCAST_IDS = 1_000_000
# ``tidy`` folds more segments than this, and all of them once a quarter of the documents changed.
MOST_SEGMENTS = 8
CHANGED_SHARE = 0.25


def part_of(record_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class SegmentedIndex(TextIndex):
    """One generation of an index in segments, oldest first; searched like any ``TextIndex``.

    ``sizes`` are the numbers of ids that the segments speak for.
    """

    segments: tuple[str, ...]
    sizes: tuple[int, ...]
    total_dl: int
    generation: int

    def table(self, name: str, schema: str | T.StructType, first: int = 0) -> DataFrame:
        """Rows of a table in all segments from ``first`` on, with the segment's position."""
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}").withColumn("position", F.lit(i))
            for i, segment in enumerate(self.segments[first:])
        ]
        return reduce(DataFrame.unionByName, parts)

    def ids(self, first: int = 0) -> DataFrame:
        """Per record the last segment from ``first`` on that speaks for it, and whether it indexed it."""
        return (
            self.table("ids", IDS, first)
            .groupBy("record_id")
            .agg(F.max(F.struct("position", "fresh")).alias("last"))
            .select("record_id", "last.position", "last.fresh")
        )

    def live(self, name: str, schema: str | T.StructType, first: int = 0) -> DataFrame:
        """Rows of a table whose record no later segment speaks for."""
        rows = self.table(name, schema, first)
        if len(self.segments) - first < 2:
            return rows.drop("position")
        # What the oldest segment speaks for voids nothing here.
        later = self.ids(first + 1).select(
            F.col("record_id").alias("later_id"), (F.col("position") + 1).alias("later_position")
        )
        if sum(self.sizes[first + 1 :]) <= BROADCAST_IDS:
            later = F.broadcast(later)
        void = (F.col("record_id") == F.col("later_id")) & (F.col("position") < F.col("later_position"))
        return rows.join(later, void, "left_anti").drop("position")

    def documents(self) -> DataFrame:
        """(record_id, dl, terms, part) of every indexed document; terms are distinct."""
        return self.live("documents", DOCUMENTS)

    def postings(self) -> DataFrame:
        return self.live("postings", POSTINGS).select(*POSTINGS.names)

    def doc_stats(self) -> DataFrame:
        return self.documents().select("record_id", "dl")

    def term_changes(self, first: int = 0) -> DataFrame:
        """Document frequencies that the segments from ``first`` on add up to; none is 0."""
        rows = self.table("terms", TERM_STATS, first)
        if len(self.segments) - first < 2:
            return rows.select(*TERM_STATS.names)
        return (
            rows.groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df <> 0").select(*TERM_STATS.names)
        )

    def term_stats(self) -> DataFrame:
        return self.term_changes()


def _store_postings(rows: DataFrame, folder: str, spread: int | None) -> None:
    (
        dealt(rows.select(*POSTINGS.names), "bucket", spread)
        .sortWithinPartitions("bucket", "term", "record_id")
        .write.partitionBy("bucket")
        .parquet(f"{folder}/postings")
    )


def _store_documents(rows: DataFrame, folder: str) -> None:
    """``rows`` come dealt out by part and record."""
    (
        rows.select("record_id", "dl", "terms", "part")
        .sortWithinPartitions("part", "record_id")
        .write.partitionBy("part")
        .parquet(f"{folder}/documents")
    )


def _store_terms(rows: DataFrame, folder: str, buckets: int) -> None:
    (
        rows.withColumn("bucket", bucket_of(F.col("term"), buckets))
        .repartition("bucket")
        .write.partitionBy("bucket")
        .parquet(f"{folder}/terms")
    )


def _publish(
    spark: SparkSession, root: str, segments: tuple[str, ...], sizes: tuple[int, ...], buckets: int,
    n_docs: int, total_dl: int, generation: int,
) -> SegmentedIndex:
    """Writes a generation's manifest row, which makes its segments the index."""
    row = [(list(segments), list(sizes), buckets, n_docs, total_dl, generation)]
    (
        spark.createDataFrame(row, MANIFEST)
        .drop("generation")
        .coalesce(1)
        .write.mode("overwrite")
        .parquet(f"{root}/manifest/generation={generation}")
    )
    return open_segments(spark, root)


def open_segments(spark: SparkSession, root: str) -> SegmentedIndex:
    """The last published generation below ``root``."""
    row = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("generation")).first()
    avgdl = row["total_dl"] / row["n_docs"] if row["n_docs"] else 0.0
    return SegmentedIndex(
        spark, root, row["buckets"], row["n_docs"], avgdl,
        tuple(row["segments"]), tuple(row["sizes"]), row["total_dl"], row["generation"],
    )


def write_segments(documents: DataFrame, root: str, buckets: int = BUCKETS, spread: int | None = None) -> SegmentedIndex:
    """A new index below ``root``: its first segment holds all ``documents``, one row per record."""
    empty = SegmentedIndex(documents.sparkSession, root, buckets, 0, 0.0, (), (), 0, 0)
    return refresh_segments(empty, documents, spread=spread)


def refresh_segments(
    index: SegmentedIndex, changed: DataFrame, removed: DataFrame | None = None, spread: int | None = None
) -> SegmentedIndex:
    """A generation with one more segment: ``changed`` documents replaced or added, ``removed``
    (record_id) gone.

    ``changed`` has one row per record; a record in both is indexed. Ids the index does not have may
    be removed. Bytes written grow with the change only; of the older segments the lists of terms
    in the parts of the changed records are read.
    """
    spark, name = index.spark, f"segment-{uuid.uuid4().hex}"
    folder = f"{index.root}/{name}"
    named = changed.select("record_id", F.lit(True).alias("fresh"))
    if removed is not None:
        named = named.unionByName(removed.select("record_id", F.lit(False).alias("fresh")))
    named.groupBy("record_id").agg(F.max("fresh").alias("fresh")).write.parquet(f"{folder}/ids")
    ids = spark.read.schema(IDS).parquet(f"{folder}/ids")

    rows = postings(changed).withColumn("bucket", index.bucket(F.col("term")))
    _store_postings(rows, folder, spread)
    written = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")

    # Lengths and terms come from the documents again: gathering them from postings would sort these.
    lengths = counted(changed).select(
        "record_id",
        F.coalesce("dl", F.lit(0).cast("bigint")).alias("dl"),
        F.array_distinct("places.term").alias("terms"),
        part_of(F.col("record_id"), index.buckets).alias("part"),
    )
    fresh = lengths.groupBy("part", "record_id").agg(
        F.max("dl").alias("dl"), F.flatten(F.collect_list("terms")).alias("terms")
    )
    _store_documents(fresh, folder)

    totals = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")]
    added = spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents").agg(*totals).first()
    n_docs, total_dl, terms = added["n"], added["dl"], term_stats(written)
    if index.segments:
        # At most as many numbers as the index has parts.
        touched = [
            r[0] for r in ids.select(part_of(F.col("record_id"), index.buckets)).distinct().collect()
        ]
        old = index.documents().filter(F.col("part").isin(touched)).join(ids, "record_id", "left_semi")
        gone = old.agg(*totals).first()
        n_docs += index.n_docs - gone["n"]
        total_dl += index.total_dl - gone["dl"]
        withdrawn = old.select(F.explode("terms").alias("term")).groupBy("term")
        terms = (
            terms.unionByName(withdrawn.agg((-F.count("*")).alias("df")))
            .groupBy("term")
            .agg(F.sum("df").alias("df"))
            .filter("df <> 0")
        )
    _store_terms(terms, folder, index.buckets)
    return _publish(
        spark, index.root, (*index.segments, name), (*index.sizes, ids.count()), index.buckets,
        n_docs, total_dl, index.generation + 1,
    )


def compact(index: SegmentedIndex, first: int = 0, spread: int | None = None) -> SegmentedIndex:
    """A generation that has one segment in place of those from position ``first`` on.

    Answers stay the same. From 0 on nothing void is left; else the older segments are not touched,
    and the new segment still speaks for the ids of those it replaces.
    """
    if len(index.segments) - first < 2:
        return index
    spark, name = index.spark, f"segment-{uuid.uuid4().hex}"
    folder = f"{index.root}/{name}"
    _store_postings(index.live("postings", POSTINGS, first), folder, spread)
    documents = index.live("documents", DOCUMENTS, first).select("record_id", "dl", "terms", "part")
    _store_documents(documents.repartition("part", "record_id"), folder)
    _store_terms(index.term_changes(first).select("term", "df"), folder, index.buckets)
    ids = index.ids(first).select("record_id", "fresh")
    (ids if first else ids.filter("fresh")).write.parquet(f"{folder}/ids")
    size = spark.read.schema(IDS).parquet(f"{folder}/ids").count()
    return _publish(
        spark, index.root, (*index.segments[:first], name), (*index.sizes[:first], size), index.buckets,
        index.n_docs, index.total_dl, index.generation + 1,
    )


def tidy(index: SegmentedIndex) -> SegmentedIndex:
    """Compacts where that is due: all segments once many documents changed, else the later ones
    once there are many, so that the large first segment is rarely written again."""
    if sum(index.sizes[1:]) > CHANGED_SHARE * max(index.n_docs, 1):
        return compact(index)
    return compact(index, 1) if len(index.segments) > MOST_SEGMENTS else index


def sweep(index: SegmentedIndex) -> list[str]:
    """Deletes the segments below the root that ``index``, the last generation, does not name:
    those of earlier generations and of refreshes broken off. Returns their names."""
    jvm, conf = index.spark._jvm, index.spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(index.root)
    files = root.getFileSystem(conf)
    names = [status.getPath().getName() for status in files.listStatus(root)]
    unnamed = [n for n in names if n.startswith("segment-") and n not in index.segments]
    for name in unnamed:
        files.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)
    return unnamed
