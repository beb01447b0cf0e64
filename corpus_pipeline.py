"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the ``docs`` of the next. All stages but the last return the columns of
``documents``; a changed text also changes ``n_chars``. A text that has lost all its lines or words
stays as an empty one.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera
from tessera.llm import grades, lines, minhash, packing, substrings
from tessera.llm.store import saved

# Tasks carry the package's functions with them, so workers need not find it on their path.
cloudpickle.register_pickle_by_value(tessera)

#: SQL can't express the classifier, the sketches or the tokenizer.
ORACLE_SQL = None


def rest(docs: DataFrame) -> list[str]:
    """The columns that an operator carries along."""
    return [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]


def with_new_text(changed: DataFrame, like: DataFrame) -> DataFrame:
    """Documents whose text an operator changed, in the columns of the table they came from."""
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return changed.select(*[(values[c] if c in values else F.col("row")[c]).alias(c) for c in like.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are more likely below the best grade than of it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = grades.grade_documents(docs, labels, carry=docs.columns)
    return judged.filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that a document with a smaller id has."""
    return with_new_text(lines.drop_repeated_lines(docs, carry=rest(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that lie in a passage which occurs elsewhere."""
    return with_new_text(substrings.drop_repeated_runs(docs, carry=rest(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
