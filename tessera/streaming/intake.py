"""Streams: commands checked against the key ledger, vectors kept up with revisions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.batch import apply_batch, batch_rows
from tessera.operators.commands import APPLIED, idempotent_intake
from tessera.operators.dense import embedding_sync
from tessera.operators.ledger_rows import updated_records
from tessera.operators.segments import BROADCAST_IDS
from tessera.session import cut

KEYS = "key string, operation string, request_hash string, result_id bigint, batch bigint"


class CommandIntake:
    """Sink of a command stream.

    Each micro-batch is judged against the keys of earlier batches and writes its outcomes and
    new keys into folders named after the batch. A batch that is run again after a failure
    overwrites exactly its own folders, so the result is the same as without the failure; no
    watermark or state store is needed.

    ``prepare`` shapes a batch into commands. ``apply`` gets the commands whose keys are new and
    the batch number, and returns their outcomes (seq, outcome, reason); what it writes itself
    must be named after the batch too. A command it refuses leaves its key free.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        prior_keys: DataFrame,
        prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
        apply: Callable[[DataFrame, int], DataFrame] | None = None,
    ):
        self.spark, self.root, self.prepare, self.apply = spark, root, prepare, apply
        # Kept from the first start on: a restart must not find its own keys among the prior ones.
        (
            prior_keys.select("key", "operation", "request_hash", "result_id")
            .write.mode("ignore")
            .parquet(f"{root}/keys/batch=-1")
        )

    def keys(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(KEYS).option("basePath", f"{self.root}/keys").parquet(
            f"{self.root}/keys"
        )
        return rows if before is None else rows.filter(F.col("batch") < before)

    def outcomes(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/outcomes").parquet(
            f"{self.root}/outcomes"
        )

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        judged = idempotent_intake(self.prepare(batch), self.keys(before=batch_id))
        if self.apply is not None:
            judged = cut(judged)
            verdicts = self.apply(
                judged.filter(F.col("outcome") == APPLIED).drop("outcome", "reason"), batch_id
            ).select("seq", F.col("outcome").alias("verdict"), F.col("reason").alias("refusal"))
            judged = judged.join(verdicts, "seq", "left").withColumns(
                {
                    "outcome": F.coalesce("verdict", "outcome"),
                    "reason": F.coalesce("refusal", "reason"),
                }
            )
        place = f"{self.root}/outcomes/batch={batch_id}"
        result = F.col("record_id") if "record_id" in judged.columns else F.lit(None)
        judged.select(
            "key",
            "op",
            "ts",
            "seq",
            "request_hash",
            "outcome",
            "reason",
            result.cast("bigint").alias("result_id"),
        ).write.mode("overwrite").parquet(place)
        written = self.spark.read.parquet(place)
        written.filter(F.col("outcome") == APPLIED).select(
            "key",
            F.col("op").alias("operation"),
            "request_hash",
            "result_id",
        ).write.mode("overwrite").parquet(f"{self.root}/keys/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class LedgerIntake:
    """Sink of a command stream that applies whole micro-batches of mixed operations to a ledger.

    ``base`` gives the tables before the stream by name. Every batch is judged against them and the
    rows of the batches before it, and writes its outcomes and rows into folders named after the
    batch; a batch that is run again overwrites exactly its own. Where a stream is cut into batches
    doesn't change any outcome. ``prepare`` shapes a batch into commands with the arguments that
    ``tessera.operators.batch`` expects, payloads and sources of revise commands included.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        base: Callable[[str], DataFrame],
        prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    ):
        self.spark, self.root, self.base, self.prepare = spark, root, base, prepare
        self.changed = [
            "record_revisions", "source_references", "label_assertions", "label_retractions",
            "record_relations", "relation_retractions", "lifecycle_transitions", "write_keys",
            "scopes", "labels", "label_aliases", "records",
        ]

    def _added(self, table: str, before: int | None) -> DataFrame | None:
        """Rows of earlier batches; None before the first."""
        if before == 0:
            return None
        folder = f"{self.root}/rows/{table}"
        schema = T.StructType([*self.base(table).schema.fields, T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table of the ledger after all batches, or after those before ``before``."""
        if name == "records":
            more = [self._added(t, before) for t in ("records", "record_revisions", "lifecycle_transitions")]
            return self.base(name) if more[0] is None else updated_records(self.base(name).unionByName(more[0]), *more[1:])
        if name not in self.changed:
            return self.base(name)
        added = self._added(name, before)
        return self.base(name) if added is None else self.base(name).unionByName(added)

    def outcomes(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/outcomes").parquet(
            f"{self.root}/outcomes"
        )

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        def tables(name: str) -> DataFrame:
            return self.table(name, batch_id)

        commands = cut(self.prepare(batch))
        place = f"{self.root}/outcomes/batch={batch_id}"
        apply_batch(commands, tables).write.mode("overwrite").parquet(place)
        rows = batch_rows(commands, self.spark.read.parquet(place), tables)
        rows["records"] = rows.get("new_records")
        for name in self.changed:
            shape = self.base(name).schema
            new = rows.get(name)
            new = self.spark.createDataFrame([], shape) if new is None else new
            shaped = [
                (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in shape.fields
            ]
            new.select(*shaped).write.mode("overwrite").parquet(
                f"{self.root}/rows/{name}/batch={batch_id}"
            )

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class VectorSync:
    """Sink of a revision stream: embeds what the batch left pending.

    ``tables`` returns the current (records, revisions) DataFrames. Every batch writes a new
    generation of the vector table; a repeated batch overwrites its own generation.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tables: Callable[[], tuple[DataFrame, DataFrame]],
        embed: Callable[[pd.Series], pd.Series],
        model: str,
        model_revision: str,
        dimensions: int,
        initial: DataFrame,
    ):
        self.spark, self.root, self.tables, self.embed = spark, root, tables, embed
        self.model = (model, model_revision, dimensions)
        initial.write.mode("overwrite").parquet(f"{root}/vectors/batch=-1")

    def vectors(self, up_to: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Newest vector per record and model, of all batches or those up to ``up_to``, of all
        records or those in ``of``."""
        rows = self.spark.read.option("basePath", f"{self.root}/vectors").parquet(
            f"{self.root}/vectors"
        )
        columns = [c for c in rows.columns if c != "batch"]
        if up_to is not None:
            rows = rows.filter(F.col("batch") <= up_to)
        if of is not None:
            rows = rows.join(of, "record_id", "left_semi")
        return (
            rows.groupBy("record_id", "model", "model_revision")
            .agg(F.max_by(F.struct(*columns), "batch").alias("newest"))
            .select("newest.*")
        )

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        records, revisions = self.tables()
        touched = cut(batch.select("record_id").distinct())
        if touched.count() <= BROADCAST_IDS:
            # A batch does not shuffle the texts and vectors of all others.
            touched = F.broadcast(touched)
        # Only records of this batch can have become pending.
        changed = records.join(touched.withColumnRenamed("record_id", "id"), "id", "left_semi")
        revisions = revisions.join(touched, "record_id", "left_semi")
        known = self.vectors(batch_id - 1, touched)
        _, outcome = embedding_sync(
            changed, revisions, known, self.embed, *self.model, ledger=records
        )
        outcome.filter("outcome = 'applied'").drop("outcome", "current_revision").write.mode(
            "overwrite"
        ).parquet(f"{self.root}/vectors/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
