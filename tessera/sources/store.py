"""Ledger tables as Parquet folders below one root.

Tables that hold a record at most once per model are bucketed by record id, so that they are
joined without a shuffle. Tables in which one record may have very many rows are not: a bucket
is read by one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import TABLES


# Tables with one row per record (and model), and their record id column.
BUCKET_KEYS = {"records": "id", "record_embeddings": "record_id"}
BUCKETS = 8


class LedgerStore:
    """Reads and writes the ledger tables with their fixed schemas.

    ``buckets`` should give bucket files of a few hundred megabytes; all bucketed tables of a
    ledger share the number.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root
        self.buckets = buckets

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def _name(self, folder: str) -> str:
        """Catalog name of a bucketed folder; different roots get different names."""
        return f"{folder}_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"

    def read(self, table: str) -> DataFrame:
        return self.read_as(table, table)

    def read_as(self, table: str, folder: str) -> DataFrame:
        """A folder that holds rows of ``table``."""
        if table not in BUCKET_KEYS:
            return self.spark.read.schema(TABLES[table]).parquet(self.path(folder))
        if not self.spark.catalog.tableExists(self._name(folder)):
            self._register(table, folder)
        return self.spark.table(self._name(folder))

    def _register(self, table: str, folder: str) -> None:
        """Tell the session's catalog how an already written folder is bucketed."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[table].fields)
        key = BUCKET_KEYS[table]
        self.spark.sql(
            f"CREATE TABLE {self._name(folder)} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path(folder)}'"
        )

    def write(
        self, table: str, rows: DataFrame, folder: str | None = None, mode: str = "overwrite"
    ) -> None:
        """Store rows in the layout of ``table``."""
        folder = folder or table
        shaped = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in TABLES[table].fields
            ]
        )
        if table not in BUCKET_KEYS:
            shaped.write.mode(mode).parquet(self.path(folder))
            return
        key = BUCKET_KEYS[table]
        (
            shaped.repartition(self.buckets, key)
            .write.mode(mode)
            .format("parquet")
            .bucketBy(self.buckets, key)
            .sortBy(key)
            .option("path", self.path(folder))
            .saveAsTable(self._name(folder))
        )
