"""Symbolic ids: a command may name what an earlier command creates by that command's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import ORDER

#: What the creating operations make.
MAKES = {
    "create_scope": "scope",
    "create_label": "label",
    "create_record": "record",
    "supersede_record": "record",
    "merge_records": "record",
}
#: Id columns, the columns with keys that may stand for them, and what these name.
REFS = {
    "record_id": ("record_ref", "record"),
    "target_record_id": ("target_record_ref", "record"),
    "scope_id": ("scope_ref", "scope"),
    "label_id": ("label_ref", "label"),
}
LISTS = {"record_ids": ("record_refs", "record"), "label_ids": ("label_refs", "label")}
#: While a batch is judged, what a command makes has this id plus the command's arrival number.
#: No id that a caller writes down reaches it.
PROVISIONAL = 1 << 62

NAMES = T.StructType(
    [
        T.StructField("what", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.LongType()),
    ]
)


def provisional(rows: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """In place of ``allocate_ids``: ids that don't depend on which other commands succeed."""
    return rows.withColumn(name, F.lit(PROVISIONAL) + F.col("seq"))


def what_of(op: str = "op"):
    """What an operation makes; null for the others."""
    out = F.lit(None).cast("string")
    for name, what in MAKES.items():
        out = F.when(F.col(op) == name, F.lit(what)).otherwise(out)
    return out


def earlier_names(commands: DataFrame, write_keys: DataFrame) -> DataFrame:
    """Names that batches before this one left behind; no time means before every command."""
    asked = [F.array(r) for r, _ in REFS.values() if r in commands.columns]
    asked += [F.coalesce(r, F.array().cast("array<string>")) for r, _ in LISTS.values() if r in commands.columns]
    spark = commands.sparkSession
    if not asked:
        return spark.createDataFrame([], NAMES)
    keys = commands.select(F.explode(F.concat(*asked)).alias("ref")).filter("ref IS NOT NULL").distinct()
    made = write_keys.select(
        what_of("operation").alias("what"),
        F.col("key").alias("ref"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("bigint").alias("seq"),
        F.col("result_id").alias("id"),
    )
    return made.filter("what IS NOT NULL").join(keys, "ref", "left_semi").select(*NAMES.names)


def with_named(commands: DataFrame, names: DataFrame) -> DataFrame:
    """``commands`` with keys replaced by ids, and ``unnamed``: what a key should name, but doesn't.

    ``names`` has a row per key and kind of thing. A key names what was made before the command, in
    (ts, seq) order. A key in a column goes before an id beside it; lists are joined, ids first.
    """
    out = commands.withColumn("unnamed", F.lit(None).cast("string"))
    before = F.col("_at").isNull() | (F.col("_at") < F.struct(*ORDER))

    def known(what: str, ref: str) -> DataFrame:
        at = F.when(F.col("seq").isNotNull(), F.struct(*ORDER)).alias("_at")
        return names.filter(F.col("what") == what).select(F.col("ref").alias(ref), at, F.col("id").alias("_id"))

    def lack(what: str, ref: str):
        return F.format_string(f"no earlier command made a {what} under the key %s", F.col(ref))

    for id_col, (ref, what) in REFS.items():
        if ref not in commands.columns:
            continue
        out = out.join(known(what, ref), ref, "left").withColumn("_id", F.when(before, F.col("_id")))
        given = F.col(id_col) if id_col in commands.columns else F.lit(None).cast("bigint")
        out = out.withColumns(
            {
                id_col: F.when(F.col(ref).isNull(), given).otherwise(F.col("_id")),
                "unnamed": F.coalesce("unnamed", F.when(F.col(ref).isNotNull() & F.col("_id").isNull(), lack(what, ref))),
            }
        ).drop("_id", "_at")
    for id_col, (ref, what) in LISTS.items():
        if ref not in commands.columns:
            continue
        each = commands.select(*ORDER, F.posexplode(ref).alias("_place", ref))
        each = each.join(known(what, ref), ref, "left").withColumn("_id", F.when(before, F.col("_id")))
        found = each.groupBy("seq").agg(  # as many as the command lists
            F.transform(F.array_sort(F.collect_list(F.struct("_place", "_id"))), lambda x: x["_id"]).alias("_ids"),
            F.min(F.when(F.col("_id").isNull(), lack(what, ref))).alias("_lack"),
        )
        given = F.col(id_col) if id_col in commands.columns else F.lit(None).cast("array<bigint>")
        out = out.join(found, "seq", "left").withColumns(
            {
                id_col: F.when(F.col("_ids").isNull(), given).otherwise(
                    F.concat(F.coalesce(given, F.array().cast("array<bigint>")), F.col("_ids"))
                ),
                "unnamed": F.coalesce("unnamed", "_lack"),
            }
        ).drop("_ids", "_lack")
    return out
