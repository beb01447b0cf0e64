"""Ledger rows that applied commands add, built from the commands and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import utrim
from tessera.operators.commands import APPLIED, source_rows, who
from tessera.operators.ordering import ORDER, allocate_ids, previous_value, with_slices


def applied(commands: DataFrame, outcomes: DataFrame, *columns: str) -> DataFrame:
    """Commands that were applied, with columns of their outcome. Arrival numbers are unique."""
    won = outcomes.filter(F.col("outcome") == APPLIED).select("seq", *columns)
    return commands.join(won, "seq")


def _provenance(rows: DataFrame, key: Column | str = "key") -> list[Column]:
    return [
        F.col("ts").alias("created_at"),
        *who(rows),
        (F.col(key) if isinstance(key, str) else key).alias("idempotency_key"),
    ]


def new_revisions(commands: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revision rows, source rows) of applied revise commands with title, payload, sources."""
    rows = applied(commands, outcomes, "new_revision")
    revisions = rows.select(
        "record_id",
        F.col("new_revision").alias("revision"),
        utrim(F.col("title")).alias("title"),
        "payload",
        utrim(F.col("reason")).alias("reason"),
        *_provenance(rows),
    )
    return revisions, source_rows(rows, F.col("new_revision"))


def new_assertions(
    commands: DataFrame, outcomes: DataFrame, start_id: int, of_new: DataFrame | None = None
) -> DataFrame:
    """Label assertions of applied add_label commands, with ids in command order.

    ``of_new`` are those that come with new records (see ``commands.fan_out``, with seq), numbered in
    the same order, those of one command by label.
    """
    rows = applied(commands.filter("op = 'add_label'"), outcomes)
    rows = rows.select(
        "record_id", "label_id", utrim(F.col("reason")).alias("reason"), "key", *who(rows), *ORDER
    )
    if of_new is not None:
        rows = rows.unionByName(of_new.select(*rows.columns))
    return allocate_ids(rows, [*ORDER, "label_id"], start_id)


def new_label_retractions(
    commands: DataFrame,
    outcomes: DataFrame,
    made: DataFrame,
    in_force: DataFrame,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Retraction rows, each naming the assertion it ends.

    ``made`` are the assertions of the same batch, ``in_force`` the newest active assertion per
    (record, label) before it. Applied adds and retractions of a label alternate, so the
    assertion is the one before the retraction.
    """
    pair = ["record_id", "label_id"]
    ended = applied(commands.filter("op = 'retract_label'"), outcomes).select(
        *pair, *ORDER, F.lit(None).cast("bigint").alias("assertion_id")
    )
    events = with_slices(
        made.select(*pair, *ORDER, F.col("id").alias("assertion_id")).unionByName(ended),
        rows_per_slice,
    ).join(in_force.select(*pair, F.col("assertion_id").alias("standing")), pair, "left")
    paired = previous_value(events, pair, F.col("assertion_id"), "ends", F.col("standing"))
    named = paired.filter("assertion_id IS NULL").select("seq", F.col("ends").alias("assertion_id"))
    rows = commands.join(named, "seq")
    return rows.select("assertion_id", utrim(F.col("reason")).alias("reason"), *_provenance(rows))


def new_relations(
    commands: DataFrame, outcomes: DataFrame, start_id: int, of_endings: DataFrame | None = None
) -> DataFrame:
    """Edges of applied add_relation commands, with ids in command order.

    ``of_endings`` are those between replaced records and their replacements (with ts and seq),
    numbered in the same order, those of one command by their ends.
    """
    key = F.concat_ws(
        ":", "key", F.lit("relation"), "record_id", "target_record_id", "relation_kind"
    )
    rows = applied(commands, outcomes)
    rows = rows.select(
        F.col("record_id").alias("source_record_id"),
        "target_record_id",
        F.col("relation_kind").alias("kind"),
        utrim(F.col("reason")).alias("reason"),
        *_provenance(rows, key),
        "key",
        *ORDER,
    )
    if of_endings is not None:
        rows = rows.unionByName(of_endings.select(*rows.columns))
    return allocate_ids(rows, [*ORDER, "source_record_id", "target_record_id"], start_id)


def new_relation_retractions(commands: DataFrame, outcomes: DataFrame) -> DataFrame:
    rows = applied(commands, outcomes)
    return rows.select("relation_id", utrim(F.col("reason")).alias("reason"), *_provenance(rows))


def new_transitions(commands: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Transitions of applied transition commands."""
    rows = applied(commands, outcomes)
    return rows.select(
        "record_id",
        F.lit("active").alias("from_state"),
        F.lit("retracted").alias("to_state"),
        utrim(F.col("reason")).alias("reason"),
        *_provenance(rows, F.concat_ws(":", "key", F.lit("lifecycle"), "record_id")),
    )


def updated_records(
    records: DataFrame, revisions: DataFrame | None = None, transitions: DataFrame | None = None
) -> DataFrame:
    """Record rows after new revisions and transitions. Label and relation changes leave a
    record's own row as it is, and so does the transition that made it active."""
    rows = records
    if revisions is not None:
        newest = revisions.groupBy(F.col("record_id").alias("id")).agg(
            F.max(F.struct("revision", "title", "created_at")).alias("newest")
        )
        rows = rows.join(newest, "id", "left").withColumns(
            {
                "current_revision": F.coalesce("newest.revision", "current_revision"),
                "title": F.coalesce("newest.title", "title"),
                "updated_at": F.coalesce("newest.created_at", "updated_at"),
            }
        ).drop("newest")
    if transitions is not None:
        ended = transitions.filter("from_state IS NOT NULL").select(
            F.col("record_id").alias("id"), "to_state", F.col("created_at").alias("ended_at")
        )
        rows = rows.join(ended, "id", "left").withColumns(
            {
                "lifecycle": F.coalesce("to_state", "lifecycle"),
                "updated_at": F.greatest("updated_at", "ended_at"),
            }
        ).drop("to_state", "ended_at")
    return rows.select(*records.columns)
