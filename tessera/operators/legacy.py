"""Import of older note tables: daily roll-up, defaults, records, links between notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.links import link_ids, redact, targets
from tessera.operators.ordering import allocate_ids
from tessera.schemas import PAYLOAD
from tessera.session import cut

# Separator, title, reasons and keys that imported rows carry.
SEPARATOR = "\n\n"
TITLE = "Imported legacy %s %d"
RECORD_KEY = "schema-v8:legacy-record"
EDGE_KEY = "schema-v8:legacy-reference"
REVISION_REASON = "legacy import"
LABEL_REASON = "legacy import fallback"
EDGE_REASON = "legacy note link"
DEFAULTS = {"visibility": "shared", "author": "user", "revision": 1}


def legacy_day_rollup(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(days, parts) from (id, day, created_at, updated_at, body) entries.

    A day's id and creation time are those of its first entry. Its body is the ordered ``parts``
    (day, position, entry_id, body): the non-empty bodies in (created_at, id) order, to be read
    with a blank line (``SEPARATOR``) between them. Parts stay rows, so a day has no size limit.
    """
    first = F.min(F.struct("created_at", "id"))
    days = entries.groupBy("day").agg(first.alias("first"), F.max("updated_at").alias("updated_at"))
    head = days.select(
        F.col("first.id").alias("id"),
        "day",
        F.col("first.created_at").alias("created_at"),
        "updated_at",
    )
    # numbered over all days, then counted from each day's first number: no day is one task's work
    bodies = entries.filter(F.octet_length("body") > 0).select(
        "day", "created_at", F.col("id").alias("entry_id"), "body"
    )
    numbered = allocate_ids(bodies, ["day", "created_at", "entry_id"], 0, "number")
    starts = cut(numbered.groupBy("day").agg(F.min("number").alias("start")))
    parts = numbered.join(starts, "day").select(
        "day", (F.col("number") - F.col("start")).alias("position"), "entry_id", "body"
    )
    return head, parts


def legacy_defaults(documents: DataFrame) -> DataFrame:
    """Columns that later versions added, with the values they give to older rows."""
    missing = {k: F.lit(v) for k, v in DEFAULTS.items() if k not in documents.columns}
    return documents.withColumns(missing) if missing else documents


def imported_title(kind: Column, id_: Column) -> Column:
    return F.format_string(TITLE, kind, id_)


def import_metadata() -> Column:
    """What the note was before its import, as JSON."""
    return F.to_json(
        F.struct(
            F.struct(
                "created_at", "updated_at", "author", "day", "kind", "visibility", "revision"
            ).alias("legacy")
        )
    )


def legacy_import(documents: DataFrame, scope_id: int, label_id: int) -> dict[str, DataFrame]:
    """Legacy documents as note records of the global scope; private ones are hidden.

    The result holds the rows for records, revisions, assertions, transitions and relations.
    Stored bodies stay as they were; links are redacted on reading.
    """
    key = F.concat_ws(":", F.lit(RECORD_KEY), "id")
    rows = documents.select("*", key.alias("key"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields[2:]]
    records = rows.select(
        "id",
        F.lit(scope_id).cast("bigint").alias("scope_id"),
        F.lit("note").alias("kind"),
        imported_title(F.col("kind"), F.col("id")).alias("title"),
        F.lit("active").alias("lifecycle"),
        F.lit(1).cast("bigint").alias("current_revision"),
        (F.col("visibility") == "shared").alias("readable"),
        import_metadata().alias("import_metadata"),
        F.col("key").alias("idempotency_key"),
    )
    revisions = rows.select(
        F.col("id").alias("record_id"),
        F.lit(1).cast("bigint").alias("revision"),
        imported_title(F.col("kind"), F.col("id")).alias("title"),
        F.struct(F.lit("note").alias("kind"), F.col("body"), *empty).alias("payload"),
        F.lit(REVISION_REASON).alias("reason"),
        F.concat("key", F.lit(":revision")).alias("idempotency_key"),
    )
    assertions = rows.select(
        F.col("id").alias("record_id"),
        F.lit(label_id).cast("bigint").alias("label_id"),
        F.lit(LABEL_REASON).alias("reason"),
        F.concat("key", F.lit(":label")).alias("idempotency_key"),
    )
    transitions = rows.select(
        F.col("id").alias("record_id"),
        F.lit(None).cast("string").alias("from_state"),
        F.lit("active").alias("to_state"),
        F.lit(REVISION_REASON).alias("reason"),
        F.concat("key", F.lit(":lifecycle")).alias("idempotency_key"),
    )
    return {
        "records": records,
        "revisions": revisions,
        "assertions": assertions,
        "transitions": transitions,
        "relations": legacy_relations(documents),
    }


def link_extract(documents: DataFrame) -> DataFrame:
    """(id, position, target_id) for every valid link in a body, in order."""
    return documents.select("id", F.posexplode(link_ids(F.col("body"))).alias("position", "target_id")).filter(
        "target_id IS NOT NULL"
    )


def legacy_relations(documents: DataFrame) -> DataFrame:
    """``references`` edges between notes that link to each other; no self links, no repeats."""
    links = documents.select(
        F.col("id").alias("source_record_id"),
        F.explode(targets(F.col("body"))).alias("target_record_id"),
    ).filter("source_record_id <> target_record_id")
    known = documents.select(F.col("id").alias("target_record_id"))
    return links.join(known, "target_record_id", "left_semi").select(
        "source_record_id",
        "target_record_id",
        F.lit("references").alias("kind"),
        F.lit(EDGE_REASON).alias("reason"),
        F.concat_ws(
            ":", F.lit(EDGE_KEY), "source_record_id", "target_record_id"
        ).alias("idempotency_key"),
    )


def link_redact(bodies: DataFrame, readable_ids: DataFrame) -> DataFrame:
    """(record_id, body) with links to hidden or unknown records removed.

    Only ids travel to find out what is readable. A record's visible targets are gathered
    again, and a body of at most a megabyte holds a bounded number of links.
    """
    linked = bodies.select("record_id", targets(F.col("body")).alias("targets")).filter(
        F.size("targets") > 0
    )
    visible = (
        linked.select("record_id", F.explode("targets").alias("target_id"))
        .join(readable_ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        .groupBy("record_id")
        .agg(F.collect_set("target_id").alias("visible"))
    )
    none = F.array().cast("array<bigint>")
    return bodies.join(visible, "record_id", "left").select(
        "record_id", redact(F.col("body"), F.coalesce("visible", none)).alias("body")
    )


def visible_revisions(
    records: DataFrame, revisions: DataFrame, ledger: DataFrame | None = None
) -> DataFrame:
    """``revisions`` as readers may see them: imported notes lose links to hidden records.

    Where ``records`` is only a part of them, ``ledger`` says what links may name.

    Only the ids that links name travel, and one row per linking revision comes back.
    """
    body = F.col("payload.body")
    imported = records.filter("import_metadata IS NOT NULL").select(F.col("id").alias("record_id"))
    linked = (
        revisions.join(imported, "record_id", "left_semi")
        .filter(body.contains("[[note:"))
        .select("record_id", "revision", targets(body).alias("targets"))
    )
    seen = (records if ledger is None else ledger).filter("readable").select(
        F.col("id").alias("target_id")
    )
    visible = (
        linked.select("record_id", "revision", F.explode_outer("targets").alias("target_id"))
        .join(seen.withColumn("seen", F.lit(True)), "target_id", "left")
        .groupBy("record_id", "revision")
        .agg(F.collect_set(F.when(F.col("seen"), F.col("target_id"))).alias("_visible"))
    )
    allowed = F.col("_visible")
    shown = F.when(allowed.isNull(), body).otherwise(redact(body, allowed))
    fields = [shown.alias(f) if f == "body" else F.col(f"payload.{f}") for f in PAYLOAD.names]
    return revisions.join(visible, ["record_id", "revision"], "left").select(
        *[
            F.when(F.col("payload").isNotNull(), F.struct(*fields)).alias("payload") if c == "payload" else F.col(c)
            for c in revisions.columns
        ]
    )


def days_with_two_dailies(documents: DataFrame) -> DataFrame:
    """Days that break the rule of one daily note per day."""
    return (
        documents.filter("kind = 'daily'").groupBy("day").agg(F.count("*").alias("n")).filter("n > 1")
    )

