"""Commands as data: guards, idempotency, and application of whole batches to the ledger.

Every function takes a DataFrame of commands with ``key``, ``ts``, ``seq`` (a unique arrival
number) and the arguments of the operation, and returns one outcome per command:
``applied``, ``replayed``, ``conflict`` or ``invalid`` with a reason. Commands of a batch take
effect in (ts, seq) order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.text import trim_option, utrim
from tessera.limits import DIRECT_RELATIONS
from tessera.operators import quality, views
from tessera.operators.ordering import (
    ORDER,
    allocate_ids,
    following_value,
    latest_value,
    previous_value,
    reachable,
    resolve_claims,
    running_sum,
    with_slices,
)
from tessera.schemas import SOURCE
from tessera.session import cut

# Wording of conflicts and reasons.
KEY_REUSED = "idempotency key was already used for a different write"
LABEL_ACTIVE = "label is already active on record"
LABEL_INACTIVE = "label is not active on record"
LAST_LABEL = "a record must retain at least one active label"
RELATION_ACTIVE = "relation is already active"
RELATION_RETRACTED = "relation is already retracted"
SELF_RELATION = "a relation cannot target its source"
NOT_ACTIVE = "only an active record can transition"
NOT_SUPERSEDABLE = "only an active record can be superseded"
NOT_MERGEABLE = "only active records can be merged"
MERGE_TOO_FEW = "merge requires at least two records"
ALIAS_TAKEN = "label alias %s belongs to another label"
OTHER_LIFECYCLE = "use supersede_record or merge_records for that lifecycle"
CREATED = "record created"
REVISION_CONFLICT = "revision conflict: expected %d, current %d"
KIND_CHANGED = "record kind cannot change during revision"

APPLIED, REPLAYED, CONFLICT, INVALID = "applied", "replayed", "conflict", "invalid"


# A batch of at most this many commands is sent to the scans of the ledger tables, so that a
# small batch does not shuffle a large ledger. Ids are 8 bytes, keys at most 200.
SMALL_BATCH = 200_000


def narrowed(table: DataFrame, column: str, commands: DataFrame, key: str) -> DataFrame:
    """Rows of a ledger table that the commands name; the whole table for a large batch."""
    # Counted where the rows are: a limit would send them all to one task.
    if commands.select(key).count() > SMALL_BATCH:
        return table
    named = commands.select(F.col(key).alias(column)).distinct()
    return table.join(F.broadcast(named), column, "left_semi")


def request_hash(request: Column) -> Column:
    return F.sha2(request.cast("binary"), 256)


def idempotent_intake(commands: DataFrame, write_keys: DataFrame) -> DataFrame:
    """First use of a key applies; the same request again replays; another one conflicts.

    Per key only its first command is kept (combined before the shuffle); commands are then
    joined to that one row per key.
    """
    hashed = commands.withColumn("request_hash", request_hash(F.col("request")))
    first = hashed.groupBy("key").agg(
        F.min(F.struct(*ORDER, "op", "request_hash")).alias("first")
    )
    stored = narrowed(write_keys, "key", commands, "key").select(
        "key", F.struct(F.col("operation").alias("op"), "request_hash").alias("stored")
    )
    owners = first.join(stored, "key", "left").select(
        "key",
        F.col("stored").isNotNull().alias("known"),
        F.col("first.seq").alias("first_seq"),
        F.coalesce("stored.op", "first.op").alias("owner_op"),
        F.coalesce("stored.request_hash", "first.request_hash").alias("owner_hash"),
    )
    same = (F.col("op") == F.col("owner_op")) & (F.col("request_hash") == F.col("owner_hash"))
    outcome = (
        F.when(~F.col("known") & (F.col("seq") == F.col("first_seq")), APPLIED)
        .when(same, REPLAYED)
        .otherwise(CONFLICT)
    )
    return (
        hashed.join(owners, "key")
        .withColumn("outcome", outcome)
        .withColumn("reason", F.when(outcome == CONFLICT, KEY_REUSED))
        .drop("known", "first_seq", "owner_op", "owner_hash")
    )


def new_write_keys(intake: DataFrame, result: DataFrame) -> DataFrame:
    """Key ledger rows of the applied commands; ``result`` is (key, result_id)."""
    return (
        intake.filter(F.col("outcome") == APPLIED)
        .join(result, "key")
        .select("key", F.col("op").alias("operation"), "request_hash", "result_id")
    )


def derived_keys(key: Column, record_id: Column, label_id: Column, source: Column, target: Column,
                 kind: Column) -> dict[str, Column]:
    """Keys of the rows that one command writes."""
    return {
        "label_key": F.concat_ws(":", key, F.lit("label"), label_id),
        "created_key": F.concat_ws(":", key, F.lit("lifecycle")),
        "lifecycle_key": F.concat_ws(":", key, F.lit("lifecycle"), record_id),
        "relation_key": F.concat_ws(":", key, F.lit("relation"), source, target, kind),
    }


def command_guards(
    commands: DataFrame, records: DataFrame, labels: DataFrame, relations: DataFrame
) -> DataFrame:
    """Look up what a command names and say what is missing (column ``guard``, null when all
    is there). Hidden and unknown records give the same message."""
    open_records = records.filter("readable")
    seen = narrowed(open_records, "id", commands, "record_id").select(
        F.col("id").alias("record_id"),
        F.col("kind").alias("record_kind"),
        "lifecycle",
        "current_revision",
    )
    target = narrowed(open_records, "id", commands, "target_record_id").select(
        F.col("id").alias("target_record_id"), F.lit(True).alias("target_seen")
    )
    known_labels = labels.filter("active").select(
        F.col("id").alias("label_id"), F.lit(True).alias("label_seen")
    )
    named = narrowed(relations, "id", commands, "relation_id")
    ends = views.visible_edges(records, named).select(
        F.col("id").alias("relation_id"), F.lit(True).alias("relation_seen")
    )
    uses_record = F.col("op") != "retract_relation"
    guard = (
        F.when(
            uses_record & F.col("record_kind").isNull(),
            F.format_string("record %d does not exist", "record_id"),
        )
        .when(
            (F.col("op") == "add_label") & F.col("label_seen").isNull(),
            F.format_string("label %d does not exist", "label_id"),
        )
        .when(
            (F.col("op") == "add_relation") & F.col("target_seen").isNull(),
            F.format_string("record %d does not exist", "target_record_id"),
        )
        .when(
            (F.col("op") == "retract_relation") & F.col("relation_seen").isNull(),
            F.format_string("relation %d does not exist", "relation_id"),
        )
    )
    return (
        commands.join(seen, "record_id", "left")
        .join(known_labels, "label_id", "left")
        .join(target, "target_record_id", "left")
        .join(ends, "relation_id", "left")
        .withColumn("guard", guard)
        .drop("label_seen", "target_seen", "relation_seen")
    )


def _readable(commands: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Commands with columns of their record; ``seen`` is null for a hidden or unknown one."""
    state = narrowed(records.filter("readable"), "id", commands, "record_id").select(
        F.col("id").alias("record_id"), F.lit(True).alias("seen"), *columns
    )
    return commands.join(state, "record_id", "left")


def _missing(column: str = "record_id") -> Column:
    return F.format_string("record %d does not exist", column)


def first_per(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``seq`` of the first command per key, combined before the shuffle."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*ORDER)).alias("first"))
        .select(*keys, F.col("first.seq").alias("first_seq"))
    )


def apply_create_scope(
    commands: DataFrame, scopes: DataFrame, ids: Callable[..., DataFrame] = allocate_ids
) -> tuple[DataFrame, DataFrame]:
    """(new scopes, outcomes). Names are unique whatever their case; an existing name gives
    the existing scope. ``ids`` numbers the new ones."""
    error = quality.single_line("scope name", F.col("name"), 200)
    judged = commands.withColumns(
        {"error": error, "name": quality.scope_name(F.col("name"))}
    ).withColumn("name_key", F.lower("name"))
    known = scopes.select(F.lower("name").alias("name_key"), F.col("id").alias("known_id"))
    good = judged.filter("error IS NULL")
    fresh = good.join(known, "name_key", "left_anti")
    firsts = fresh.groupBy("name_key").agg(
        F.min(F.struct(*ORDER, "name", "key")).alias("first")
    )
    start = scopes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = ids(firsts.select("name_key", "first.*"), ORDER, start)
    named = known.unionByName(created.select("name_key", F.col("id").alias("known_id")))
    outcomes = (
        judged.join(named, "name_key", "left")
        .join(created.select("seq", F.lit(True).alias("created")), "seq", "left")
        .select(
            "key",
            "seq",
            F.when(F.col("error").isNull(), APPLIED).otherwise(INVALID).alias("outcome"),
            F.col("error").alias("reason"),
            F.when(F.col("error").isNull(), F.col("known_id")).alias("result_id"),
            F.coalesce("created", F.lit(False)).alias("created"),
        )
    )
    return created.select("id", "name", F.col("ts").alias("created_at"), "key"), outcomes


def alias_refusals(refused: DataFrame, held: DataFrame, won: DataFrame) -> DataFrame:
    """(seq, reason): the first alias of a refused command that another label has by then."""
    granted = won.select(F.explode("aliases").alias("resource"), "owner", F.struct(*ORDER).alias("at"))
    owners = held.select("resource", "owner", F.lit(None).cast(granted.schema["at"].dataType).alias("at")).unionByName(
        granted.groupBy("resource").agg(F.min_by("owner", "at").alias("owner"), F.min("at").alias("at"))
    )
    asked = refused.select(
        *ORDER, F.col("owner").alias("own"), F.posexplode("aliases").alias("place", "resource")
    )
    taken = asked.join(owners, "resource").filter(
        (F.col("own") != F.col("owner")) & (F.col("at").isNull() | (F.col("at") < F.struct(*ORDER)))
    )
    first = taken.groupBy("seq").agg(F.min_by("resource", "place").alias("alias"))
    return first.select("seq", F.format_string(ALIAS_TAKEN, "alias").alias("refusal"))


def apply_create_label(
    commands: DataFrame, labels: DataFrame, aliases: DataFrame, ids: Callable[..., DataFrame] = allocate_ids
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new labels, new aliases, outcomes).

    An existing (facet, key) gives the existing label and may gain aliases; its display name
    stays. A command fails as a whole when one of its aliases belongs to another label. ``ids``
    numbers the new ones.
    """
    error = quality.first_error(
        quality.label_part("facet", F.col("facet")),
        quality.label_part("key", F.col("label_key")),
        quality.single_line("display_name", F.col("display_name"), 200),
        quality.aliases_error(F.col("aliases")),
    )
    judged = commands.withColumns(
        {
            "error": error,
            "facet": utrim(F.col("facet")),
            "label_key": utrim(F.col("label_key")),
            "display_name": utrim(F.col("display_name")),
            "aliases": quality.canonical_aliases(F.col("aliases")),
        }
    ).withColumn("owner", F.concat_ws(":", "facet", "label_key"))
    good = judged.filter("error IS NULL")
    names = labels.select(F.col("id").alias("label_id"), views.label_canonical().alias("owner"))
    held = aliases.join(names, "label_id").select(F.lower("alias").alias("resource"), "owner")
    claims = good.select(
        F.col("seq").alias("command"),
        F.struct(*ORDER).alias("ord"),
        F.explode("aliases").alias("resource"),
        "owner",
    )
    settled = resolve_claims(claims, held).withColumn("granted", F.lit(True))
    decided = good.join(settled.withColumnRenamed("command", "seq"), "seq", "left").withColumn(
        "applied", F.coalesce(F.col("granted"), F.size("aliases") == 0)
    )
    won = decided.filter("applied")
    firsts = (
        won.join(names, "owner", "left_anti")
        .groupBy("owner")
        .agg(F.min(F.struct(*ORDER, "facet", "label_key", "display_name")).alias("first"))
    )
    start = labels.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = ids(firsts.select("owner", "first.*"), ORDER, start)
    named = names.unionByName(created.select(F.col("id").alias("label_id"), "owner"))
    new_aliases = (
        won.select("owner", F.explode("aliases").alias("alias"))
        .distinct()
        .join(held.select(F.col("resource").alias("alias")), "alias", "left_anti")
        .join(named, "owner")
        .select("label_id", "alias")
    )
    outcomes = (
        judged.join(decided.select("seq", "applied"), "seq", "left")
        .join(alias_refusals(decided.filter("applied IS NULL OR NOT applied"), held, won), "seq", "left")
        .join(named, "owner", "left")
        .select(
            "key",
            "seq",
            F.when(F.col("error").isNotNull(), INVALID)
            .when(F.col("applied"), APPLIED)
            .otherwise(CONFLICT)
            .alias("outcome"),
            F.coalesce("error", "refusal").alias("reason"),
            F.when(F.col("applied"), F.col("label_id")).alias("result_id"),
        )
    )
    return (
        created.select("id", "facet", F.col("label_key").alias("key"), "display_name"),
        new_aliases,
        outcomes,
    )


def record_errors(commands: DataFrame, scopes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, ts, seq, error): the first rule that a command's new record breaks, else null."""
    error = quality.record(
        F.col("scope_id"), F.col("title"), F.col("label_ids"), F.col("payload"), F.col("sources")
    )
    usable = labels.filter("active").select(F.col("id").alias("label_id"))
    unknown_label = (
        commands.select("seq", F.explode("label_ids").alias("label_id"))
        .join(usable, "label_id", "left_anti")
        .select("seq")
        .distinct()
        .withColumn("bad_label", F.lit(True))
    )
    known_scope = scopes.select(F.col("id").alias("scope_id"), F.lit(True).alias("known_scope"))
    return (
        commands.select("key", *ORDER, "scope_id", error.alias("error"))
        .join(known_scope, "scope_id", "left")
        .join(unknown_label, "seq", "left")
        .select(
            "key",
            *ORDER,
            F.coalesce(
                "error",
                F.when(
                    F.col("known_scope").isNull(),
                    F.format_string("scope %d does not exist", "scope_id"),
                ),
                F.when(F.col("bad_label"), F.lit("label does not exist")),
            ).alias("error"),
        )
    )


def apply_create_record(
    commands: DataFrame, scopes: DataFrame, labels: DataFrame, start_id: int
) -> dict[str, DataFrame]:
    """Validated create commands fanned out to the tables they write.

    Commands carry scope_id, title, payload, sources and label_ids. The result has the new
    ``records``, ``revisions``, ``sources``, ``assertions``, ``transitions`` and the
    ``outcomes``.
    """
    # Rules run once; what is kept and ordered is one narrow row per command.
    verdicts = cut(record_errors(commands, scopes, labels))
    ids = allocate_ids(
        verdicts.filter("error IS NULL").select(*ORDER), ORDER, start_id, "record_id"
    ).select("seq", "record_id")
    created = commands.join(ids, "seq").withColumn("title", utrim(F.col("title")))
    outcomes = verdicts.join(ids, "seq", "left").select(
        "key",
        "seq",
        F.when(F.col("error").isNull(), APPLIED).otherwise(INVALID).alias("outcome"),
        F.col("error").alias("reason"),
        F.col("record_id").alias("result_id"),
    )
    return {**fan_out(created), "outcomes": outcomes}


def who(rows: DataFrame) -> list[Column]:
    """The provenance columns that commands bring."""
    return [F.col(c) for c in ("actor", "thread", "client") if c in rows.columns]


def fan_out(created: DataFrame) -> dict[str, DataFrame]:
    """Ledger rows of new records; ``created`` holds one row per record with its id."""
    records = created.select(
        F.col("record_id").alias("id"),
        "scope_id",
        F.col("payload.kind").alias("kind"),
        "title",
        F.lit("active").alias("lifecycle"),
        F.lit(1).cast("bigint").alias("current_revision"),
        F.lit(True).alias("readable"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        *who(created),
        F.col("key").alias("idempotency_key"),
    )
    revisions = created.select(
        "record_id",
        F.lit(1).cast("bigint").alias("revision"),
        "title",
        "payload",
        F.lit(CREATED).alias("reason"),
        F.col("ts").alias("created_at"),
        *who(created),
        F.col("key").alias("idempotency_key"),
    )
    assertions = created.select(
        "record_id",
        F.explode(F.array_distinct("label_ids")).alias("label_id"),
        F.lit(CREATED).alias("reason"),
        "key",
        *ORDER,
        F.col("ts").alias("created_at"),
        *who(created),
    ).withColumn("idempotency_key", F.concat_ws(":", "key", F.lit("label"), "label_id"))
    transitions = created.select(
        "record_id",
        F.lit(None).cast("string").alias("from_state"),
        F.lit("active").alias("to_state"),
        F.lit(CREATED).alias("reason"),
        F.col("ts").alias("created_at"),
        *who(created),
        F.concat(F.col("key"), F.lit(":lifecycle")).alias("idempotency_key"),
    )
    return {
        "records": records,
        "revisions": revisions,
        "sources": source_rows(created, F.lit(1)),
        "assertions": assertions,
        "transitions": transitions,
    }


def source_rows(rows: DataFrame, revision: Column) -> DataFrame:
    """One row per source of a revision, in position order, blank fields as null."""
    exploded = rows.select(
        "record_id",
        revision.cast("bigint").alias("revision"),
        F.posexplode("sources").alias("position", "source"),
    )
    optional = ["locator", "version", "content_hash", "anchor"]
    return exploded.select(
        "record_id",
        "revision",
        F.col("position").cast("bigint").alias("position"),
        utrim(F.col("source.identity")).alias("identity"),
        *[trim_option(F.col(f"source.{name}")).alias(name) for name in optional],
        F.col("source.quote").alias("quote"),
    )


def revise_error(columns: list[str]) -> Column:
    """The first argument rule that a revise command breaks, of the arguments it brings."""
    brings = set(columns)
    sources = F.col("sources") if "sources" in brings else F.lit(None).cast(T.ArrayType(SOURCE))
    rules = [
        quality.positive("record_id", F.col("record_id")),
        quality.positive("expected_revision", F.col("expected_revision")),
    ]
    if "title" in brings:
        rules.append(quality.title(F.col("title")))
    if "reason" in brings:
        rules.append(quality.reason(F.col("reason")))
    if "payload" in brings:
        rules.append(quality.payload(F.col("payload"), sources))
    return quality.first_error(*rules)


def apply_revise(
    commands: DataFrame, records: DataFrame, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Outcome and reason per revise command; an applied one has its new revision number.

    Argument rules come first, then whether the record is there, then its revision at that point
    of the batch, then its kind. From the current revision on the applied commands are a chain:
    the first command that expects it, then the first later one that expects the next revision,
    and so on. Commands that no chain can enter are dropped per slice first; each remaining
    command points at its successor and the chains are followed by doubling jumps, so neither a
    hot record nor a long chain is one task's work.
    """
    state = _readable(commands, records, "kind", "current_revision").withColumn(
        "error", revise_error(commands.columns)
    )
    judged = state.filter("error IS NULL AND seen")
    kind_ok = (
        F.col("payload.kind") == F.col("kind") if "payload" in commands.columns else F.lit(True)
    )
    sliced = with_slices(
        judged.select(
            "record_id", "expected_revision", "current_revision", kind_ok.alias("kind_ok"), *ORDER
        ),
        rows_per_slice,
    )
    narrow = sliced.filter(
        F.col("kind_ok") & (F.col("expected_revision") >= F.col("current_revision"))
    )

    def levels(rows: DataFrame) -> DataFrame:
        """Each command twice: as the one that reaches a level, and as the step to the next."""
        return rows.select(
            "*",
            F.explode(
                F.array(
                    F.struct(F.col("expected_revision").alias("level"), F.lit(False).alias("step")),
                    F.struct((F.col("expected_revision") + 1).alias("level"), F.lit(True).alias("step")),
                )
            ).alias("at"),
        ).select("*", "at.*").drop("at")

    in_slice = Window.partitionBy("record_id", "level", "slice").orderBy(*ORDER)
    before = F.lag("step").over(in_slice)
    enterable = (
        levels(narrow)
        .withColumn("before", before)
        .filter(~F.col("step") & (F.col("before").isNull() | F.col("before")))
        .select(*narrow.columns)
    )
    target = F.when(~F.col("step"), F.col("seq"))
    nodes = (
        following_value(levels(enterable), ["record_id", "level"], target, "next")
        .filter("step")
        .select(F.col("seq").alias("id"), "next")
    )
    roots = first_per(
        enterable.filter(F.col("expected_revision") == F.col("current_revision")), ["record_id"]
    ).select(F.col("first_seq").alias("id"))
    won = reachable(nodes, roots).select(F.col("id").alias("seq"), F.lit(1).alias("won"))

    # What a command met: the revision before the batch and the applied commands before it.
    met = running_sum(
        sliced.join(won, "seq", "left").withColumn("won", F.coalesce("won", F.lit(0))),
        ["record_id"],
        F.col("won"),
        "done",
    ).select(
        "seq",
        (F.col("won") == 1).alias("won"),
        (F.col("current_revision") + F.col("done") - F.col("won")).cast("bigint").alias("met"),
    )
    refusal = F.when(
        F.col("met") != F.col("expected_revision"),
        F.format_string(REVISION_CONFLICT, "expected_revision", "met"),
    ).otherwise(KIND_CHANGED)
    return state.join(met, "seq", "left").select(
        "key",
        *ORDER,
        "record_id",
        "expected_revision",
        F.when(F.col("error").isNotNull() | F.col("seen").isNull(), INVALID)
        .when(F.col("won"), APPLIED)
        .when(F.col("met") != F.col("expected_revision"), CONFLICT)
        .otherwise(INVALID)
        .alias("outcome"),
        F.coalesce(
            "error", F.when(F.col("seen").isNull(), _missing()), F.when(~F.col("won"), refusal)
        ).alias("reason"),
        F.when(F.col("won"), F.col("expected_revision") + 1).alias("new_revision"),
    )


def apply_labels(
    commands: DataFrame,
    records: DataFrame,
    labels: DataFrame,
    active: DataFrame,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Outcome per ``add_label`` / ``retract_label`` command.

    ``active`` holds the active (record_id, label_id) pairs before the batch. Adding an active
    label, retracting an inactive one, and retracting the last label of a record conflict.

    Without the last-label rule a label's state is just its previous command, and the number
    of labels a running sum. That state differs from the true one by at most one label per
    record: the one whose retraction was refused because it was the last. It stays until the
    next command on it while another label is there. Those spans form a chain per record,
    followed by doubling jumps. Everything is windows over (key, time slice) and joins.
    """
    usable = labels.filter("active").select(
        F.col("id").alias("label_id"), F.lit(True).alias("usable")
    )
    pairs = narrowed(active, "record_id", commands, "record_id").select(
        "record_id", "label_id"
    ).distinct()
    guarded = _readable(commands, records).join(usable, "label_id", "left").withColumn(
        "guard",
        F.when(F.col("seen").isNull(), _missing()).when(
            (F.col("op") == "add_label") & F.col("usable").isNull(),
            F.format_string("label %d does not exist", "label_id"),
        ),
    )
    adding = F.col("op") == "add_label"
    ready = with_slices(
        guarded.filter("guard IS NULL").select("record_id", "label_id", "op", *ORDER), rows_per_slice
    ).join(
        pairs.withColumn("held", F.lit(True)), ["record_id", "label_id"], "left"
    )
    rows = previous_value(
        ready, ["record_id", "label_id"], adding, "is_on", F.coalesce("held", F.lit(False))
    )
    change = (
        F.when(adding & ~F.col("is_on"), 1).when(~adding & F.col("is_on"), -1).otherwise(0)
    )
    counts = pairs.groupBy("record_id").agg(F.count("*").alias("base"))
    rows = running_sum(rows.withColumn("change", change), ["record_id"], F.col("change"), "moved")
    rows = rows.join(counts, "record_id", "left").withColumn(
        "after", F.coalesce("base", F.lit(0)) + F.col("moved")
    )
    rows = cut(
        rows.withColumn("before", F.col("after") - F.col("change")).select(
            "record_id", "label_id", "op", *ORDER, "slice", "change", "after", "before"
        )
    )
    emptied = (F.col("change") == -1) & (F.col("after") == 0)
    plain = (
        F.when(F.col("change") != 0, "")
        .when(adding, LABEL_ACTIVE)
        .otherwise(LABEL_INACTIVE)
    )
    verdicts = rows.select("seq", plain.alias("verdict"))
    # Labels that ever empty their record; in most batches there are none.
    risky = rows.filter(emptied).select("record_id", "label_id").distinct()
    if not risky.isEmpty():
        verdicts = (
            verdicts.join(_kept_labels(rows, risky, adding, emptied), "seq", "left")
            .select("seq", F.coalesce("fixed", "verdict").alias("verdict"))
        )
    return (
        guarded.join(verdicts, "seq", "left")
        .select(
            "key",
            *ORDER,
            "op",
            "record_id",
            "label_id",
            F.when(F.col("guard").isNotNull(), INVALID)
            .when(F.col("verdict") == "", APPLIED)
            .otherwise(CONFLICT)
            .alias("outcome"),
            F.coalesce("guard", F.nullif("verdict", F.lit(""))).alias("reason"),
        )
    )


def _kept_labels(rows: DataFrame, risky: DataFrame, adding: Column, emptied: Column) -> DataFrame:
    """Verdicts that differ because a record kept its last label: (seq, fixed)."""
    # A command that would end a span of its own label.
    clearing = adding | (F.col("before") >= 1)
    at = F.struct(*ORDER, "slice")
    on_risky = following_value(
        rows.join(risky, ["record_id", "label_id"], "left_semi"),
        ["record_id", "label_id"],
        F.when(clearing, at),
        "clear",
    )
    starts = on_risky.filter(emptied).select("record_id", "label_id", *ORDER, "slice", "clear")
    none = F.lit(None).cast("bigint")
    events = starts.select(
        "record_id", *ORDER, "slice", F.lit(1).alias("turn"), F.col("seq").alias("start"), none.alias("asks")
    ).unionByName(
        starts.filter("clear IS NOT NULL").select(
            "record_id",
            F.col("clear.ts").alias("ts"),
            F.col("clear.seq").alias("seq"),
            F.col("clear.slice").alias("slice"),
            F.lit(0).alias("turn"),
            none.alias("start"),
            F.col("seq").alias("asks"),
        )
    )
    # First start at or after the end of a span: of one command's events the end comes first. A
    # clearing retraction may itself empty nothing, so a start never coincides with the command
    # that cleared its own span.
    nodes = (
        following_value(events, ["record_id"], F.col("start"), "next", [*ORDER, "turn"])
        .filter("asks IS NOT NULL")
        .select(F.col("asks").alias("id"), "next")
    )
    roots = first_per(starts, ["record_id"]).select(F.col("first_seq").alias("id"))
    kept = starts.join(
        reachable(nodes, roots).select(F.col("id").alias("seq")), "seq", "left_semi"
    )
    # The spans of a label don't overlap: a command lies in the last one that starts before it.
    spans = kept.select(
        "seq",
        F.struct(
            F.struct(*ORDER).alias("start"),
            F.when(F.col("clear").isNotNull(), F.struct("clear.ts", "clear.seq")).alias("end"),
        ).alias("span"),
    )
    within = latest_value(
        rows.join(risky, ["record_id", "label_id"], "left_semi").join(spans, "seq", "left"),
        ["record_id", "label_id"],
        F.col("span"),
        "inside",
    ).withColumns({"span_start": F.col("inside.start"), "span_end": F.col("inside.end")})
    return (
        within.filter(
            F.col("inside").isNotNull()
            & (F.col("span_end").isNull() | (F.struct(*ORDER) <= F.col("span_end")))
        )
        .select(
            "seq",
            F.when(F.struct(*ORDER) == F.col("span_start"), LAST_LABEL)
            .when(adding, LABEL_ACTIVE)
            .when(F.struct(*ORDER) == F.col("span_end"), "")
            .otherwise(LAST_LABEL)
            .alias("fixed"),
        )
    )


def apply_relations(
    commands: DataFrame, records: DataFrame, relations: DataFrame, retractions: DataFrame
) -> DataFrame:
    """Outcome per add_relation and retract_relation command, all in one order.

    A retraction names a stored edge; from there on the edge may be added again.
    """
    asks = {op: commands.filter(F.col("op") == op) for op in ("add_relation", "retract_relation")}
    ended = apply_retract_relation(asks["retract_relation"], records, relations, retractions)
    released = ended.filter(F.col("outcome") == APPLIED).select(
        "relation_id", F.struct(*ORDER).alias("released")
    )
    added = apply_add_relation(asks["add_relation"], records, relations, retractions, released)
    columns = ["key", *ORDER, "outcome", "reason"]
    return added.select(*columns).unionByName(ended.select(*columns))


def apply_add_relation(
    commands: DataFrame,
    records: DataFrame,
    relations: DataFrame,
    retractions: DataFrame,
    released: DataFrame | None = None,
) -> DataFrame:
    """Outcome per add_relation command (record_id, target_record_id, relation_kind).

    ``released`` says when the batch itself retracts stored edges: (relation_id, released).
    """
    edge = ["record_id", "target_record_id", "relation_kind"]
    target = narrowed(records.filter("readable"), "id", commands, "target_record_id").select(
        F.col("id").alias("target_record_id"), F.lit(True).alias("target_seen")
    )
    judged = (
        _readable(commands, records)
        .join(target, "target_record_id", "left")
        .withColumn(
            "error",
            F.when(F.col("record_id") == F.col("target_record_id"), SELF_RELATION)
            .when(~F.col("relation_kind").isin(*DIRECT_RELATIONS), "relation kind is not known")
            .when(F.col("seen").isNull(), _missing())
            .when(F.col("target_seen").isNull(), _missing("target_record_id")),
        )
    )
    near = narrowed(relations, "source_record_id", commands, "record_id")
    active = views.active_edges(near, retractions)
    if released is None:
        active = active.withColumn("released", F.lit(None).cast("struct<ts:timestamp_ntz,seq:bigint>"))
    else:
        active = active.join(released.withColumnRenamed("relation_id", "id"), "id", "left")
    taken = active.groupBy(
        F.col("source_record_id").alias("record_id"),
        "target_record_id",
        F.col("kind").alias("relation_kind"),
    ).agg(
        F.max("released").alias("free_after"),
        F.max(F.col("released").isNull()).alias("stays"),
    )
    # One row per edge decides it, so a command asked for by many is still one comparison.
    open_for = F.col("stays").isNull() | (~F.col("stays") & (F.struct(*ORDER) > F.col("free_after")))
    firsts = first_per(
        judged.filter("error IS NULL").join(taken, edge, "left").filter(open_for), edge
    ).select(F.col("first_seq").alias("seq"), F.lit(True).alias("won"))
    return judged.join(firsts, "seq", "left").select(
        "key",
        *ORDER,
        *edge,
        F.when(F.col("error").isNotNull(), INVALID)
        .when(F.col("won"), APPLIED)
        .otherwise(CONFLICT)
        .alias("outcome"),
        F.coalesce("error", F.when(F.col("won").isNull(), RELATION_ACTIVE)).alias("reason"),
    )


def apply_retract_relation(
    commands: DataFrame, records: DataFrame, relations: DataFrame, retractions: DataFrame
) -> DataFrame:
    """Outcome per retract_relation command (relation_id): first of a batch wins."""
    named = narrowed(relations, "id", commands, "relation_id")
    seen = views.visible_edges(records, named).select(
        F.col("id").alias("relation_id"), F.lit(True).alias("seen")
    )
    judged = commands.join(seen, "relation_id", "left")
    firsts = (
        first_per(judged.filter("seen"), ["relation_id"])
        .join(retractions.select("relation_id"), "relation_id", "left_anti")
        .select(F.col("first_seq").alias("seq"), F.lit(True).alias("won"))
    )
    return judged.join(firsts, "seq", "left").select(
        "key",
        *ORDER,
        "relation_id",
        F.when(F.col("seen").isNull(), INVALID)
        .when(F.col("won"), APPLIED)
        .otherwise(CONFLICT)
        .alias("outcome"),
        F.when(
            F.col("seen").isNull(), F.format_string("relation %d does not exist", "relation_id")
        )
        .when(F.col("won").isNull(), RELATION_RETRACTED)
        .alias("reason"),
    )


def apply_transition(commands: DataFrame, records: DataFrame) -> DataFrame:
    """Outcome per transition command: the first one on an active record retracts it.

    A column ``to`` other than ``retracted`` is refused.
    """
    to = F.col("to") if "to" in commands.columns else F.lit("retracted")
    judged = _readable(commands, records, "lifecycle").withColumn(
        "error",
        F.when(to != "retracted", OTHER_LIFECYCLE).when(F.col("seen").isNull(), _missing()),
    )
    firsts = first_per(
        judged.filter("error IS NULL AND lifecycle = 'active'"), ["record_id"]
    ).select(F.col("first_seq").alias("seq"), F.lit(True).alias("won"))
    return judged.join(firsts, "seq", "left").select(
        "key",
        *ORDER,
        "record_id",
        F.when(F.col("error").isNotNull(), INVALID)
        .when(F.col("won"), APPLIED)
        .otherwise(CONFLICT)
        .alias("outcome"),
        F.coalesce("error", F.when(F.col("won").isNull(), NOT_ACTIVE)).alias("reason"),
    )


def _targets(commands: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, ts, record_id, seen, lifecycle) for every record a command would end."""
    exploded = commands.select(*ORDER, F.explode("record_ids").alias("record_id"))
    return _readable(exploded, records, "lifecycle")


def resolve_endings(commands: DataFrame, records: DataFrame) -> DataFrame:
    """Outcome of commands that end records: supersede (one record) and merge (several).

    All records of a command must be active when it runs, and all end with it. If no command
    has more than one, the first per record wins; else shared records are settled in rounds.
    """
    targets = _targets(commands, records)
    per_command = targets.groupBy("seq").agg(
        F.min(F.when(F.col("seen").isNull(), F.col("record_id"))).alias("missing_id"),
        F.min(F.col("lifecycle") == "active").alias("all_active"),
    )
    open_commands = per_command.filter("missing_id IS NULL AND all_active").select("seq")
    open_targets = targets.join(open_commands, "seq", "left_semi")
    if commands.filter(F.size("record_ids") > 1).isEmpty():
        won = first_per(open_targets, ["record_id"]).select(
            F.col("first_seq").alias("seq"), F.lit(True).alias("won")
        )
        return per_command.join(won, "seq", "left")
    claims = open_targets.select(
        F.col("seq").alias("command"),
        F.struct(*ORDER).alias("ord"),
        F.col("record_id").alias("resource"),
        F.col("seq").alias("owner"),
    )
    nothing = claims.select("resource", "owner").limit(0)
    won = resolve_claims(claims, nothing).select(
        F.col("command").alias("seq"), F.lit(True).alias("won")
    )
    return per_command.join(won, "seq", "left")


def apply_endings(commands: DataFrame, records: DataFrame) -> DataFrame:
    """Outcome of all commands that end records, in one order: transition_record,
    supersede_record and merge_records compete for the same active records.

    ``commands`` has ``op``, ``record_ids`` (the records it would end) and ``error``, an argument
    rule it breaks.
    """
    settled = cut(resolve_endings(commands.filter("error IS NULL"), records))
    conflict = (
        F.when(F.col("op") == "supersede_record", NOT_SUPERSEDABLE)
        .when(F.col("op") == "merge_records", NOT_MERGEABLE)
        .otherwise(NOT_ACTIVE)
    )
    return commands.join(settled, "seq", "left").select(
        "key",
        *ORDER,
        F.when(F.col("error").isNotNull() | F.col("missing_id").isNotNull(), INVALID)
        .when(F.col("won"), APPLIED)
        .otherwise(CONFLICT)
        .alias("outcome"),
        F.coalesce(
            "error",
            F.when(F.col("missing_id").isNotNull(), _missing("missing_id")),
            F.when(F.col("won").isNull(), conflict),
        ).alias("reason"),
    )


def _endings(commands: DataFrame, records: DataFrame, start_id: int) -> tuple[DataFrame, DataFrame]:
    """(commands that ended records, with the id of their new record; outcomes)."""
    outcomes = cut(apply_endings(commands, records))
    won = outcomes.filter(F.col("outcome") == APPLIED).select(*ORDER)
    ids = allocate_ids(won, ORDER, start_id, "new_id").select("seq", "new_id")
    created = commands.drop("error").join(ids, "seq")
    return created, outcomes.join(ids.withColumnRenamed("new_id", "result_id"), "seq", "left")


def _replacement_error(
    commands: DataFrame, own: Column, scopes: DataFrame | None, labels: DataFrame | None
) -> DataFrame:
    """``commands`` with ``error``: its own argument rule, then those of the new record it brings."""
    judged = commands.withColumn("error", own)
    if "payload" not in commands.columns:
        return judged
    errors = record_errors(commands, scopes, labels).select("seq", F.col("error").alias("_new_error"))
    return (
        judged.join(errors, "seq")
        .withColumn("error", F.coalesce("error", "_new_error"))
        .drop("_new_error")
    )


def _new_records(created: DataFrame) -> dict[str, DataFrame]:
    """Rows of the replacements, if the commands bring them."""
    if "payload" not in created.columns:
        return {}
    made = fan_out(
        created.withColumn("record_id", F.col("new_id")).withColumn("title", utrim(F.col("title")))
    )
    return {("created_transitions" if k == "transitions" else k): v for k, v in made.items()}


def _ending_rows(created: DataFrame, to_state: str, kind: str, into: bool) -> dict[str, DataFrame]:
    """Edges and transitions of the records that ``created`` commands ended."""
    reason = [utrim(F.col("reason")).alias("reason")] if "reason" in created.columns else []
    ended = created.select(
        "key", *ORDER, *who(created), *reason, "new_id", F.explode("record_ids").alias("old_id")
    )
    source, target = ("old_id", "new_id") if into else ("new_id", "old_id")
    provenance = [*(["reason"] if reason else []), F.col("ts").alias("created_at"), *who(created)]
    edges = ended.select(
        F.col(source).alias("source_record_id"),
        F.col(target).alias("target_record_id"),
        F.lit(kind).alias("kind"),
        F.concat_ws(":", "key", F.lit("relation"), source, target, F.lit(kind)).alias(
            "idempotency_key"
        ),
        *provenance,
        "key",
        *ORDER,
    )
    transitions = ended.select(
        F.col("old_id").alias("record_id"),
        F.lit("active").alias("from_state"),
        F.lit(to_state).alias("to_state"),
        F.concat_ws(":", "key", F.lit("lifecycle"), "old_id").alias("idempotency_key"),
        *provenance,
    )
    return {"edges": edges, "transitions": transitions}


def apply_supersede(
    commands: DataFrame,
    records: DataFrame,
    start_id: int,
    scopes: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Supersede commands: a new record replaces record_id, which becomes superseded.

    Commands with scope_id, title, payload, sources and label_ids bring the replacement: its rules
    are checked against ``scopes`` and ``labels``, and its rows are in the result. The first valid
    command on an active record wins, without rounds.
    """
    single = _replacement_error(
        commands.withColumns({"op": F.lit("supersede_record"), "record_ids": F.array("record_id")}),
        F.lit(None).cast("string"),
        scopes,
        labels,
    )
    created, outcomes = _endings(single, records, start_id)
    rows = _ending_rows(created, "superseded", "supersedes", into=False)
    return {"created": created, "outcomes": outcomes, **rows, **_new_records(created)}


def apply_merge(
    commands: DataFrame,
    records: DataFrame,
    start_id: int,
    scopes: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Merge commands (record_ids): each input gets an edge to a new record and becomes merged;
    all inputs or none. The new record's fields are as in :func:`apply_supersede`."""
    distinct = commands.withColumns(
        {"op": F.lit("merge_records"), "record_ids": F.array_distinct("record_ids")}
    )
    own = quality.first_error(
        quality.ids("record_ids", F.col("record_ids")),
        quality.error_if(F.size("record_ids") < 2, MERGE_TOO_FEW),
    )
    created, outcomes = _endings(_replacement_error(distinct, own, scopes, labels), records, start_id)
    rows = _ending_rows(created, "merged", "merged_into", into=True)
    return {"created": created, "outcomes": outcomes, **rows, **_new_records(created)}
