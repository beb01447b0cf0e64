"""A mixed batch of commands applied to the ledger: outcomes, and the tables afterwards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import utrim
from tessera.operators import ledger_rows, quality, views
from tessera.operators.commands import (
    APPLIED,
    CONFLICT,
    INVALID,
    KEY_REUSED,
    MERGE_TOO_FEW,
    OTHER_LIFECYCLE,
    REPLAYED,
    _ending_rows,
    apply_create_label,
    apply_create_scope,
    apply_endings,
    apply_labels,
    apply_relations,
    apply_revise,
    fan_out,
    narrowed,
    record_errors,
    request_hash,
    who,
)
from tessera.operators.naming import LISTS, MAKES, PROVISIONAL, REFS, earlier_names, provisional, what_of, with_named
from tessera.operators.ordering import ORDER, allocate_ids
from tessera.operators.textindex import shuffle_partitions
from tessera.schemas import PAYLOAD, SOURCE
from tessera.session import cut, written

Tables = Callable[[str], DataFrame]

LABEL_OPS = ["add_label", "retract_label"]
RELATION_OPS = ["add_relation", "retract_relation"]
REPLACING_OPS = ["supersede_record", "merge_records"]
RECORD_MAKERS = ["create_record", *REPLACING_OPS]
OPS = ["revise_record", *LABEL_OPS, *RELATION_OPS, "transition_record", *MAKES]
# Fixed value: wording of the refusal.
UNKNOWN_OP = "operation is not known"

#: Arguments of operations that create something; a batch may lack the columns of those it doesn't have.
CREATING = {
    "scope_id": "bigint",
    "title": "string",
    "payload": PAYLOAD.simpleString(),
    "sources": f"array<{SOURCE.simpleString()}>",
    "label_ids": "array<bigint>",
    "record_id": "bigint",
    "record_ids": "array<bigint>",
    "name": "string",
    "facet": "string",
    "label_key": "string",
    "display_name": "string",
    "aliases": "array<string>",
    "reason": "string",
}
MADE = "what string, ref string, ts timestamp_ntz, seq bigint, id bigint, scope_id bigint, kind string, label_ids array<bigint>"


def with_arguments(commands: DataFrame) -> DataFrame:
    lacking = {n: F.lit(None).cast(t) for n, t in CREATING.items() if n not in commands.columns}
    return commands.withColumns(lacking)


def ends_of(commands: DataFrame) -> DataFrame:
    """``commands`` that end records, with ``record_ids``: all that they would end."""
    merges = F.col("op") == "merge_records"
    return commands.withColumn(
        "record_ids", F.when(merges, F.array_distinct("record_ids")).otherwise(F.array("record_id"))
    )


def ending_errors(commands: DataFrame, replacing: DataFrame, scopes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, ts, seq, op, record_ids, error) of transition, supersede and merge commands."""
    to = F.col("to") if "to" in commands.columns else F.lit("retracted")
    plain = commands.filter("op = 'transition_record'").select(
        "key", *ORDER, "op", F.array("record_id").alias("record_ids"), F.when(to != "retracted", OTHER_LIFECYCLE).alias("error")
    )
    if replacing is None:
        return plain
    merges = F.col("op") == "merge_records"
    own = quality.first_error(
        F.when(merges, quality.ids("record_ids", F.col("record_ids"))),
        F.when(merges, quality.error_if(F.coalesce(F.size("record_ids"), F.lit(0)) < 2, MERGE_TOO_FEW)),
    )
    new = record_errors(replacing, scopes, labels).select("seq", F.col("error").alias("_new"))
    judged = replacing.withColumn("own", own).join(new, "seq")
    return plain.unionByName(judged.select("key", *ORDER, "op", "record_ids", F.coalesce("own", "_new").alias("error")))


def judge(
    commands: DataFrame,
    tables: Tables,
    present: set[str],
    made: DataFrame | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """(key, ts, seq, outcome, reason, new_revision, id) as if every command had a key of its own.

    ``present`` are the operations that the batch has; the rules of others are not run.
    ``made`` (see MADE) are the things that commands of this batch are taken to make, ``before`` the
    names from batches before. ``id`` is what a creating command makes: a provisional id, or that of
    a scope or label that is there already. Without ``made`` the batch creates nothing.
    """
    columns = ["key", *ORDER, "outcome", "reason"]
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    unknown = commands.filter(~known).select(
        "key", *ORDER, F.lit(INVALID).alias("outcome"), F.lit(UNKNOWN_OP).alias("reason")
    )
    commands = commands.filter(known)
    error = F.lit(None).cast("string")
    if {"actor", "thread", "client"} <= set(commands.columns):
        error = quality.context(F.col("key"), F.col("actor"), F.col("thread"), F.col("client"))
    if made is not None:
        commands = with_named(commands, made.select(*before.columns).unionByName(before))
        error = F.coalesce(error, "unnamed")
    commands = cut(commands.withColumn("_error", error))
    refused = commands.filter("_error IS NOT NULL").select(
        "key", *ORDER, F.lit(INVALID).alias("outcome"), F.col("_error").alias("reason")
    )
    commands = commands.filter("_error IS NULL").drop("_error")

    def of(*ops: str) -> DataFrame:
        return commands.filter(F.col("op").isin(*ops))

    records, labels, scopes = tables("records"), tables("labels"), tables("scopes") if made is not None else None
    active = views.active_assertions(tables("label_assertions"), tables("label_retractions")).select(
        "record_id", "label_id"
    )
    creating = replacing = None
    if made is not None:
        creating = with_arguments(commands)
        replacing = ends_of(creating.filter(F.col("op").isin(*REPLACING_OPS)))
        new = made.filter("what = 'record'")
        records = records.select("id", "scope_id", "kind", "lifecycle", "current_revision", "readable").unionByName(
            new.select(
                "id",
                "scope_id",
                "kind",
                F.lit("active").alias("lifecycle"),
                F.lit(1).cast("bigint").alias("current_revision"),
                F.lit(True).alias("readable"),
            )
        )
        active = active.unionByName(
            new.select(F.col("id").alias("record_id"), F.explode(F.array_distinct("label_ids")).alias("label_id"))
        )
        fresh = made.filter(F.col("id") >= PROVISIONAL)
        known_scopes = scopes.select("id").unionByName(fresh.filter("what = 'scope'").select("id").distinct())
        known_labels = labels.select("id", "active").unionByName(
            fresh.filter("what = 'label'").select("id", F.lit(True).alias("active")).distinct()
        )
        labels = known_labels
        if present & {"create_record", *REPLACING_OPS}:
            labels, known_scopes = cut(known_labels), cut(known_scopes)
    revised = None
    others, makers = [unknown, refused], []
    if present & set(LABEL_OPS):
        others.append(apply_labels(of(*LABEL_OPS), records, labels, active))
    if present & set(RELATION_OPS):
        others.append(
            apply_relations(of(*RELATION_OPS), records, tables("record_relations"), tables("relation_retractions"))
        )
    ended = None
    if present & {"transition_record", *REPLACING_OPS}:
        ending = ending_errors(commands, replacing, known_scopes if made is not None else None, labels)
        ended = apply_endings(cut(ending), records)
    if "revise_record" in present:
        revised = apply_revise(of("revise_record"), records).select(*columns, "new_revision")
    if made is not None:
        errors = record_errors(creating.filter("op = 'create_record'"), known_scopes, labels)
        created = errors.select(
            "key",
            *ORDER,
            F.when(F.col("error").isNull(), APPLIED).otherwise(INVALID).alias("outcome"),
            F.col("error").alias("reason"),
        )
        for part in [created] if ended is None else [created, ended]:
            maker = part.join(commands.filter(F.col("op").isin(*RECORD_MAKERS)).select("seq", F.lit(True).alias("_makes")), "seq", "left")
            new_id = F.when(F.col("_makes") & (F.col("outcome") == APPLIED), F.lit(PROVISIONAL) + F.col("seq"))
            makers.append(maker.withColumn("id", new_id).select(*columns, "id"))
        order, found = creating.select(*ORDER), []
        if "create_scope" in present:
            asked = creating.filter("op = 'create_scope'").select("key", *ORDER, "name")
            found.append(apply_create_scope(asked, scopes, provisional)[-1])
        if "create_label" in present:
            asked = creating.filter("op = 'create_label'")
            asked = asked.select("key", *ORDER, "facet", "label_key", "display_name", "aliases")
            found.append(apply_create_label(cut(asked), tables("labels"), tables("label_aliases"), provisional)[-1])
        for part in found:
            makers.append(part.join(order, "seq").select(*columns, F.col("result_id").alias("id")))
    elif ended is not None:
        others.append(ended)
    none = F.lit(None).cast("bigint")
    parts = [part.select(*columns, none.alias("new_revision"), none.alias("id")) for part in others]
    parts += [part.select(*columns, none.alias("new_revision"), "id") for part in makers]
    if revised is not None:
        parts.append(revised.select(*columns, "new_revision", none.alias("id")))
    return reduce(DataFrame.unionByName, parts)


def makings(commands: DataFrame, judged: DataFrame, names: DataFrame) -> DataFrame:
    """What applied commands make (see MADE), of a key's commands the first."""
    won = judged.filter((F.col("outcome") == APPLIED) & F.col("id").isNotNull()).select("seq", "id")
    rows = with_named(with_arguments(commands).drop("id"), names).join(won, "seq").withColumn("what", what_of())
    first = rows.groupBy(F.col("key").alias("ref")).agg(F.min("seq").alias("seq"))
    return rows.join(first, "seq").select(
        "what", "ref", *ORDER, "id", "scope_id", F.col("payload.kind").alias("kind"), "label_ids"
    )


def hoped(commands: DataFrame, tables: Tables, names: DataFrame) -> DataFrame:
    """What the batch would make (see MADE) if no command that makes a record were refused.

    Scopes and labels name nothing, so what they make is known at once.
    """
    given = with_arguments(commands)
    asked = given.filter("op = 'create_scope'").select("key", *ORDER, "name")
    found = [apply_create_scope(asked, tables("scopes"), provisional)[-1]]
    asked = given.filter("op = 'create_label'").select("key", *ORDER, "facet", "label_key", "display_name", "aliases")
    if not asked.isEmpty():
        found.append(apply_create_label(cut(asked), tables("labels"), tables("label_aliases"), provisional)[-1])
    made = [part.select("seq", "outcome", F.col("result_id").alias("id")) for part in found]
    makers = given.filter(F.col("op").isin(*RECORD_MAKERS))
    made.append(makers.select("seq", F.lit(APPLIED).alias("outcome"), (F.lit(PROVISIONAL) + F.col("seq")).alias("id")))
    own = makings(commands.filter(F.col("op").isin(*MAKES)), reduce(DataFrame.unionByName, made), names)
    own = written(own, "hoped")
    # Records lie in scopes and have labels that the batch itself makes.
    again = names.unionByName(own.select(*names.columns))
    return written(makings(commands.filter(F.col("op").isin(*MAKES)), reduce(DataFrame.unionByName, made), again), "made")


def named_keys(commands: DataFrame) -> DataFrame | None:
    """(what, ref): the keys by which commands name things."""
    parts = [commands.select(F.lit(what).alias("what"), F.col(ref).alias("ref")) for ref, what in REFS.values() if ref in commands.columns]
    parts += [
        commands.select(F.lit(what).alias("what"), F.explode(ref).alias("ref")) for ref, what in LISTS.values() if ref in commands.columns
    ]
    return reduce(DataFrame.unionByName, parts).filter("ref IS NOT NULL").distinct() if parts else None


def apply_batch(commands: DataFrame, tables: Tables) -> DataFrame:
    """Outcome of every command of a mixed batch, in (ts, seq) order across operations.

    ``commands`` has key, ts, seq (unique), op, request and the arguments of the operations;
    ``tables`` gives the ledger's tables by name. Returns ``key, ts, seq, op, request_hash,
    outcome, reason, new_revision, made_id``. A command without an operation, or with one that is
    not known, is invalid, as is one that breaks a rule on its key, actor, thread or client, where
    the batch has these columns.

    A command may name what another one creates by that command's key, in columns like
    ``record_ref`` beside ``record_id`` (see ``naming``): of this batch, what was created before
    it, or of any batch before. An id as such names what was there before the batch. While commands
    are judged, new things have provisional ids. At the end those that were made get the next ids in command order: ``made_id``, which is also that of
    an existing scope or label for a command that asked for it.

    Only an applied command uses up its key: later commands with that key replay it if they ask
    for the same, else they conflict. A command whose key was used up before the batch never runs.
    Which commands run thus depends on outcomes, and these on which commands run. All run at
    first, as if all records were made that commands want to make (``hoped``); then each key's
    commands up to its first applied one run again. What comes before the first wrong decision is
    right in every round, so rounds end. A refused command changes nothing, so a round is the last
    if no key has two applied commands or lost its only one, and if what commands name by key was
    made as assumed. A batch in which neither happens needs one round; refusals along a chain of
    names (a record that replaces a record that the batch made is a link) take a round per link.
    """
    hashed = commands.withColumn("request_hash", request_hash(F.col("request")))
    # Every step starts from these rows, so they are dealt to all tasks, not to a few by their size.
    hashed = cut(hashed.repartition(shuffle_partitions(hashed.sparkSession), "seq"))
    order = F.struct(*ORDER)
    used = cut(
        narrowed(tables("write_keys"), "key", hashed, "key").select(
            "key", F.col("operation").alias("used_op"), F.col("request_hash").alias("used_hash")
        )
    )
    free = hashed.join(used, "key", "left_anti")
    again = free.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    repeats = not again.isEmpty()
    # Hashes and requests are for replays; rules look at the arguments.
    running, before = free.drop("request", "request_hash"), None
    asked = running
    present = {r["op"] for r in free.filter(F.col("op").isin(*OPS)).select("op").distinct().collect()}
    made = old_names = None
    if present & set(MAKES) or _has_names(free):
        old_names = cut(earlier_names(free, tables("write_keys")))
        made = hoped(asked, tables, old_names)
    while True:
        judged = cut(judge(running, tables, present, made, old_names))
        as_assumed = True
        if made is not None:
            names = made.select(*old_names.columns).unionByName(old_names)
            now = written(makings(running, judged, names), "made")
            other = now.exceptAll(made).unionByName(made.exceptAll(now)).select("what", "ref")
            keys = named_keys(asked)
            as_assumed = keys is None or other.join(keys, ["what", "ref"], "left_semi").isEmpty()
            made = now
        if not repeats:
            if as_assumed:
                break
            continue
        first = written(
            judged.filter(F.col("outcome") == APPLIED)
            .join(again, "key", "left_semi")
            .groupBy("key")
            .agg(F.min(order).alias("first"), F.max(order).alias("last")),
            "first",
        )
        lost = before is not None and not before.join(first, "key", "left_anti").isEmpty()
        if as_assumed and not lost and first.filter("last > first").isEmpty():
            judged = _up_to(judged, first, order)
            break
        before = first
        running = _up_to(asked, first, order)
    applied = judged.filter(F.col("outcome") == APPLIED).join(
        hashed.select("seq", "op", "request_hash"), "seq"
    )
    owners = used.unionByName(
        applied.select("key", F.col("op").alias("used_op"), F.col("request_hash").alias("used_hash"))
    )
    late = (
        hashed.join(judged.select("seq"), "seq", "left_anti")
        .join(owners, "key")
        .withColumn(
            "outcome",
            F.when(
                (F.col("op") == F.col("used_op")) & (F.col("request_hash") == F.col("used_hash")),
                REPLAYED,
            ).otherwise(CONFLICT),
        )
        .select(
            "key",
            *ORDER,
            "op",
            "request_hash",
            "outcome",
            F.when(F.col("outcome") == CONFLICT, KEY_REUSED).alias("reason"),
            F.lit(None).cast("bigint").alias("new_revision"),
            F.lit(None).cast("bigint").alias("made_id"),
        )
    )
    judged = judged.join(hashed.select("seq", "op", "request_hash"), "seq")
    if made is not None:
        judged = judged.join(numbered(made, tables), "id", "left")
    else:
        judged = judged.withColumn("made_id", F.col("id"))
    return judged.select(*late.columns).unionByName(late)


def _up_to(rows: DataFrame, first: DataFrame, order: Column) -> DataFrame:
    """Rows of commands up to the first applied one of their key."""
    met = rows.join(first.select("key", "first"), "key", "left")
    return met.filter(F.col("first").isNull() | (order <= F.col("first"))).select(*rows.columns)


def _has_names(commands: DataFrame) -> bool:
    refs = [F.col(c).isNotNull() for c in commands.columns if c.endswith(("_ref", "_refs"))]
    return bool(refs) and not commands.filter(F.greatest(*[r.cast("int") for r in [*refs, refs[0]]]) == 1).isEmpty()


def numbered(made: DataFrame, tables: Tables) -> DataFrame:
    """(id, made_id): the next ids of their tables for what has a provisional one, in command order."""
    out = made.filter(F.col("id") < PROVISIONAL).select("id", F.col("id").alias("made_id"))
    for what, table in (("scope", "scopes"), ("label", "labels"), ("record", "records")):
        fresh = made.filter((F.col("what") == what) & (F.col("id") >= PROVISIONAL))
        firsts = fresh.groupBy("id").agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"))
        last = tables(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        out = out.unionByName(allocate_ids(firsts, ORDER, last, "made_id").select("id", "made_id"))
    return cut(out.distinct())


def batch_rows(commands: DataFrame, outcomes: DataFrame, tables: Tables) -> dict[str, DataFrame]:
    """Rows that a judged batch adds to the tables, and ``records`` as they are then.

    Rows of new records come as ``new_records`` too. Revise commands that bring no payload revise
    nothing but the title: the new revision keeps the payload of the one before.
    """
    outcomes = cut(outcomes)
    won = outcomes.filter(F.col("outcome") == APPLIED)
    creates = not won.filter(F.col("op").isin(*MAKES)).isEmpty()
    if creates or _has_names(commands):
        names = won.filter(F.col("op").isin(*MAKES)).select(
            what_of().alias("what"), F.col("key").alias("ref"), *ORDER, F.col("made_id").alias("id")
        )
        names = names.unionByName(earlier_names(commands, tables("write_keys")))
        commands = cut(with_named(commands, names))

    def of(*ops: str) -> tuple[DataFrame, DataFrame]:
        return commands.filter(F.col("op").isin(*ops)), outcomes.filter(F.col("op").isin(*ops))

    def last(table: str) -> int:
        return tables(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    rows: dict[str, DataFrame] = {}
    new, endings = _creations(commands, won, tables, rows) if creates else ({}, [])

    def more(table: str, own: DataFrame, *others: DataFrame) -> DataFrame:
        for other in others:
            own = own.unionByName(other, allowMissingColumns=True)
        return cut(own)

    revise, judged = of("revise_record")
    revisions, sources = ledger_rows.new_revisions(revise, judged)
    rows["record_revisions"] = more("record_revisions", revisions, *([new["revisions"]] if new else []))
    rows["source_references"] = more("source_references", sources, *([new["sources"]] if new else []))
    asked, judged = of(*LABEL_OPS)
    made = cut(ledger_rows.new_assertions(asked, judged, last("label_assertions"), new.get("assertions")))
    standing = views.latest_active_assertion(tables("label_assertions"), tables("label_retractions"))
    rows["label_assertions"] = made.withColumns(
        {
            "created_at": F.col("ts"),
            "idempotency_key": F.concat_ws(":", "key", F.lit("label"), "label_id"),
        }
    )
    rows["label_retractions"] = ledger_rows.new_label_retractions(asked, judged, made, standing)
    asked, judged = of("add_relation")
    of_endings = None
    for part in endings:
        edges = part["edges"]
        of_endings = edges if of_endings is None else of_endings.unionByName(edges)
    edges = cut(ledger_rows.new_relations(asked, judged, last("record_relations"), of_endings))
    rows["record_relations"] = edges
    asked, judged = of("retract_relation")
    rows["relation_retractions"] = ledger_rows.new_relation_retractions(asked, judged)
    asked, judged = of("transition_record")
    transitions = more(
        "lifecycle_transitions",
        ledger_rows.new_transitions(asked, judged),
        *[part["transitions"] for part in endings],
        *([new["transitions"]] if new else []),
    )
    rows["lifecycle_transitions"] = transitions
    records = tables("records")
    if new:
        rows["new_records"] = new["records"]
        records = records.unionByName(new["records"], allowMissingColumns=True).select(*records.columns)
    rows["records"] = ledger_rows.updated_records(records, rows["record_revisions"], transitions)
    made_edges = edges.select("seq", F.col("id").alias("edge_id")).join(
        commands.filter("op = 'add_relation'").select("seq"), "seq", "left_semi"
    )
    result = F.when(F.col("op") == "add_relation", F.col("edge_id")).when(
        F.col("op") == "retract_relation", F.col("relation_id")
    )
    rows["write_keys"] = (
        won.select("seq", "key", F.col("op").alias("operation"), "op", "request_hash", "made_id")
        .join(commands.select("seq", "record_id", "relation_id"), "seq")
        .join(made_edges, "seq", "left")
        .select(
            "key", "operation", "request_hash", F.coalesce("made_id", result, "record_id").alias("result_id")
        )
    )
    return rows


def _creations(
    commands: DataFrame, won: DataFrame, tables: Tables, rows: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], list[dict[str, DataFrame]]]:
    """Rows of new records (see ``commands.fan_out``), edges and transitions of those they replace.

    New scopes, labels and aliases go into ``rows``.
    """
    made = with_arguments(commands).join(won.select("seq", "made_id"), "seq")
    makers = cut(made.filter(F.col("op").isin(*RECORD_MAKERS)))
    new = fan_out(makers.withColumns({"record_id": F.col("made_id"), "title": utrim(F.col("title"))}))
    new = {name: cut(part) for name, part in new.items()}
    replacing = ends_of(makers).withColumn("new_id", F.col("made_id"))
    endings = [
        _ending_rows(replacing.filter("op = 'supersede_record'"), "superseded", "supersedes", into=False),
        _ending_rows(replacing.filter("op = 'merge_records'"), "merged", "merged_into", into=True),
    ]

    def first_of(op: str, table: str) -> DataFrame:
        """The commands that made something, not those that found it there."""
        asked = made.filter(F.col("op") == op)
        there = tables(table).select(F.col("id").alias("made_id"))
        first = asked.join(there, "made_id", "left_anti").groupBy("made_id").agg(F.min(F.struct(*ORDER))["seq"].alias("seq"))
        return asked.join(first.select("seq"), "seq", "left_semi")

    scopes, labels = first_of("create_scope", "scopes"), first_of("create_label", "labels")
    provenance = [F.col("ts").alias("created_at"), *who(made), F.col("key").alias("idempotency_key")]
    rows["scopes"] = scopes.select(F.col("made_id").alias("id"), quality.scope_name(F.col("name")).alias("name"), *provenance)
    rows["labels"] = labels.select(
        F.col("made_id").alias("id"),
        utrim(F.col("facet")).alias("facet"),
        utrim(F.col("label_key")).alias("key"),
        utrim(F.col("display_name")).alias("display_name"),
        F.lit(True).alias("active"),
        *provenance,
    )
    held = tables("label_aliases").select(F.lower("alias").alias("alias")).distinct()
    rows["label_aliases"] = (
        made.filter("op = 'create_label'")
        .select(F.col("made_id").alias("label_id"), F.explode(quality.canonical_aliases(F.col("aliases"))).alias("alias"))
        .distinct()
        .join(held, "alias", "left_anti")
    )
    return new, endings


def next_ledger(commands: DataFrame, outcomes: DataFrame, tables: Tables) -> dict[str, DataFrame]:
    """Whole tables after the batch; those that no command changes are left out."""
    added = batch_rows(commands, outcomes, tables)
    out = {"records": added.pop("records")}
    added.pop("new_records", None)
    for name, rows in added.items():
        out[name] = tables(name).unionByName(rows, allowMissingColumns=True).select(*tables(name).columns)
    return out
