"""Named queries: commands applied to the ledger, quality rules, legacy import, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fences import fence_scan
from tessera.functions.text import trim_option
from tessera.limits import BUDGET_DEFAULT
from tessera.operators import batch
from tessera.operators import commands as cmd
from tessera.operators import ledger_rows as rows_of
from tessera.operators import legacy, ordering, quality, views
from tessera.plans.registry import QUERIES, assertions, big, query
from tessera.plans.catalog_recall import letter_model, letter_vectors
from tessera.schemas import PAYLOAD, SOURCE
from tessera.session import new_folder, written
from tessera.sources import corpus
from tessera.streaming.intake import CommandIntake, VectorSync


def issued(spark, sf_dir, *ops: str) -> DataFrame:
    rows = corpus.commands(spark, sf_dir, corpus.n_documents(spark, sf_dir))
    return rows.filter(F.col("op").isin(*ops)) if ops else rows


def edges(store):
    return store.read("record_relations"), store.read("relation_retractions")


# Ledger application


@query
def idempotent_intake(spark, sf_dir):
    n = corpus.n_documents(spark, sf_dir)
    judged = cmd.idempotent_intake(
        corpus.delivered_commands(spark, sf_dir, n), corpus.ledger(spark, sf_dir).read("write_keys")
    )
    return judged.select("key", "seq", "outcome", "reason")


@query
def new_write_keys(spark, sf_dir):
    """Key ledger rows a batch adds, pointing at the record of the command."""
    n = corpus.n_documents(spark, sf_dir)
    judged = cmd.idempotent_intake(
        corpus.delivered_commands(spark, sf_dir, n), corpus.ledger(spark, sf_dir).read("write_keys")
    )
    result = corpus.commands(spark, sf_dir, n).select("key", F.col("record_id").alias("result_id"))
    return cmd.new_write_keys(judged, result)


@query
def command_guards(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    guarded = cmd.command_guards(
        issued(spark, sf_dir), store.read("records"), store.read("labels"),
        store.read("record_relations"),
    )
    return guarded.select("key", "record_kind", "current_revision", "lifecycle", "guard")


@query
def derived_keys(spark, sf_dir):
    keys = cmd.derived_keys(
        F.col("key"), F.col("record_id"), F.col("label_id"), F.col("record_id"),
        F.col("target_record_id"), F.col("relation_kind"),
    )
    return issued(spark, sf_dir).select("key", *[c.alias(k) for k, c in keys.items()])


@query
def id_allocation(spark, sf_dir):
    """Ids of all commands in order, above the largest record id."""
    start = corpus.ledger(spark, sf_dir).read("records").agg(F.max("id")).first()[0]
    rows = issued(spark, sf_dir).select("key", "ts", "seq")
    return ordering.allocate_ids(rows, ["ts", "seq"], start).select("key", "id")


def scope_commands(spark, sf_dir) -> DataFrame:
    """Customers ask for a scope named after their segment, suppliers for ``Global``."""
    segment, n = F.col("c_mktsegment"), F.col("c_nationkey") % 4
    customers = corpus.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("key"),
        F.col("c_custkey").alias("seq"),
        F.when(n == 0, F.upper(segment))
        .when(n == 1, F.lower(segment))
        .when(n == 2, F.concat(F.lit("  "), segment, F.lit("\t")))
        .otherwise(F.lit(" \n "))
        .alias("name"),
    )
    suppliers = corpus.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("key"),
        (F.col("s_suppkey") + 100_000_000).alias("seq"),
        F.lit("Global").alias("name"),
    )
    return customers.unionByName(suppliers).withColumn(
        "ts", F.lit(corpus.EPOCH).cast("timestamp_ntz")
    )


@query
def apply_create_scope(spark, sf_dir):
    scopes = corpus.ledger(spark, sf_dir).read("scopes")
    _, outcomes = cmd.apply_create_scope(scope_commands(spark, sf_dir), scopes)
    return outcomes.select("key", "outcome", "reason", "result_id", "created")


@query
def created_scopes(spark, sf_dir):
    scopes = corpus.ledger(spark, sf_dir).read("scopes")
    created, _ = cmd.apply_create_scope(scope_commands(spark, sf_dir), scopes)
    return created.select("id", "name", "key")


def label_commands(spark, sf_dir) -> DataFrame:
    """Customers ask for a label named after their segment, with their nation as its alias."""
    return corpus.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("key"),
        F.col("c_custkey").alias("seq"),
        F.lit(corpus.EPOCH).cast("timestamp_ntz").alias("ts"),
        F.lit("segment").alias("facet"),
        F.lower("c_mktsegment").alias("label_key"),
        F.col("c_mktsegment").alias("display_name"),
        F.array(F.concat(F.lit(" Nation-"), "c_nationkey")).alias("aliases"),
    )


@query
def apply_create_label(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    _, _, outcomes = cmd.apply_create_label(
        label_commands(spark, sf_dir), store.read("labels"), store.read("label_aliases")
    )
    return outcomes.select("key", "outcome")


@query
def created_label_aliases(spark, sf_dir):
    """Aliases of the new labels after the batch."""
    store = corpus.ledger(spark, sf_dir)
    labels, aliases, _ = cmd.apply_create_label(
        label_commands(spark, sf_dir), store.read("labels"), store.read("label_aliases")
    )
    return aliases.join(labels.withColumnRenamed("id", "label_id"), "label_id").select(
        "key", "alias", "display_name"
    )


def create_commands(spark, sf_dir) -> DataFrame:
    """Every document as a create command. Graded ones bring no label; a title is the source
    and id; scopes of German documents do not exist."""
    docs = corpus._docs(spark, sf_dir).join(
        corpus.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    source = F.struct(
        F.concat(F.lit("id "), F.col("doc_id")).alias("identity"),
        F.concat(F.lit("file:///"), "source").alias("locator"),
        F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("anchor"),
        F.lit(None).cast("string").alias("quote"),
    )
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("key"),
        F.lit(corpus.EPOCH).cast("timestamp_ntz").alias("ts"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("lang") == "de", 100_000).otherwise(corpus.scope_id(F.col("source")))
        .cast("bigint").alias("scope_id"),
        F.concat(F.lit(" "), "source", F.lit(" "), "doc_id").alias("title"),
        corpus.payload_of(F.col("text")).alias("payload"),
        F.when(F.col("n_chars") > 300, F.array(source)).otherwise(
            F.array().cast("array<struct<identity:string,locator:string,version:string,"
                           "content_hash:string,anchor:string,quote:string>>")
        ).alias("sources"),
        F.when(F.col("quality") == 0, F.array().cast("array<bigint>"))
        .when(F.col("quality") == 1, F.array(F.lit(3), F.lit(3)).cast("array<bigint>"))
        .otherwise(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
        .alias("label_ids"),
    )


def _created(spark, sf_dir) -> dict[str, DataFrame]:
    store = corpus.ledger(spark, sf_dir)
    start = store.read("records").agg(F.max("id")).first()[0]
    return cmd.apply_create_record(
        create_commands(spark, sf_dir), store.read("scopes"), store.read("labels"), start
    )


@query
def apply_create_record(spark, sf_dir):
    return _created(spark, sf_dir)["outcomes"].select("key", "outcome", "reason", "result_id")


@query
def created_rows(spark, sf_dir):
    """Rows that the create commands add, by table."""
    made = _created(spark, sf_dir)
    keyed = [
        made["records"].select(F.lit("record").alias("part"), F.col("id").alias("record_id"),
                               F.concat_ws("|", "kind", "title", "idempotency_key").alias("row")),
        made["sources"].select(F.lit("source").alias("part"), "record_id",
                               F.concat_ws("|", "position", "identity", "locator",
                                           F.coalesce("content_hash", F.lit("-"))).alias("row")),
        made["assertions"].select(F.lit("label").alias("part"), "record_id",
                                  F.concat_ws("|", "label_id", "idempotency_key").alias("row")),
        made["transitions"].select(F.lit("state").alias("part"), "record_id",
                                   F.concat_ws("|", "to_state", "idempotency_key").alias("row")),
    ]
    rows = keyed[0]
    for more in keyed[1:]:
        rows = rows.unionByName(more)
    return rows


@query
def apply_revise(spark, sf_dir):
    """Revise commands against records that all start at revision 1."""
    records = corpus.ledger(spark, sf_dir).read("records").withColumn(
        "current_revision", F.lit(1).cast("bigint")
    )
    return cmd.apply_revise(issued(spark, sf_dir, "revise_record"), records).select(
        "key", "record_id", "outcome", "reason", "new_revision"
    )


def _label_outcomes(spark, sf_dir) -> DataFrame:
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_labels(
        issued(spark, sf_dir, "add_label", "retract_label"),
        store.read("records"),
        store.read("labels"),
        views.active_assertions(*assertions(store)),
    )


@query
def apply_add_label(spark, sf_dir):
    """Outcome of the add commands when adds and retractions run in order."""
    return _label_outcomes(spark, sf_dir).filter("op = 'add_label'").select("key", "outcome", "reason")


@query
def apply_retract_label(spark, sf_dir):
    return _label_outcomes(spark, sf_dir).filter("op = 'retract_label'").select(
        "key", "outcome", "reason"
    )


@query
def apply_last_label(spark, sf_dir):
    """The same commands on records that have nothing but the inbox label yet."""
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_labels(
        issued(spark, sf_dir, "add_label", "retract_label"),
        store.read("records"),
        store.read("labels"),
        store.read("label_assertions").filter("label_id = 1"),
    ).select("key", "outcome", "reason")


@query
def label_ledger_rows(spark, sf_dir):
    """Assertions and retractions that the label commands add."""
    store = corpus.ledger(spark, sf_dir)
    asked = issued(spark, sf_dir, "add_label", "retract_label")
    outcomes = _label_outcomes(spark, sf_dir)
    start = store.read("label_assertions").agg(F.max("id")).first()[0]
    made = rows_of.new_assertions(asked, outcomes, start)
    standing = views.latest_active_assertion(*assertions(store))
    ended = rows_of.new_label_retractions(asked, outcomes, made, standing)
    return made.select(
        F.lit("assertion").alias("part"), F.col("id").alias("assertion_id"), "key"
    ).unionByName(
        ended.select(F.lit("retraction").alias("part"), "assertion_id",
                     F.col("idempotency_key").alias("key"))
    )


@query
def revision_ledger_rows(spark, sf_dir):
    """Revisions that the revise commands add, and the record rows afterwards."""
    store = corpus.ledger(spark, sf_dir)
    records = store.read("records").withColumn("current_revision", F.lit(1).cast("bigint"))
    asked = issued(spark, sf_dir, "revise_record")
    outcomes = cmd.apply_revise(asked, records)
    first = store.read("record_revisions").filter("revision = 1").select("record_id", "payload")
    full = asked.join(first, "record_id").withColumns(
        {
            "title": F.concat(F.lit(" by "), "actor"),
            "sources": F.array(F.struct(F.col("actor").alias("identity"),
                                        *[F.lit(None).cast("string").alias(c) for c in
                                          ("locator", "version", "content_hash", "anchor", "quote")])),
        }
    )
    revisions, sources = rows_of.new_revisions(full, outcomes)
    after = rows_of.updated_records(records, revisions)
    return (
        revisions.select(F.lit("revision").alias("part"), "record_id", "revision",
                         F.concat_ws("|", "title", "idempotency_key").alias("row"))
        .unionByName(sources.select(F.lit("source"), "record_id", "revision",
                                    F.concat_ws("|", "position", "identity")).toDF(
            "part", "record_id", "revision", "row"))
        .unionByName(after.select(F.lit("record").alias("part"), F.col("id").alias("record_id"),
                                  F.col("current_revision").alias("revision"),
                                  F.col("title").alias("row")))
    )


@query
def relation_ledger_rows(spark, sf_dir):
    """Edges that the add commands add, and retractions of edges."""
    store = corpus.ledger(spark, sf_dir)
    add, end = issued(spark, sf_dir, "add_relation"), issued(spark, sf_dir, "retract_relation")
    start = store.read("record_relations").agg(F.max("id")).first()[0]
    made = rows_of.new_relations(
        add, cmd.apply_add_relation(add, store.read("records"), *edges(store)), start
    )
    ended = rows_of.new_relation_retractions(
        end, cmd.apply_retract_relation(end, store.read("records"), *edges(store))
    )
    return made.select(F.lit("edge").alias("part"), "id", "idempotency_key").unionByName(
        ended.select(F.lit("end").alias("part"), F.col("relation_id").alias("id"), "idempotency_key")
    )


@query
def transition_ledger_rows(spark, sf_dir):
    """Transitions that the commands add to active records, and the record rows afterwards."""
    records = corpus.ledger(spark, sf_dir).read("records").withColumn("lifecycle", F.lit("active"))
    asked = issued(spark, sf_dir, "transition_record")
    made = rows_of.new_transitions(asked, cmd.apply_transition(asked, records))
    after = rows_of.updated_records(records, transitions=made)
    return made.select(
        F.lit("transition").alias("part"), "record_id", F.col("idempotency_key").alias("row")
    ).unionByName(
        after.select(F.lit("record").alias("part"), F.col("id").alias("record_id"),
                     F.col("lifecycle").alias("row"))
    )


@query
def apply_add_relation(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_add_relation(
        issued(spark, sf_dir, "add_relation"), store.read("records"), *edges(store)
    ).select("key", "outcome", "reason")


@query
def apply_retract_relation(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_retract_relation(
        issued(spark, sf_dir, "retract_relation"), store.read("records"), *edges(store)
    ).select("key", "outcome", "reason")


@query
def apply_transition(spark, sf_dir):
    records = corpus.ledger(spark, sf_dir).read("records").withColumn("lifecycle", F.lit("active"))
    return cmd.apply_transition(issued(spark, sf_dir, "transition_record"), records).select(
        "key", "outcome", "reason"
    )


def turn_commands(spark, sf_dir) -> DataFrame:
    """One command per conversation turn, on a record the turn points at."""
    n = corpus.n_documents(spark, sf_dir)
    turns = corpus.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("key"),
        F.lit(corpus.EPOCH).cast("timestamp_ntz").alias("ts"),
        "conv_id",
        "turn",
        ((F.col("conv_id") * 3 + F.col("turn") * 5) % n + 1).alias("record_id"),
    )
    return ordering.allocate_ids(turns, ["conv_id", "turn"], 0, "seq").drop("turn")


def _next_id(store) -> int:
    return store.read("records").agg(F.max("id")).first()[0]


def _supersede(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_supersede(turn_commands(spark, sf_dir), store.read("records"), _next_id(store))


@query
def apply_supersede(spark, sf_dir):
    return _supersede(spark, sf_dir)["outcomes"].select("key", "outcome", "reason", "result_id")


@query
def superseded_edges(spark, sf_dir):
    return _supersede(spark, sf_dir)["edges"].select(
        "source_record_id", "target_record_id", "kind", "idempotency_key"
    )


def merge_commands(spark, sf_dir) -> DataFrame:
    """Each conversation merges the records that its turns point at."""
    return (
        turn_commands(spark, sf_dir)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"), F.min("ts").alias("ts"))
        .select(
            F.concat(F.lit("m"), "conv_id").alias("key"), "ts", F.col("conv_id").alias("seq"),
            "record_ids",
        )
    )


def _merge(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return cmd.apply_merge(merge_commands(spark, sf_dir), store.read("records"), _next_id(store))


@query
def apply_merge(spark, sf_dir):
    return _merge(spark, sf_dir)["outcomes"].select("key", "outcome", "reason", "result_id")


@query
def merged_transitions(spark, sf_dir):
    return _merge(spark, sf_dir)["transitions"].select(
        "record_id", "from_state", "to_state", "idempotency_key"
    )


# Quality rules


@query
def validate_records(spark, sf_dir):
    c = create_commands(spark, sf_dir)
    title = F.when(F.col("seq") % 2 == 0, F.col("title")).otherwise(F.col("payload.body"))
    return c.select(
        "key",
        quality.record(F.col("scope_id"), title, F.col("label_ids"), F.col("payload"),
                       F.col("sources")).alias("error"),
    )


@query
def validate_payload(spark, sf_dir):
    """Payloads of all revisions with the sources of the first one."""
    store = corpus.ledger(spark, sf_dir)
    sources = store.read("source_references").groupBy("record_id", "revision").agg(
        F.array_sort(F.collect_list(F.struct("position", "identity", "locator", "version",
                                             "content_hash", "anchor", "quote"))).alias("sources")
    )
    rows = store.read("record_revisions").join(sources, ["record_id", "revision"], "left")
    return rows.select(
        "record_id", "revision", quality.payload(F.col("payload"), F.col("sources")).alias("error")
    )


@query
def validate_source(spark, sf_dir):
    """Pages as sources: the URL identifies, the whole page is the quote."""
    s = F.struct(
        F.when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(F.col("url")).alias("identity"),
        F.when(F.col("page_id") % 3 == 1, F.col("html")).alias("locator"),
        F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("anchor"),
        F.col("html").alias("quote"),
    )
    return corpus.table(spark, sf_dir, "pages").select("page_id", quality.source(s).alias("error"))


@query
def validate_text(spark, sf_dir):
    """Texts as they are, blanked out, and inside an unclosed block."""
    text = F.col("text")
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id",
        quality.text("body", text).alias("as_is"),
        quality.text("body", F.regexp_replace(text, r"\S", " ")).alias("blanked"),
        quality.text("body", F.concat(F.lit("```mermaid\n"), text)).alias("unclosed"),
    )


@query
def validate_single_line(spark, sf_dir):
    talk = corpus.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("item"), "text"
    )
    bench = corpus.table(spark, sf_dir, "benchmark").select(
        F.concat_ws(":", F.lit("b"), "item_id").alias("item"), "text"
    )
    urls = corpus.table(spark, sf_dir, "pages").select(
        F.concat_ws(":", F.lit("p"), "page_id").alias("item"), F.concat(F.lit("\n"), "url").alias("text")
    )
    return talk.unionByName(bench).unionByName(urls).select(
        "item", quality.single_line("title", F.col("text"), 200).alias("error")
    )


@query
def validate_label_part(spark, sf_dir):
    parts = corpus.table(spark, sf_dir, "part")
    values = (
        parts.select(F.col("p_brand").alias("value"))
        .union(parts.select(F.lower("p_type")))
        .union(parts.select(F.lower(F.regexp_replace("p_brand", "#", "-"))))
        .union(corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), "source")))
        .union(corpus.table(spark, sf_dir, "nation").select("n_name"))
        .union(corpus.table(spark, sf_dir, "benchmark").select("text"))
        .distinct()
    )
    return values.select("value", quality.label_part("facet", F.col("value")).alias("error"))


@query
def canonical_aliases(spark, sf_dir):
    raw = F.array(F.concat(F.lit(" "), "p_type"), F.upper("p_brand"), "p_brand", F.lower("p_type"))
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(quality.canonical_aliases(raw), "|").alias("aliases")
    )


@query
def validate_context(spark, sf_dir):
    talk = corpus.table(spark, sf_dir, "conversations")
    error = quality.context(
        F.when(F.col("turn") == 0, F.lit("")).otherwise(F.concat_ws("-", "conv_id", "turn")),
        F.col("text"),
        F.col("role"),
        F.lit("client"),
    )
    return talk.select("conv_id", "turn", error.alias("error"))


@query
def validate_timestamp(spark, sf_dir):
    """Event times written in five ways."""
    day, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSS")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(day, F.lit("T"), time, F.lit("Z")))
        .when(kind == "click", F.concat(day, F.lit("T"), time, F.lit("+02:00")))
        .when(kind == "error", F.concat(day, F.lit("T"), time))
        .when(kind == "signup", F.lit("yesterday"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-"), F.lit("13-01T"), time, F.lit("Z")))
    )
    return corpus.table(spark, sf_dir, "events").select(
        "event_id",
        quality.timestamp_error("observed_at", text).alias("error"),
        F.unix_millis(quality.timestamp(text)).alias("millis"),
    )


@query
def validate_query(spark, sf_dir):
    """Whole benchmark texts as queries, with page sizes and budgets in and out of range."""
    i = F.col("item_id")
    error = quality.query(F.col("text"), (i + 20) % 60, i % 3, i * 500 + BUDGET_DEFAULT)
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", error.alias("error"))


@query
def trim_option_(spark, sf_dir):
    padded = F.when(F.col("turn") % 3 == 0, F.lit(" \t\n")).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("\n "), "text", F.lit(" "))
    )
    return corpus.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", trim_option(padded).alias("value")
    )


QUERIES["trim_option"] = QUERIES.pop("trim_option_")


# Links, blocks, legacy import


def legacy_documents(spark, sf_dir) -> DataFrame:
    """Documents as old notes; each links to two others, some hidden and some that never were."""
    n = corpus.n_documents(spark, sf_dir)
    docs = corpus.table(spark, sf_dir, "documents")
    hidden = corpus.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "toxic")
    id_ = F.col("doc_id") + 1
    first, second = (id_ * 7 + 3) % (n + 20) + 1, (id_ * 5) % n + 1

    def link(target):
        return F.concat(F.lit(" [[note:"), target.cast("string"), F.lit("|see it]]"))

    return docs.join(hidden, "doc_id", "left").select(
        id_.alias("id"),
        F.when(F.col("lang") == "en", "note").otherwise("artifact").alias("kind"),
        F.when(F.col("toxic").isNull(), "shared").otherwise("private").alias("visibility"),
        F.when(F.col("lang") == "fr", "agent").otherwise("user").alias("author"),
        F.lit("2026-01-01").alias("day"),
        F.lit("2026-01-01T08:00:00Z").alias("created_at"),
        F.lit("2026-01-02T08:00:00Z").alias("updated_at"),
        F.concat(link(first), F.lit(" "), "text", link(second), link(first), F.lit(" [[note:0|x]]."))
        .alias("body"),
        F.lit(1).cast("bigint").alias("revision"),
    )


@query
def link_extract(spark, sf_dir):
    return legacy.link_extract(legacy_documents(spark, sf_dir)).select(
        "id", big("position").alias("position"), "target_id"
    )


@query
def link_redact(spark, sf_dir):
    docs = legacy_documents(spark, sf_dir)
    return legacy.link_redact(
        docs.select(F.col("id").alias("record_id"), "body"), docs.filter("visibility = 'shared'")
    )


@query
def visible_revisions(spark, sf_dir):
    """Imported notes as readers see them: links to private notes are gone."""
    made = legacy.legacy_import(legacy_documents(spark, sf_dir), 1, 1)
    shown = legacy.visible_revisions(made["records"], made["revisions"])
    return shown.select("record_id", F.col("payload.body").alias("body"))


@query
def legacy_relations(spark, sf_dir):
    return legacy.legacy_relations(legacy_documents(spark, sf_dir))


@query
def imported_title(spark, sf_dir):
    return legacy_documents(spark, sf_dir).select(
        "id", legacy.imported_title(F.col("kind"), F.col("id")).alias("title")
    )


@query
def import_metadata(spark, sf_dir):
    return legacy_documents(spark, sf_dir).select("id", legacy.import_metadata().alias("metadata"))


@query
def legacy_import(spark, sf_dir):
    """Rows of the five tables that an import writes."""
    made = legacy.legacy_import(legacy_documents(spark, sf_dir), 1, 1)
    parts = [
        made["records"].select(F.lit("record").alias("part"), "id", F.concat_ws(
            "|", "title", "kind", F.col("readable").cast("string"), "idempotency_key").alias("row")),
        made["revisions"].select(F.lit("revision").alias("part"), F.col("record_id").alias("id"),
                                 F.col("payload.body").alias("row")),
        made["assertions"].select(F.lit("label").alias("part"), F.col("record_id").alias("id"),
                                  F.col("idempotency_key").alias("row")),
        made["transitions"].select(F.lit("state").alias("part"), F.col("record_id").alias("id"),
                                   F.col("idempotency_key").alias("row")),
        made["relations"].select(F.lit("edge").alias("part"), F.col("source_record_id").alias("id"),
                                 F.col("idempotency_key").alias("row")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def legacy_entries(spark, sf_dir) -> DataFrame:
    """Events as daily entries; cheap ones are blank."""
    return corpus.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("created_at"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm").alias("updated_at"),
        F.when(F.col("value") < 10, "").otherwise(F.col("props")).alias("body"),
    )


@query
def legacy_day_rollup(spark, sf_dir):
    days, _ = legacy.legacy_day_rollup(legacy_entries(spark, sf_dir))
    return days.select("id", "day", "created_at", "updated_at")


@query
def legacy_day_rollup_parts(spark, sf_dir):
    """The bodies of the days, part by part."""
    _, parts = legacy.legacy_day_rollup(legacy_entries(spark, sf_dir))
    return parts.select("day", "position", "entry_id", "body")


@query
def legacy_defaults(spark, sf_dir):
    rolled, _ = legacy.legacy_day_rollup(legacy_entries(spark, sf_dir))
    return legacy.legacy_defaults(rolled).select(
        "id", "day", "visibility", "author", big("revision").alias("revision")
    )


@query
def daily_conflicts(spark, sf_dir):
    """Days with more than one entry, were entries daily notes already."""
    rows = legacy_entries(spark, sf_dir).withColumn("kind", F.lit("daily"))
    return legacy.days_with_two_dailies(rows)


@query
def fence_scan_(spark, sf_dir):
    """Documents wrapped in two tagged blocks; the second stays open in German texts."""
    text = F.concat(
        F.lit("~~~~ Mermaid x\n"), "text", F.lit("\n~~~\n~~~~~ \n```js\n~~~\n```\n   ```mermaid\n"), "text",
        F.when(F.col("lang") == "de", "\n    ```").otherwise("\n```"),
    )
    return (
        corpus.table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(fence_scan(text)).alias("block", "b"))
        .select(
            "doc_id",
            (F.col("block") + 1).cast("bigint").alias("block"),
            big("b.first_line").alias("first_line"),
            big("b.last_line").alias("last_line"),
            "b.closed",
        )
    )


QUERIES["fence_scan"] = QUERIES.pop("fence_scan_")


# Whole batches


def _batch(spark, sf_dir):
    """(delivered commands of all operations, tables before): records are active at revision 1,
    and a third of the revise commands has used its key already."""
    n = corpus.n_documents(spark, sf_dir)
    store = corpus.ledger(spark, sf_dir)
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")

    def tables(name: str) -> DataFrame:
        rows = store.read(name)
        if name == "records":
            return rows.withColumns(
                {"lifecycle": F.lit("active"), "current_revision": F.lit(1).cast("bigint")}
            )
        return rows.filter(number % 3 == 0) if name == "write_keys" else rows

    return corpus.delivered_commands(spark, sf_dir, n), tables


@query
def apply_batch(spark, sf_dir):
    """All delivered commands, mixed, in one order."""
    commands, tables = _batch(spark, sf_dir)
    return batch.apply_batch(commands, tables).select(
        "key", "seq", "outcome", "reason", "new_revision"
    )


def creating_commands(spark, sf_dir) -> DataFrame:
    """Per customer: a scope for the nation, a record in it, and commands that name these by key.

    Some records are superseded and then transitioned, some get a label, some are merged with the
    one before. Some commands name a record that comes later, some have no operation.
    """
    people = corpus.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).cast("bigint").alias("k"), "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
    )
    people = people.join(corpus.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    k, own = F.col("k"), F.concat(F.lit("r"), "k")
    steps = [("s", "create_scope", F.lit(True)), ("r", "create_record", F.lit(True)), ("x", "supersede_record", k % 3 == 0),
             ("t", "transition_record", k % 6 == 0), ("a", "add_label", k % 5 == 0), ("m", "merge_records", k % 7 == 0),
             ("z", None, k % 11 == 0), ("f", "add_label", k % 13 == 0)]
    asked = F.array(
        *[
            F.when(wanted, F.struct(F.lit(i).alias("step"), F.lit(letter).alias("letter"), F.lit(op).cast("string").alias("op")))
            for i, (letter, op, wanted) in enumerate(steps, 1)
        ]
    )
    rows = people.withColumn("asked", F.explode(F.filter(asked, lambda x: x.isNotNull()))).select("*", "asked.*")
    makes = F.col("op").isin(*batch.RECORD_MAKERS)
    named = {f.name: F.lit("note") if f.name == "kind" else F.col("c_mktsegment") if f.name == "body" else F.lit(None) for f in PAYLOAD}
    payload = F.struct(*[named[f.name].cast(f.dataType).alias(f.name) for f in PAYLOAD])
    return rows.select(
        F.concat("letter", "k").alias("key"),
        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        (k * 10 + F.col("step")).alias("seq"),
        "op",
        F.concat_ws(" ", "op", "c_name").alias("request"),
        F.lit(None).cast("bigint").alias("record_id"),
        F.when(F.col("letter") == "f", F.concat(F.lit("r"), k + 1)).when(F.col("letter").isin("x", "t", "a"), own).alias("record_ref"),
        F.when(F.col("letter") == "m", F.array(own, F.concat(F.lit("r"), k - 1))).alias("record_refs"),
        F.when(makes, F.concat(F.lit("s"), "k")).alias("scope_ref"),
        F.when(makes, F.array(F.lit(1).cast("bigint"))).alias("label_ids"),
        F.when(F.col("op") == "add_label", F.lit(2).cast("bigint")).alias("label_id"),
        F.when(F.col("op") == "create_scope", F.col("n_name")).alias("name"),
        F.when(makes, F.col("c_name")).alias("title"),
        F.when(makes, payload).alias("payload"),
        F.array().cast(f"array<{SOURCE.simpleString()}>").alias("sources"),
    )


@query
def creating_batch(spark, sf_dir):
    """A batch that creates scopes and records and goes on with them."""
    store = corpus.ledger(spark, sf_dir)
    outcomes = batch.apply_batch(creating_commands(spark, sf_dir), store.read)
    return outcomes.select("key", "seq", "outcome", "reason", "made_id")


@query
def ledger_after_batch(spark, sf_dir):
    """What the batch writes, table by table, and the records afterwards."""
    commands, tables = _batch(spark, sf_dir)
    commands = written(commands, "delivered")
    outcomes = written(batch.apply_batch(commands, tables), "outcomes")
    first = tables("record_revisions").filter("revision = 1").select("record_id", "payload")
    # Texts go to the commands that write them, not to every command; the others meet the same rows without.
    bare = first.select("record_id")
    revises = F.col("op").eqNullSafe("revise_record")
    won = outcomes.filter(revises & (F.col("outcome") == cmd.APPLIED)).select("seq")
    asked = commands.filter(revises)
    full = (
        asked.join(won, "seq", "left_semi")
        .join(first, "record_id", "left")
        .unionByName(asked.join(won, "seq", "left_anti").join(bare, "record_id", "left"), allowMissingColumns=True)
        .unionByName(commands.filter(~revises).join(bare, "record_id", "left"), allowMissingColumns=True)
    )
    none = F.array().cast(f"array<{SOURCE.simpleString()}>")
    full = full.withColumns({"title": F.concat(F.lit(" by "), "actor"), "sources": none})
    made = batch.batch_rows(full, outcomes, tables)

    def part(name: str, id_: str, *row: str) -> DataFrame:
        return made[name].select(
            F.lit(name).alias("part"), F.col(id_).cast("bigint").alias("id"), F.concat_ws("|", *row).alias("row")
        )

    rows = part("records", "id", "current_revision", "lifecycle", "title")
    for more in (
        part("record_revisions", "record_id", "revision", "title", "actor", "idempotency_key"),
        part("label_assertions", "record_id", "label_id", "actor", "idempotency_key"),
        made["label_retractions"].select(
            F.lit("label_retractions"), F.lit(0).cast("bigint"), F.concat_ws("|", "actor", "idempotency_key")
        ),
        part("record_relations", "id", "source_record_id", "actor", "idempotency_key"),
        part("relation_retractions", "relation_id", "actor", "idempotency_key"),
        part("lifecycle_transitions", "record_id", "to_state", "actor", "idempotency_key"),
        part("write_keys", "result_id", "key", "operation", "request_hash"),
    ):
        rows = rows.union(more)
    return rows


# Streams


@query
def stream_intake(spark, sf_dir):
    """Events as a file stream of commands, judged in four micro-batches in order of time."""
    n = corpus.n_documents(spark, sf_dir)
    store = corpus.ledger(spark, sf_dir)
    root = new_folder(spark, "intake")
    source = f"{root}/commands"
    # Written once: every cut and quarter would join the events anew.
    delivered = written(corpus.delivered_commands(spark, sf_dir, n), "delivered")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = delivered.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    # Commands without a time come first.
    quarter = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    intake = CommandIntake(spark, root, store.read("write_keys"), lambda batch: batch)
    for part in range(len(cuts) + 1):
        delivered.filter(quarter == part).write.mode("append").parquet(source)
        # What has arrived since the last start is one micro-batch, however many files it is.
        stream = spark.readStream.schema(delivered.schema).parquet(source)
        intake.start(stream, f"{root}/checkpoint", available_now=True).awaitTermination()
    return intake.outcomes().select("key", "seq", "outcome", "reason")


@query
def stream_embedding_sync(spark, sf_dir):
    """Revisions as a file stream in at most eight micro-batches; every record ends with a vector
    of its current revision."""
    store = corpus.ledger(spark, sf_dir)
    root = new_folder(spark, "sync")
    revisions = store.read("record_revisions")
    # A batch reads the whole table, so their number must not grow with the number of files.
    files = len(revisions.inputFiles())
    initial = letter_vectors(store)
    sync = VectorSync(
        spark, root, lambda: (store.read("records"), revisions), letter_model, "letters", "v1", 4, initial
    )
    stream = (
        spark.readStream.schema(revisions.schema)
        .option("maxFilesPerTrigger", max(1, -(-files // 8)))
        .parquet(store.path("record_revisions"))
    )
    sync.start(stream, f"{root}/checkpoint", available_now=True).awaitTermination()
    pick = [F.round(F.col("vector")[i].cast("double"), 5).alias(f"v{i}") for i in range(4)]
    return sync.vectors().select("record_id", "revision", *pick)
