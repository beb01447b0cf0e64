"""Current-state views folded from the append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.payload import payload_text
from tessera.limits import GLOBAL_SCOPE
from tessera.operators.legacy import visible_revisions


def readable(records: DataFrame) -> DataFrame:
    return records.filter("readable")


def list_scopes(scopes: DataFrame) -> DataFrame:
    return scopes.orderBy(F.lower("name"), "id")


def active_assertions(assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    """Assertions that no retraction names. The join key is unique on both sides."""
    return assertions.join(
        retractions.select(F.col("assertion_id").alias("id")), "id", "left_anti"
    )


def active_labels(assertions: DataFrame, retractions: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_id, label_id, facet, key, canonical) of active assertions on active labels."""
    named = labels.filter("active").select(
        F.col("id").alias("label_id"), "facet", "key", label_canonical().alias("canonical")
    )
    return (
        active_assertions(assertions, retractions)
        .select("record_id", "label_id")
        .join(named, "label_id")
    )


def label_canonical() -> Column:
    return F.concat_ws(":", "facet", "key")


def active_label_count(assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    return (
        active_assertions(assertions, retractions)
        .groupBy("record_id")
        .agg(F.count("*").alias("active_labels"))
    )


def latest_active_assertion(assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    """Newest assertion in force per (record, label)."""
    return (
        active_assertions(assertions, retractions)
        .groupBy("record_id", "label_id")
        .agg(F.max("id").alias("assertion_id"))
    )


def label_division(
    assertions: DataFrame, retractions: DataFrame, label_ids: list[int]
) -> DataFrame:
    """Ids of records on which every listed label is asserted and not retracted.

    Whether the label itself is still active is not asked here.
    """
    wanted = sorted(set(label_ids))
    return (
        active_assertions(assertions.filter(F.col("label_id").isin(wanted)), retractions)
        .groupBy("record_id")
        .agg(F.count_distinct("label_id").alias("held"))
        .filter(F.col("held") == len(wanted))
        .select("record_id")
    )


def eligible_records(
    records: DataFrame,
    scopes: DataFrame,
    scope_id: int,
    include_global: bool = False,
    kinds: list[str] = (),
    lifecycles: list[str] = (),
    labelled: DataFrame | None = None,
) -> DataFrame:
    """Readable records of a scope (and the global one) with the wanted kind and lifecycle.

    Absent filters leave no trace in the plan; an empty lifecycle list means active only.
    ``labelled`` is the result of :func:`label_division`.
    """
    rows = records.filter("readable").filter(
        F.col("lifecycle").isin(*lifecycles) if lifecycles else F.col("lifecycle") == "active"
    )
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    in_scope = F.col("scope_id") == scope_id
    if include_global:
        global_id = scopes.filter(F.col("name") == GLOBAL_SCOPE).select("id").scalar()
        in_scope = in_scope | (F.col("scope_id") == global_id)
    rows = rows.filter(in_scope)
    if labelled is not None:
        rows = rows.join(labelled.withColumnRenamed("record_id", "id"), "id", "left_semi")
    return rows


def eligible_candidates(
    candidates: DataFrame,
    records: DataFrame,
    queries: DataFrame,
    held_labels: DataFrame | None = None,
) -> DataFrame:
    """Candidates (query_id, record_id, …) whose record passes its query's filters.

    Candidates are already limited to the scopes of the query. ``queries`` may bring array
    columns ``kinds``, ``lifecycles`` and ``label_ids``; an absent column filters like an empty
    list. ``held_labels`` are active assertions, needed when label ids are given.
    """
    state = records.filter("readable").select(
        F.col("id").alias("record_id"), "kind", "lifecycle"
    )
    filters = [c for c in ("kinds", "lifecycles", "label_ids") if c in queries.columns]
    rows = candidates.join(state, "record_id")
    if filters:
        rows = rows.join(queries.select("query_id", *filters), "query_id")
    if "kinds" in filters:
        rows = rows.filter(
            (F.coalesce(F.size("kinds"), F.lit(0)) < 1) | F.array_contains("kinds", F.col("kind"))
        )
    if "lifecycles" in filters:
        any_given = F.coalesce(F.size("lifecycles"), F.lit(0)) > 0
        rows = rows.filter(
            F.when(any_given, F.array_contains("lifecycles", F.col("lifecycle"))).otherwise(
                F.col("lifecycle") == "active"
            )
        )
    else:
        rows = rows.filter(F.col("lifecycle") == "active")
    if "label_ids" in filters and held_labels is not None:
        wanted = queries.select(F.explode("label_ids").alias("label_id")).distinct()
        # A record holds at most as many labels as the catalogue has.
        held = (
            held_labels.join(wanted, "label_id", "left_semi")
            .groupBy("record_id")
            .agg(F.collect_set("label_id").alias("held"))
        )
        none = F.array().cast("array<bigint>")
        lacking = F.array_except(F.coalesce("label_ids", none), F.coalesce("held", none))
        rows = rows.join(held, "record_id", "left").filter(F.size(lacking) == 0)
    return rows.select(*candidates.columns)


def keyset_page(rows: DataFrame, limit: int, before_id: int | None = None) -> DataFrame:
    """One page of ids, newest first, with the cursor of the next page when there is one."""
    if before_id is not None:
        rows = rows.filter(F.col("id") < before_id)
    fetched = rows.orderBy(F.desc("id")).limit(limit + 1)
    # At most limit + 1 rows are left for these two windows.
    whole = Window.partitionBy(F.lit(1))
    ranked = fetched.withColumns(
        {
            "position": F.row_number().over(whole.orderBy(F.desc("id"))),
            "fetched": F.count("*").over(whole),
        }
    ).filter(F.col("position") <= limit)
    last = F.when(F.col("fetched") > limit, F.min("id").over(whole))
    return ranked.withColumn("next_before_id", last).drop("fetched")


def keyset_pages(rows: DataFrame, listing: str, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """One page for each value of column ``listing``.

    ``cursors`` holds at most one (listing, before_id) row per listing. Only limit + 1 rows per
    listing leave a task, whatever the size of the listing.
    """
    if cursors is not None:
        rows = rows.join(cursors, listing, "left").filter(
            F.col("before_id").isNull() | (F.col("id") < F.col("before_id"))
        )
    newest = Window.partitionBy(listing).orderBy(F.desc("id"))
    fetched = (
        rows.select(listing, "id")
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit + 1)
    )
    more = F.count("*").over(Window.partitionBy(listing))
    kept = fetched.withColumn("fetched", more).filter(F.col("position") <= limit)
    last = F.when(F.col("fetched") > limit, F.min("id").over(Window.partitionBy(listing)))
    return kept.withColumn("next_before_id", last).drop("fetched")


def search_labels(
    labels: DataFrame, aliases: DataFrame, query: str, facet: str | None = None, limit: int = 50
) -> DataFrame:
    """Active labels whose canonical name, display name or an alias contains the query.

    ``%`` and ``_`` in the query act as wildcards; a blank query matches every label.
    """
    # Backslash is an escape in Spark's LIKE, and a plain character here.
    pattern = f"%{query.strip().lower()}%".replace("\\", "\\\\")
    rows = labels.filter("active")
    if facet is not None:
        rows = rows.filter(F.col("facet") == facet)
    if pattern != "%%":
        alias_hit = aliases.filter(F.lower("alias").like(pattern)).select(
            F.col("label_id").alias("id"), F.lit(True).alias("by_alias")
        )
        rows = rows.join(alias_hit.distinct(), "id", "left").filter(
            F.lower(label_canonical()).like(pattern)
            | F.lower("display_name").like(pattern)
            | F.col("by_alias")
        )
    return (
        rows.select("id", "facet", "key", label_canonical().alias("canonical"), "display_name")
        .orderBy("facet", "key", "id")
        .limit(limit)
    )


def alias_owners(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, label_id) of wanted aliases; null where an alias is free. Case does not matter."""
    owners = aliases.select(F.lower("alias").alias("_alias"), "label_id")
    return (
        wanted.withColumn("_alias", F.lower("alias"))
        .join(owners, "_alias", "left")
        .select("alias", "label_id")
    )


def label_document(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Label with its canonical name and sorted aliases (a label has at most a few hundred)."""
    grouped = aliases.groupBy("label_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return (
        labels.withColumnRenamed("id", "label_id")
        .join(grouped, "label_id", "left")
        .select(
            "label_id",
            "facet",
            "key",
            label_canonical().alias("canonical"),
            "display_name",
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
            "active",
        )
    )


def current_revision(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each record's current revision row."""
    current = records.select(
        F.col("id").alias("record_id"), F.col("current_revision").alias("revision")
    )
    return revisions.join(current, ["record_id", "revision"])


def refold(revisions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Lifecycle, newest revision and time of the last change per record, from the append-only
    tables alone. All three are combined before the shuffle."""
    newest = revisions.groupBy("record_id").agg(
        F.max("revision").alias("current_revision"), F.max("created_at").alias("revised_at")
    )
    states = transitions.groupBy("record_id").agg(
        F.max_by("to_state", "id").alias("lifecycle"), F.max("created_at").alias("changed_at")
    )
    return newest.join(states, "record_id").select(
        "record_id",
        "lifecycle",
        "current_revision",
        F.greatest("revised_at", "changed_at").alias("updated_at"),
    )


def revision_history(records: DataFrame, revisions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All revisions of readable records, one row each, keyed by (record_id, revision)."""
    seen = records.filter("readable").select(F.col("id").alias("record_id"))
    if ids is not None:
        seen = seen.join(ids, "record_id", "left_semi")
    return revisions.join(seen, "record_id", "left_semi")


def lifecycle_history(records: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transitions of readable records in order. A terminal state never changes, so a record
    has at most two."""
    seen = records.filter("readable").select(F.col("id").alias("record_id"))
    return (
        transitions.join(seen, "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", "from_state", "to_state"))).alias("steps"))
    )


def visible_edges(records: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose both ends are readable."""
    seen = records.filter("readable").select(F.col("id").alias("end"))
    return relations.join(
        seen, F.col("source_record_id") == F.col("end"), "left_semi"
    ).join(seen, F.col("target_record_id") == F.col("end"), "left_semi")


def relations_visible(
    records: DataFrame,
    relations: DataFrame,
    retractions: DataFrame,
    include_retracted: bool = False,
) -> DataFrame:
    """One row per record and relation that leaves or enters it."""
    edges = visible_edges(records, relations)
    if not include_retracted:
        edges = active_edges(edges, retractions)
    return edges.select(
        "*", F.explode(F.array("source_record_id", "target_record_id")).alias("record_id")
    )


def active_edges(relations: DataFrame, retractions: DataFrame) -> DataFrame:
    return relations.join(
        retractions.select(F.col("relation_id").alias("id")), "id", "left_anti"
    )


def relation_with_retraction(
    records: DataFrame, relations: DataFrame, retractions: DataFrame
) -> DataFrame:
    """Visible relations with the retraction, if any, as a nested column."""
    ended = retractions.select(
        F.col("relation_id").alias("id"),
        F.struct("reason", "created_at", "actor", "thread", "client").alias("retracted"),
    )
    return visible_edges(records, relations).join(ended, "id", "left")


def relation_absent(asked: DataFrame, relations: DataFrame, retractions: DataFrame) -> DataFrame:
    """Asked (source_record_id, target_record_id, kind) edges that are not active."""
    return asked.join(
        active_edges(relations, retractions),
        ["source_record_id", "target_record_id", "kind"],
        "left_anti",
    )


def record_sources(sources: DataFrame) -> DataFrame:
    """Sources per revision in position order; a revision has at most 100."""
    return sources.groupBy("record_id", "revision").agg(
        F.array_sort(
            F.collect_list(
                F.struct("position", "id", "identity", "locator", "version", "content_hash", "anchor")
            )
        ).alias("sources")
    )


def record_document(store, ids: DataFrame | None = None) -> DataFrame:
    """Records with scope, current revision, sources, labels and lifecycle nested.

    The nested lists are bounded: 100 sources per revision, one entry per catalogue label, two
    transitions. Relations and revisions of a record are not bounded; they come as counts here
    and as rows from :func:`relations_visible` and :func:`revision_history`.
    """
    records = store.read("records")
    shown = records.filter("readable")
    if ids is not None:
        shown = shown.join(ids.select(F.col("record_id").alias("id")), "id", "left_semi")
    rows = shown.withColumnRenamed("id", "record_id")
    wanted = rows.select("record_id")
    scopes = store.read("scopes").select(F.col("id").alias("scope_id"), F.col("name").alias("scope_name"))
    revisions = store.read("record_revisions")
    current = visible_revisions(shown, current_revision(shown, revisions), records).select(
        "record_id",
        payload_text(F.col("payload")).alias("text"),
        F.col("reason").alias("revision_reason"),
    )
    labels = (
        active_labels(
            store.read("label_assertions"), store.read("label_retractions"), store.read("labels")
        )
        .join(wanted, "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_list(F.struct("facet", "key", "label_id", "canonical"))).alias("labels"))
    )
    edges = (
        relations_visible(records, store.read("record_relations"), store.read("relation_retractions"))
        .join(wanted, "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.count("*").alias("n_relations"))
    )
    history = (
        revisions.select("record_id")
        .join(wanted, "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.count("*").alias("n_revisions"))
    )
    steps = lifecycle_history(shown, store.read("lifecycle_transitions"))
    keys = shown.select(F.col("id").alias("record_id"), F.col("current_revision").alias("revision"))
    sources = record_sources(
        store.read("source_references").join(keys, ["record_id", "revision"], "left_semi")
    ).drop("revision")
    return (
        rows.select(
            "record_id", "scope_id", "kind", "title", "lifecycle", "current_revision", "updated_at"
        )
        .join(scopes, "scope_id")
        .join(current, "record_id")
        .join(sources, "record_id", "left")
        .join(labels, "record_id", "left")
        .join(edges, "record_id", "left")
        .join(history, "record_id", "left")
        .join(steps, "record_id", "left")
        .fillna(0, ["n_relations", "n_revisions"])
    )


def given(queries: DataFrame, name: str) -> Column:
    """Whether a query brings a non-empty list in column ``name``."""
    if name not in queries.columns:
        return F.lit(False)
    return F.coalesce(F.size(name), F.lit(0)) > 0


def match_explanation(
    text: bool, include_global: Column, kinds: Column, labels: Column, model: str | None = None
) -> Column:
    """Tags that say why a record is in a result."""
    tags = [F.lit("fts:title_or_payload")] if text else []
    if model is not None:
        tags += [F.lit("semantic:cosine"), F.lit(f"model:{model}")]
    tags += [
        F.when(include_global, "scope:exact_or_global").otherwise("scope:exact"),
        F.when(kinds, "kind"),
        F.lit("lifecycle"),
        F.when(labels, "labels:all"),
    ]
    return F.array_compact(F.array(*tags))
