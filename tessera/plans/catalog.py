"""Named queries: codecs, projections, state views, text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.payload import decode, payload_encode, payload_kind, payload_text
from tessera.functions.text import json_number, normalized, tokens
from tessera.operators import retrieval as rt
from tessera.operators import textindex as ti
from tessera.operators import views
from tessera.plans.registry import (
    QUERIES,
    assertions,
    big,
    on_ledger,
    pair_queries,
    query,
    query_batch,
)
from tessera.sources import corpus

# Sources, sinks, codecs


@on_ledger
def ledger_scan(store):
    """Rows per ledger table, read back with the fixed schemas."""
    names = ["scopes", "records", "record_revisions", "source_references", "labels",
             "label_aliases", "label_assertions", "label_retractions", "record_relations",
             "relation_retractions", "lifecycle_transitions", "write_keys", "record_embeddings"]
    counts = [
        store.read(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n in names
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


@on_ledger
def payload_encode_(store):
    return store.read("record_revisions").select(
        "record_id", "revision", payload_encode(F.col("payload")).alias("payload_json")
    )


QUERIES["payload_encode"] = QUERIES.pop("payload_encode_")


@query
def payload_decode_(spark, sf_dir):
    """Encoded payloads come back whole; damaged ones are refused with a reason."""
    revisions = corpus.ledger(spark, sf_dir).read("record_revisions")
    text = payload_encode(F.col("payload"))
    good = revisions.select(
        F.concat_ws(":", F.lit("r"), "record_id", "revision").alias("item"), text.alias("j")
    )
    extra = revisions.select(
        F.concat_ws(":", F.lit("x"), "record_id", "revision").alias("item"),
        F.concat(F.lit('{"extra":true,'), F.substr(text, F.lit(2))).alias("j"),
    )
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    number = docs.select(
        F.concat_ws(":", F.lit("n"), "doc_id").alias("item"),
        F.format_string('{"kind":"note","body":%d}', "n_chars").alias("j"),
    )
    lacking = docs.select(
        F.concat_ws(":", F.lit("m"), "doc_id").alias("item"),
        F.format_string('{"kind":"snippet","code":"%d"}', "n_chars").alias("j"),
    )
    props = corpus.table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.lit("p"), "event_id").alias("item"), F.col("props").alias("j")
    )
    talk = corpus.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("item"), F.col("text").alias("j")
    )
    rows = good
    for more in (extra, number, lacking, props, talk):
        rows = rows.unionByName(more)
    return decode(rows, "j", error="error").select(
        "item",
        "error",
        F.col("payload.kind").alias("kind"),
        payload_text(F.col("payload")).alias("text"),
    )


QUERIES["payload_decode"] = QUERIES.pop("payload_decode_")


def _posting_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "term",
        "record_id",
        "tf",
        "dl",
        F.array_join(F.col("title_pos").cast("array<string>"), ",").alias("title_pos"),
        F.array_join(F.col("body_pos").cast("array<string>"), ",").alias("body_pos"),
    )


@query
def text_index_build(spark, sf_dir):
    """Postings of the current revision of every readable record."""
    return _posting_rows(corpus.text_index(spark, sf_dir).postings())


@query
def text_index_refresh(spark, sf_dir):
    """Postings after all revised records are put back to their first revision."""
    store = corpus.ledger(spark, sf_dir)
    index = corpus.text_index(spark, sf_dir)
    revised = store.read("records").filter("current_revision > 1").withColumn(
        "current_revision", F.lit(1).cast("bigint")
    )
    changed = ti.indexed_documents(
        revised, store.read("record_revisions"), ledger=store.read("records")
    )
    return _posting_rows(ti.refreshed(index, changed))


@query
def segment_postings(spark, sf_dir):
    """The same postings, of an index in which a second segment holds the first revisions."""
    return _posting_rows(corpus.segmented_index(spark, sf_dir)[0].postings())


@query
def segment_terms(spark, sf_dir):
    """Document frequencies that both segments add up to."""
    return corpus.segmented_index(spark, sf_dir)[0].term_stats().select("term", "df")


@query
def corpus_stats(spark, sf_dir):
    index = corpus.text_index(spark, sf_dir)
    return ti.corpus_stats(index.doc_stats()).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def document_frequency(spark, sf_dir):
    return corpus.text_index(spark, sf_dir).term_stats().select("term", "df")


# Projections


@on_ledger
def payload_kind_(store):
    return store.read("record_revisions").select(
        "record_id", "revision", payload_kind(F.col("payload")).alias("kind")
    )


QUERIES["payload_kind"] = QUERIES.pop("payload_kind_")


@on_ledger
def payload_text_(store):
    return store.read("record_revisions").select(
        "record_id", "revision", payload_text(F.col("payload")).alias("text")
    )


QUERIES["payload_text"] = QUERIES.pop("payload_text_")


@query
def number_text(spark, sf_dir):
    """Metric values as JSON numbers."""
    return corpus.table(spark, sf_dir, "orders").select(
        "o_orderkey", json_number(F.col("o_totalprice")).alias("text")
    )


@on_ledger
def label_canonical(store):
    return store.read("labels").select("id", views.label_canonical().alias("canonical"))


@on_ledger
def normalized_text(store):
    text = F.concat_ws("\n", "title", payload_text(F.col("payload")))
    rows = store.read("record_revisions").select("record_id", "revision", text.alias("text"))
    return normalized(rows, "text")


@on_ledger
def match_explanation(store):
    tags = views.match_explanation(True, F.col("include_global"), F.lit(True), F.lit(False))
    dense = views.match_explanation(
        False, F.col("include_global"), F.lit(False), F.lit(True), "m@v1"
    )
    return corpus.query_table(store).select(
        "query_id",
        F.array_join(tags, ",").alias("text_tags"),
        F.array_join(dense, ",").alias("dense_tags"),
    )


# Filters and state views


@on_ledger
def readable_filter(store):
    return views.readable(store.read("records")).select("id")


LABELS = [3, 121]


@on_ledger
def label_division(store):
    return views.label_division(*assertions(store), LABELS)


@on_ledger
def eligible_records(store):
    """Scope 3 and the global scope, two kinds, any of two lifecycles, two labels at once."""
    held = views.label_division(*assertions(store), LABELS)
    rows = views.eligible_records(
        store.read("records"), store.read("scopes"), 3, True,
        ["note", "decision", "metric"], ["active", "retracted"], held,
    )
    return rows.select("id", "scope_id", "kind", "lifecycle")


@on_ledger
def eligible_default(store):
    """Scope 2 alone with no filter lists: every kind, active records only."""
    return views.eligible_records(store.read("records"), store.read("scopes"), 2).select("id")


@on_ledger
def keyset_page(store):
    """One page per scope, continued after the scope's newest hidden record where it has one."""
    records = store.read("records")
    cursors = records.filter("NOT readable").groupBy("scope_id").agg(F.max("id").alias("before_id"))
    pages = views.keyset_pages(views.readable(records), "scope_id", 20, cursors)
    return pages.select("scope_id", "id", big("position").alias("position"), "next_before_id")


@on_ledger
def keyset_page_single(store):
    """The first page over all scopes."""
    page = views.keyset_page(views.readable(store.read("records")), 50)
    return page.select("id", big("position").alias("position"), "next_before_id")


@on_ledger
def search_labels(store):
    return views.search_labels(store.read("labels"), store.read("label_aliases"), " H%h-QU ").select(
        "id", "canonical", "display_name"
    )


@on_ledger
def latest_active_assertion(store):
    return views.latest_active_assertion(*assertions(store))


@query
def relation_absent(spark, sf_dir):
    """Edges asked for by commands that are not active yet."""
    store = corpus.ledger(spark, sf_dir)
    n = corpus.n_documents(spark, sf_dir)
    asked = (
        corpus.commands(spark, sf_dir, n)
        .filter("op = 'add_relation'")
        .select(
            F.col("record_id").alias("source_record_id"),
            "target_record_id",
            F.col("relation_kind").alias("kind"),
        )
        .distinct()
    )
    return views.relation_absent(
        asked, store.read("record_relations"), store.read("relation_retractions")
    )


@on_ledger
def current_revision(store):
    rows = views.current_revision(store.read("records"), store.read("record_revisions"))
    return rows.select("record_id", "revision", payload_text(F.col("payload")).alias("text"))


@on_ledger
def active_labels(store):
    return views.active_labels(*assertions(store), store.read("labels")).select(
        "record_id", "label_id", "canonical"
    )


@on_ledger
def relations_visible(store):
    return views.relations_visible(
        store.read("records"), store.read("record_relations"), store.read("relation_retractions")
    ).select("record_id", "id", "source_record_id", "target_record_id", "kind")


@on_ledger
def relations_with_retracted(store):
    """Listing that includes withdrawn edges."""
    return views.relations_visible(
        store.read("records"),
        store.read("record_relations"),
        store.read("relation_retractions"),
        include_retracted=True,
    ).select("record_id", "id")


@on_ledger
def relation_with_retraction(store):
    return views.relation_with_retraction(
        store.read("records"), store.read("record_relations"), store.read("relation_retractions")
    ).select("id", "kind", F.col("retracted.reason").alias("retraction_reason"))


@on_ledger
def active_label_count(store):
    return views.active_label_count(*assertions(store))


@on_ledger
def record_document(store):
    """Documents, their nested parts joined to text."""
    labels = F.array_join(F.transform("labels", lambda x: x["canonical"]), ",")
    sources = F.array_join(F.transform("sources", lambda s: s["identity"]), ",")
    steps = F.array_join(F.transform("steps", lambda s: s["to_state"]), ">")
    return views.record_document(store).select(
        "record_id",
        "scope_name",
        "kind",
        "title",
        "lifecycle",
        "current_revision",
        "text",
        F.coalesce(sources, F.lit("")).alias("sources"),
        F.coalesce(labels, F.lit("")).alias("labels"),
        steps.alias("steps"),
        "n_relations",
        "n_revisions",
    )


@on_ledger
def label_document(store):
    return views.label_document(store.read("labels"), store.read("label_aliases")).select(
        "label_id", "canonical", F.array_join("aliases", ",").alias("aliases"), "active"
    )


@on_ledger
def lifecycle_history(store):
    steps = views.lifecycle_history(store.read("records"), store.read("lifecycle_transitions"))
    path = F.transform(
        "steps", lambda s: F.concat(F.coalesce(s["from_state"], F.lit("")), F.lit(">"), s["to_state"])
    )
    return steps.select("record_id", F.array_join(path, ",").alias("path"))


@on_ledger
def ledger_refold(store):
    """Record state rebuilt from revisions and transitions."""
    state = views.refold(store.read("record_revisions"), store.read("lifecycle_transitions"))
    return state.withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


@query
def alias_ownership(spark, sf_dir):
    """Wanted aliases (nation names, label texts) and the label that has them already."""
    store = corpus.ledger(spark, sf_dir)
    wanted = (
        corpus.table(spark, sf_dir, "nation")
        .select(F.col("n_name").alias("alias"))
        .union(store.read("label_aliases").select(F.upper("alias")))
    )
    return views.alias_owners(wanted, store.read("label_aliases"))


@on_ledger
def revision_history(store):
    return views.revision_history(store.read("records"), store.read("record_revisions")).select(
        "record_id", "revision", "title", "reason"
    )


@on_ledger
def list_scopes(store):
    return views.list_scopes(store.read("scopes")).select("id", "name")


# Text retrieval


@query
def tokenize(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens")
    )


@on_ledger
def query_terms(store):
    return rt.query_phrases(corpus.query_table(store)).select(
        "query_id", "term_ix", "term", F.array_join("tokens", " ").alias("tokens")
    )


@query
def phrase_match(spark, sf_dir):
    """Adjacent word pairs of the benchmark texts, found anywhere in the index."""
    batch = rt.QueryBatch.of(pair_queries(spark, sf_dir, "-"))
    return rt.phrase_matches(corpus.text_index(spark, sf_dir), batch).select(
        "query_id", "term_ix", "record_id", "tf"
    )


@query
def search_and(spark, sf_dir):
    batch = rt.QueryBatch.of(pair_queries(spark, sf_dir, " "))
    found = rt.phrase_matches(corpus.text_index(spark, sf_dir), batch, shared=True)
    return rt.search_and(found, batch.phrases, batch.bounded)


@query
def match_any(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return rt.match_any(rt.phrase_matches(corpus.text_index(spark, sf_dir), query_batch(store)))


@query
def bm25_score(spark, sf_dir):
    store = corpus.ledger(spark, sf_dir)
    return rt.bm25_scores(corpus.text_index(spark, sf_dir), query_batch(store)).select(
        "query_id", "record_id", F.round("score", 6).alias("score")
    )


@query
def bm25_topk(spark, sf_dir):
    """Top 20 active records per query."""
    store = corpus.ledger(spark, sf_dir)
    scores = rt.bm25_scores(corpus.text_index(spark, sf_dir), query_batch(store))
    allowed = views.eligible_candidates(scores, store.read("records"), corpus.query_table(store))
    return rt.bm25_topk(allowed, 20).select(
        "query_id", "bm25_rank", "record_id", F.round("score", 6).alias("score")
    )


@query
def segment_search(spark, sf_dir):
    """Top 20 active records per query, from an index of three segments."""
    store = corpus.ledger(spark, sf_dir)
    scores = rt.bm25_scores(corpus.segmented_index(spark, sf_dir)[1], query_batch(store))
    allowed = views.eligible_candidates(scores, store.read("records"), corpus.query_table(store))
    return rt.bm25_topk(allowed, 20).select(
        "query_id", "bm25_rank", "record_id", F.round("score", 6).alias("score")
    )
