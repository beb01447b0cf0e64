"""A knowledge ledger derived from the driver tables.

Every view below is a projection of whole driver tables: documents become records, sources
become scopes, conversation turns become later revisions, events become commands.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.payload import MAIN_TEXT
from tessera.functions.text import words
from tessera.limits import DIRECT_RELATIONS, KINDS
from tessera.operators.ordering import allocate_ids
from tessera.operators.segments import SegmentedIndex, refresh_segments, write_segments
from tessera.operators.textindex import TextIndex, indexed_documents, write_index
from tessera.schemas import PAYLOAD
from tessera.session import new_folder
from tessera.sources.store import LedgerStore

EPOCH = "2026-01-01 00:00:00"
QUERY_WORDS = 8
MODEL, MODEL_REVISION = "m", "v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _provenance(key: Column, created_at: Column | None = None) -> dict[str, Column]:
    return {
        "created_at": F.lit(EPOCH).cast("timestamp_ntz") if created_at is None else created_at,
        "actor": F.lit("agent-a"),
        "thread": F.lit("thread-a"),
        "client": F.lit("ledger"),
        "idempotency_key": key,
    }


def n_documents(spark: SparkSession, sf_dir: str) -> int:
    """Row count, answered from Parquet footers."""
    return table(spark, sf_dir, "documents").count()


def scope_id(source: Column) -> Column:
    return F.regexp_extract(source, r"^\D*(\d+)$", 1).try_cast("bigint") + 1


def payload_of(text: Column) -> Column:
    """Payload of column ``kind`` whose main text field holds ``text``; the other fields come
    from the columns of the document."""
    values = {
        "observation": {"observed_at": F.lit("2026-08-30T10:00:00Z")},
        "decision": {"rationale": F.concat(F.lit("from "), "source")},
        "snippet": {
            "language": F.col("lang"),
            "origin": F.lit("generated"),
            "dependencies": F.array("source"),
        },
        "metric": {
            "name": F.lit("n_chars"),
            "value": F.col("n_chars").cast("double"),
            "unit": F.lit("chars"),
            "dimensions": F.create_map(
                F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")
            ),
        },
        "evidence": {"outcome": F.concat(F.lit("lang "), "lang")},
    }
    for kind in KINDS:
        values.setdefault(kind, {})[MAIN_TEXT[kind]] = text
    items = [F.col("kind")]
    for field in PAYLOAD.fields[1:]:
        value = F.lit(None)
        for kind, fields in values.items():
            if field.name in fields:
                value = F.when(F.col("kind") == kind, fields[field.name]).otherwise(value)
        items.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*items)


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") == "src0", "global").otherwise(F.col("source"))
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            scope_id(F.col("source")).alias("id"),
            name.alias("name"),
            *_aliased(_provenance(F.concat(F.lit("scope:"), "source"))),
        )
    )


def _aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumns(
        {
            "record_id": F.col("doc_id") + 1,
            "kind": _pick(KINDS, F.col("doc_id") % len(KINDS)),
            "title": F.concat(F.lit("Document "), F.col("doc_id").cast("string")),
        }
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision 1 from the document, revision turn + 2 from its conversation."""
    docs = _docs(spark, sf_dir)
    base = docs.select(
        "record_id",
        F.lit(1).cast("bigint").alias("revision"),
        "title",
        payload_of(F.col("text")).alias("payload"),
        F.lit("record created").alias("reason"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") + 1).alias("record_id"), "turn", F.col("text").alias("turn_text"), "role"
    )
    later = turns.join(docs.drop("text"), "record_id").select(
        "record_id",
        (F.col("turn") + 2).alias("revision"),
        "title",
        payload_of(F.col("turn_text")).alias("payload"),
        F.concat(F.lit("turn by "), "role").alias("reason"),
    )
    key = F.concat_ws(":", F.lit("rev"), "record_id", "revision")
    return base.unionByName(later).withColumns(_provenance(key))


def _retractions(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """First accepted retract command per record, hidden records excluded."""
    return (
        commands(spark, sf_dir, n)
        .filter(F.col("op") == "transition_record")
        .groupBy("record_id")
        .agg(F.min(F.struct("ts", "seq", "key")).alias("first"))
        .select("record_id", F.col("first.ts").alias("ts"), F.col("first.key").alias("key"))
    )


def records(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = _docs(spark, sf_dir).select("record_id", "doc_id", "kind", "title", "source")
    hidden = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "toxic")
    newest = (
        table(spark, sf_dir, "conversations")
        .groupBy((F.col("conv_id") + 1).alias("record_id"))
        .agg((F.max("turn") + 2).alias("newest"))
    )
    retracted = _retractions(spark, sf_dir, n)
    return (
        docs.join(hidden, "doc_id", "left")
        .join(newest, "record_id", "left")
        .join(retracted, "record_id", "left")
        .withColumn("readable", F.col("toxic").isNull())
        .withColumn("retracted", F.col("readable") & F.col("ts").isNotNull())
        .select(
            F.col("record_id").alias("id"),
            scope_id(F.col("source")).alias("scope_id"),
            "kind",
            "title",
            F.when(F.col("retracted"), "retracted").otherwise("active").alias("lifecycle"),
            F.coalesce("newest", F.lit(1)).alias("current_revision"),
            "readable",
            F.when(F.col("retracted"), F.col("ts"))
            .otherwise(F.lit(EPOCH).cast("timestamp_ntz"))
            .alias("updated_at"),
            F.lit(None).cast("string").alias("import_metadata"),
            *_aliased(_provenance(F.concat(F.lit("record:"), "record_id"))),
        )
    )


def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id % 4`` sources on revision 1 of every record."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    listed = F.filter(numbers, lambda p: p < F.col("doc_id") % 4)
    return docs.select(
        "doc_id", "source", "lang", F.explode(listed).alias("position")
    ).select(
        (F.col("doc_id") * 4 + F.col("position") + 1).alias("id"),
        (F.col("doc_id") + 1).alias("record_id"),
        F.lit(1).cast("bigint").alias("revision"),
        "position",
        F.concat(F.lit("source-"), "position").alias("identity"),
        F.concat(F.lit("file:///"), "source").alias("locator"),
        F.lit(None).cast("string").alias("version"),
        F.when(F.col("position") > 0, F.concat(F.lit("sha256:"), "doc_id")).alias("content_hash"),
        F.lit(None).cast("string").alias("anchor"),
        F.when(F.col("position") == 0, F.lit("quoted text")).alias("quote"),
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workflow:inbox`` (1), ``quality:low`` (2), ``quality:high`` (3), languages from 4."""
    quality = (
        table(spark, sf_dir, "labels")
        .select("quality")
        .distinct()
        .select(
            (F.col("quality") + 2).cast("bigint").alias("id"),
            F.lit("quality").alias("facet"),
            F.when(F.col("quality") == 1, "high").otherwise("low").alias("key"),
        )
    )
    langs = (
        table(spark, sf_dir, "documents")
        .select("lang")
        .distinct()
        .select(_lang_id(F.col("lang")).alias("id"), F.lit("lang").alias("facet"),
                F.col("lang").alias("key"))
    )
    inbox = (
        table(spark, sf_dir, "documents")
        .select(F.lit(1).cast("bigint").alias("id"), F.lit("workflow").alias("facet"),
                F.lit("inbox").alias("key"))
        .distinct()
    )
    return (
        inbox.unionByName(quality)
        .unionByName(langs)
        .withColumn("display_name", F.initcap("key"))
        .withColumn("active", F.lit(True))
        .withColumns(_provenance(F.concat_ws(":", F.lit("label"), "facet", "key")))
    )


def _lang_id(lang: Column) -> Column:
    # Two lower-case letters give 4..679; stable under any set of languages.
    return (
        (F.ascii(F.substring(lang, 1, 1)) - 97) * 26 + F.ascii(F.substring(lang, 2, 1)) - 97 + 4
    ).cast("bigint")


def label_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_rows(spark, sf_dir)
    return labels.select(
        F.col("id").alias("label_id"),
        F.explode(
            F.array(F.concat("facet", F.lit(" "), "key"), F.concat("key", F.lit("-"), "facet"))
        ).alias("alias"),
    )


def label_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertion id = record id * 3 + slot (0 inbox, 1 language, 2 quality)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    graded = table(spark, sf_dir, "labels").select("doc_id", "quality")
    inbox = docs.select("doc_id", F.lit(0).alias("slot"), F.lit(1).cast("bigint").alias("label_id"))
    lang = docs.select("doc_id", F.lit(1).alias("slot"), _lang_id(F.col("lang")).alias("label_id"))
    quality = graded.select(
        "doc_id", F.lit(2).alias("slot"), (F.col("quality") + 2).cast("bigint").alias("label_id")
    )
    rows = reduce(DataFrame.unionByName, [inbox, lang, quality])
    return rows.select(
        ((F.col("doc_id") + 1) * 3 + F.col("slot")).alias("id"),
        (F.col("doc_id") + 1).alias("record_id"),
        "label_id",
        F.lit("record created").alias("reason"),
        *_aliased(_provenance(F.concat_ws(":", F.lit("label"), "doc_id", "slot"))),
    )


def label_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded documents have left the inbox."""
    return table(spark, sf_dir, "labels").select(
        ((F.col("doc_id") + 1) * 3).alias("assertion_id"),
        F.lit("graded").alias("reason"),
        *_aliased(_provenance(F.concat(F.lit("unlabel:"), "doc_id"))),
    )


def relations(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Record i points at record (i * 7 + 3) % n + 1."""
    return (
        table(spark, sf_dir, "documents")
        .select((F.col("doc_id") + 1).alias("id"))
        .select(
            "id",
            F.col("id").alias("source_record_id"),
            ((F.col("id") * 7 + 3) % n + 1).alias("target_record_id"),
            _pick(DIRECT_RELATIONS, F.col("id") % len(DIRECT_RELATIONS)).alias("kind"),
            F.lit("linked").alias("reason"),
            *_aliased(_provenance(F.concat(F.lit("relation:"), "id"))),
        )
        .filter("source_record_id <> target_record_id")
    )


def relation_retractions(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Edges that leave low-quality documents were withdrawn."""
    low = (
        table(spark, sf_dir, "labels")
        .filter("quality = 0")
        .select((F.col("doc_id") + 1).alias("relation_id"))
    )
    edges = relations(spark, sf_dir, n).select(F.col("id").alias("relation_id"))
    return low.join(edges, "relation_id").select(
        "relation_id",
        F.lit("low quality").alias("reason"),
        *_aliased(_provenance(F.concat(F.lit("unrelate:"), "relation_id"))),
    )


def lifecycle_transitions(record_rows: DataFrame) -> DataFrame:
    """Creation of every record, then its accepted retraction; ids interleave per record."""
    rows = record_rows.select("id", "lifecycle", "updated_at", "idempotency_key")
    created = rows.select(
        (F.col("id") * 2).alias("id"),
        F.col("id").alias("record_id"),
        F.lit(None).cast("string").alias("from_state"),
        F.lit("active").alias("to_state"),
        F.lit("record created").alias("reason"),
        *_aliased(_provenance(F.concat("idempotency_key", F.lit(":lifecycle")))),
    )
    ended = rows.filter("lifecycle = 'retracted'").select(
        (F.col("id") * 2 + 1).alias("id"),
        F.col("id").alias("record_id"),
        F.lit("active").alias("from_state"),
        F.lit("retracted").alias("to_state"),
        F.lit("error event").alias("reason"),
        *_aliased(
            _provenance(
                F.concat_ws(":", "idempotency_key", F.lit("lifecycle"), "id"), F.col("updated_at")
            )
        ),
    )
    return created.unionByName(ended)


def commands(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """One command per event, in (ts, seq) order."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    op = (
        F.when((kind == "error") & (F.col("value") > 80), "transition_record")
        .when(kind == "error", "retract_relation")
        .when(kind == "click", "add_label")
        .when(kind == "view", "retract_label")
        .when(kind == "signup", "revise_record")
        .otherwise("add_relation")
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .withColumn("op", op)
        .select(
            F.concat(F.lit("k"), "event_id").alias("key"),
            "op",
            "ts",
            (F.col("event_id") * 4).alias("seq"),
            (F.col("event_id") % n + 1).alias("record_id"),
            F.when(F.col("op").isin("add_label", "retract_label"), F.col("k") % 3 + 1).alias(
                "label_id"
            ),
            F.when(F.col("op") == "revise_record", F.col("k") % 3 + 1).alias("expected_revision"),
            F.when(F.col("op") == "add_relation", F.col("k") + 1).alias("target_record_id"),
            F.when(
                F.col("op") == "add_relation",
                _pick(DIRECT_RELATIONS, F.col("k") % len(DIRECT_RELATIONS)),
            ).alias("relation_kind"),
            F.when(F.col("op") == "retract_relation", F.col("event_id") % n + 1).alias(
                "relation_id"
            ),
            F.concat(F.lit("user "), "user_id").alias("reason"),
            F.col("props").alias("request"),
            F.concat(F.lit("user-"), "user_id").alias("actor"),
        )
    )


def delivered_commands(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Commands as a client sends them: dear ones twice, very cheap ones again with a changed
    request, and the very dear ones under another operation."""
    value = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "event_id").alias("key"), "value"
    )
    first = commands(spark, sf_dir, n).join(value, "key")

    def sent(shift: int, more: str = "", other: str | None = None) -> Column:
        return F.struct(
            F.lit(shift).cast("bigint").alias("_shift"),
            F.lit(more).alias("_more"),
            F.lit(other).cast("string").alias("_other"),
        )

    # One join for all of them; what is not sent is null.
    deliveries = F.array(
        sent(0),
        F.when(F.col("value") > 60, sent(1)),
        F.when(F.col("value") < 2, sent(2, more=" ")),
        F.when(F.col("value") > 150, sent(3, other="read_record")),
    )
    changed = {
        "seq": F.col("seq") + F.col("_shift"),
        "request": F.concat("request", "_more"),
        "op": F.coalesce("_other", "op"),
    }
    return (
        first.select("*", F.inline(F.array_compact(deliveries)))
        .withColumns(changed)
        .drop("value", "_shift", "_more", "_other")
    )


def write_keys(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Keys used before this batch: those of all signup events, with their requests."""
    return (
        commands(spark, sf_dir, n)
        .filter("op = 'revise_record'")
        .select(
            "key",
            F.col("op").alias("operation"),
            F.sha2(F.col("request").cast("binary"), 256).alias("request_hash"),
            F.col("record_id").alias("result_id"),
        )
    )


def embeddings(spark: SparkSession, sf_dir: str, record_rows: DataFrame, n_vectors: int) -> DataFrame:
    """Complete index: every record at its current revision; vectors are reused in turn."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    recs = record_rows.select("id", "current_revision")
    return (
        recs.withColumn("vec_id", (F.col("id") - 1) % n_vectors)
        .join(vectors, "vec_id")
        .select(
            F.col("id").alias("record_id"),
            F.col("current_revision").alias("revision"),
            *_model(),
        )
    )


def partial_embeddings(spark: SparkSession, sf_dir: str, record_rows: DataFrame) -> DataFrame:
    """One vector per vec_id at revision ``label % 2 + 1``: some valid, stale and missing."""
    recs = record_rows.select(F.col("id").alias("record_id"))
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("record_id", F.col("vec_id") + 1)
        .join(recs, "record_id", "left_semi")
        .select(
            "record_id", (F.col("label") % 2 + 1).cast("bigint").alias("revision"), *_model()
        )
    )


def _model() -> list[Column]:
    return [
        F.lit(MODEL).alias("model"),
        F.lit(MODEL_REVISION).alias("model_revision"),
        F.size("embedding").cast("bigint").alias("dimensions"),
        F.col("embedding").alias("vector"),
    ]


def queries(spark: SparkSession, sf_dir: str, n_vectors: int) -> DataFrame:
    """Whole benchmark texts, cut into consecutive eight-word queries (query length is limited)."""
    terms = words(F.col("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("terms") - 1, F.lit(0)), F.lit(QUERY_WORDS))
    cut_up = (
        table(spark, sf_dir, "benchmark")
        .select("item_id", terms.alias("terms"))
        .select("item_id", "terms", F.posexplode(starts).alias("part", "start"))
        .select(
            "item_id",
            "part",
            F.array_join(
                F.slice("terms", F.col("start") + 1, F.lit(QUERY_WORDS)), " "
            ).alias("query"),
            (F.col("item_id") % 20 + 1).alias("scope_id"),
            (F.col("item_id") % 2 == 0).alias("include_global"),
            ((F.col("item_id") * 7 + F.col("part")) % n_vectors).alias("vec_id"),
        )
    )
    return allocate_ids(cut_up, ["item_id", "part"], 0, "query_id").select(
        "query_id", "query", "scope_id", "include_global", "vec_id"
    )


def query_vectors(spark: SparkSession, sf_dir: str, n_vectors: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector")
    )
    return queries(spark, sf_dir, n_vectors).join(vectors, "vec_id").select("query_id", "vector")


class DerivedLedger(LedgerStore):
    """A ledger whose tables are written, whole, when they are first asked for.

    ``makers`` write a folder each. A query that looks up labels need not wait for the texts.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.makers: dict[str, Callable[[], None]] = {}

    def path(self, folder: str) -> str:
        make = self.makers.pop(folder, None)
        if make is not None:
            try:
                make()
            except BaseException:
                self.makers[folder] = make
                raise
        return super().path(folder)

    def read_as(self, table: str, folder: str) -> DataFrame:
        self.path(folder)
        return super().read_as(table, folder)


_BUILT: dict[tuple[str, str], LedgerStore] = {}


def ledger(spark: SparkSession, sf_dir: str) -> LedgerStore:
    """The derived ledger, every table written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        store = DerivedLedger(spark, new_folder(spark, "ledger"))
        n = n_documents(spark, sf_dir)
        n_vectors = table(spark, sf_dir, "embeddings").count()
        known = store.read

        def put(name: str, make: Callable[[], DataFrame], folder: str | None = None) -> None:
            store.makers[folder or name] = lambda: store.write(name, make(), folder=folder)

        def put_plain(folder: str, make: Callable[[], DataFrame]) -> None:
            store.makers[folder] = lambda: make().write.parquet(store.path(folder))

        put("records", lambda: records(spark, sf_dir, n))
        put(
            "record_revisions",
            lambda: revisions(spark, sf_dir).repartition("record_id", "revision"),
        )
        put("source_references", lambda: source_references(spark, sf_dir))
        put("scopes", lambda: scopes(spark, sf_dir))
        put("labels", lambda: label_rows(spark, sf_dir))
        put("label_aliases", lambda: label_aliases(spark, sf_dir))
        put("label_assertions", lambda: label_assertions(spark, sf_dir))
        put("label_retractions", lambda: label_retractions(spark, sf_dir))
        put("record_relations", lambda: relations(spark, sf_dir, n))
        put("relation_retractions", lambda: relation_retractions(spark, sf_dir, n))
        put("write_keys", lambda: write_keys(spark, sf_dir, n))
        put("lifecycle_transitions", lambda: lifecycle_transitions(known("records")))
        put("record_embeddings", lambda: embeddings(spark, sf_dir, known("records"), n_vectors))
        put(
            "record_embeddings",
            lambda: partial_embeddings(spark, sf_dir, known("records")),
            "partial_embeddings",
        )
        put_plain("queries", lambda: queries(spark, sf_dir, n_vectors))
        put_plain("query_vectors", lambda: query_vectors(spark, sf_dir, n_vectors))
        _BUILT[key] = store
    return _BUILT[key]


def query_table(store: LedgerStore) -> DataFrame:
    schema = "query_id bigint, query string, scope_id bigint, include_global boolean, vec_id bigint"
    return store.spark.read.schema(schema).parquet(store.path("queries"))


def query_vector_table(store: LedgerStore) -> DataFrame:
    schema = "query_id bigint, vector array<float>"
    return store.spark.read.schema(schema).parquet(store.path("query_vectors"))


_INDEXED: dict[str, TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The text index of the derived ledger, built once per ledger."""
    store = ledger(spark, sf_dir)
    if store.root not in _INDEXED:
        documents = indexed_documents(store.read("records"), store.read("record_revisions"))
        _INDEXED[store.root] = write_index(documents, f"{store.root}/text_index")
    return _INDEXED[store.root]


_SEGMENTED: dict[str, tuple[SegmentedIndex, SegmentedIndex]] = {}


def segmented_index(spark: SparkSession, sf_dir: str) -> tuple[SegmentedIndex, SegmentedIndex]:
    """An index in segments after all revised records are put back to their first revision, and
    after they are brought up to the current one again."""
    store = ledger(spark, sf_dir)
    if store.root not in _SEGMENTED:
        records, revisions = store.read("records"), store.read("record_revisions")
        revised = records.filter("current_revision > 1")
        first = revised.withColumn("current_revision", F.lit(1).cast("bigint"))
        index = write_segments(indexed_documents(records, revisions), f"{store.root}/segments")
        back = refresh_segments(index, indexed_documents(first, revisions, ledger=records))
        again = refresh_segments(back, indexed_documents(revised, revisions, ledger=records))
        _SEGMENTED[store.root] = back, again
    return _SEGMENTED[store.root]
