from tessera.operators import legacy, views
from tests.helpers import rows_of


def test_day_rollup(spark):
    entries = spark.createDataFrame(
        [(9, "2024-01-01", "2024-01-01T12:00:00Z", "2024-01-02T00:00:00Z", "second"),
         (3, "2024-01-01", "2024-01-01T08:00:00Z", "2024-01-01T08:00:00Z", "first"),
         (5, "2024-01-01", "2024-01-01T09:00:00Z", "2024-01-01T09:00:00Z", ""),
         (4, "2024-01-02", "2024-01-02T09:00:00Z", "2024-01-02T09:00:00Z", "")],
        "id bigint, day string, created_at string, updated_at string, body string",
    )
    days, parts = legacy.legacy_day_rollup(entries)
    first = {r["day"]: r for r in days.collect()}["2024-01-01"]
    assert (first["id"], first["created_at"], first["updated_at"]) == (
        3, "2024-01-01T08:00:00Z", "2024-01-02T00:00:00Z")
    assert days.count() == 2
    got = [tuple(r) for r in parts.orderBy("day", "position").collect()]
    assert got == [("2024-01-01", 0, 3, "first"), ("2024-01-01", 1, 9, "second")]


def test_a_long_day_is_like_any_other(spark):
    entries = spark.range(3).selectExpr(
        "id", "'2024-01-01' AS day", "'c' AS created_at", "'u' AS updated_at", "repeat('x', 600000) AS body"
    )
    days, parts = legacy.legacy_day_rollup(entries)
    assert days.count() == 1
    assert [r[0] for r in parts.orderBy("position").select("entry_id").collect()] == [0, 1, 2]


def test_import_hides_private_notes_and_their_links(spark):
    link = "see [[note:9|public]] and [[note:7|secret]] and [[note:55|gone]] [[note:4|self]] [[note:9|again]]"
    rows = [(i, "note", "private" if i == 7 else "shared", "user", "2024-01-01", "c", "u", link if i == 4 else "plain", 1)
            for i in (3, 4, 7, 9, 11, 12)]
    docs = spark.createDataFrame(rows, "id bigint, kind string, visibility string, author string, day string, "
                                       "created_at string, updated_at string, body string, revision bigint")
    made = legacy.legacy_import(docs, 1, 2)
    assert {(r["source_record_id"], r["target_record_id"]) for r in made["relations"].collect()} == {(4, 9), (4, 7)}
    records = made["records"]
    assert {r["id"] for r in views.readable(records).collect()} == {3, 4, 9, 11, 12}
    edges = rows_of(spark, "record_relations", [
        dict(id=i, source_record_id=4, target_record_id=t, kind="references") for i, t in enumerate((9, 7))])
    assert views.visible_edges(records, edges).count() == 1
    bodies = made["revisions"].selectExpr("record_id", "payload.body AS body")
    shown = {r["record_id"]: r["body"] for r in legacy.link_redact(bodies, views.readable(records)).collect()}
    assert shown[4] == "see [[note:9|public]] and  and  [[note:4|self]] [[note:9|again]]"
    assert shown[3] == "plain"
    assert {r["body"] for r in bodies.filter("record_id = 4").collect()} == {link}
    assert records.filter("id = 4").first()["title"] == "Imported legacy note 4"


def test_redaction_wherever_imported_text_is_read(spark, tmp_path):
    """The label of a link to a hidden record can't be searched, shown, embedded or recalled."""
    from tessera.operators import dense, textindex
    from tests.helpers import simple_store

    body = "open words [[note:2|harbour plan]] and [[note:3|lantern list]] end"
    store = simple_store(
        spark, tmp_path / "ledger", [("one", body), ("two", "hidden"), ("three", "shown")],
        override={1: dict(import_metadata="{}"), 2: dict(readable=False)},
    )
    records, revisions = store.read("records"), store.read("record_revisions")
    docs = textindex.indexed_documents(records, revisions)
    terms = {r["term"] for r in textindex.postings(docs).collect()}
    assert "lantern" in terms and "harbour" not in terms
    texts = [r["text"] for r in dense.record_text(records, revisions).collect()]
    assert any("lantern" in t for t in texts) and not any("harbour" in t for t in texts)
    changed = records.filter("id = 1")
    part = dense.record_text(changed, revisions, ledger=records).filter("record_id = 1").first()["text"]
    assert "lantern" in part and "harbour" not in part
    shown = {r["record_id"]: r["text"] for r in views.record_document(store).collect()}
    assert "lantern" in shown[1] and "harbour" not in shown[1]
