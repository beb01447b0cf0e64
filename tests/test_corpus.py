import os

from pyspark.sql import functions as F

from tessera.sources import corpus

DATA = "/root/testdata/sf0.001"


def test_a_ledger_table_is_written_when_it_is_first_asked_for(spark, tmp_path):
    here = tmp_path / "data"
    os.symlink(DATA, here)
    store = corpus.ledger(spark, str(here))

    def folders():
        root = store.root.removeprefix("file:")
        return set(os.listdir(root)) if os.path.isdir(root) else set()

    assert folders() == set()
    labels = store.read("labels")
    assert folders() == {"labels"}
    want = corpus.label_rows(spark, DATA).select(*labels.columns)
    assert labels.exceptAll(want).isEmpty() and want.exceptAll(labels).isEmpty()
    # A table that is made from another brings it along, and both are written once.
    read = store.read("lifecycle_transitions")
    assert folders() == {"labels", "records", "lifecycle_transitions"}
    assert read.filter("from_state IS NULL").count() == store.read("records").count()
    assert store.read("labels").agg(F.max("id")).first() == want.agg(F.max("id")).first()
    assert corpus.query_table(store).count() > 0 and "queries" in folders()
    assert corpus.ledger(spark, str(here)) is store
