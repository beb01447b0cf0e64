"""The pipeline: columns, effects, and the queries of the package."""

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.helpers import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        assert docs.filter("n_chars <> length(text)").isEmpty()
        sizes.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] == sizes[4] > 0


def test_stages_with_odd_rows(spark):
    for make in (edge_docs, no_docs):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = corpus_pipeline.saved(out, "stage")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_registered():
    names = list(entry.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names
