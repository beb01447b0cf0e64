"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe
from tests.llm.helpers import edge_docs, edge_rows, no_docs

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_edges(spark, ranks, encoding):
    got = bpe.encode(edge_docs(spark), ranks, PATTERN, carry=["row"])
    got = got.withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    want = [(r[0], encoding.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in edge_rows()]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["ids"], bytes(r["back"]))) for r in got)


def test_both_folds(spark, ranks, encoding):
    """Words of any bytes, as Spark folds them and as a task folds them."""
    rng = random.Random(11)
    pool = ["a", "b", "the", "ing", "é", "日", "語", "\U0001f600", "zz", "0", " ", "_"]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 24))) for _ in range(60)] + ["a" * 300, "é" * 90]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    folded = df.select("text", bpe.fold_merges(F.encode("text", "utf-8"), bpe.RankMap(ranks)).alias("ids"))
    for r in folded.collect():
        data = r["text"].encode()
        want = encoding._encode_single_piece(data)
        assert r["ids"] == want == bpe.fold_word(data, ranks)


def test_long_word(ranks, encoding):
    rng = random.Random(12)
    word = "".join(rng.choices("abcdeé", k=20_000)).encode()
    ids = bpe.fold_word(word, ranks)
    assert ids == encoding._encode_single_piece(word)


def test_empty(spark, ranks):
    assert bpe.encode(no_docs(spark), ranks, PATTERN).collect() == []


def test_query_digests(spark, encoding):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in text:
        ids = encoding.encode_ordinary(r["text"] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r["text"] or "").encode())]
        want.append((r["doc_id"], len(ids), *digests))
    got = [tuple(r) for r in bpe.op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)
