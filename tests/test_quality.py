import pytest
from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.schemas import PAYLOAD, SOURCE
from tests.helpers import payload

FULL = ("source-a", "file:///tmp/source.txt", "v1", "sha256:abc", "line:1", "quoted text")
NO_HASH = ("source-a", "file:///tmp/source.txt", None, None, None, None)
SPAN = ("2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z")

CASES = [
    (payload(body="body"), [], [1], None),
    (payload("observation", statement="observed", observed_at="2026-08-30T10:00:00Z"), [FULL], [1], None),
    (payload("observation", statement="observed"), [], [1], "requires at least one source"),
    (payload("metric", name="l", value=1.0, unit="ms", dimensions={}), [], [1], "requires at least one source"),
    (payload("evidence", claim="c"), [], [1], "requires at least one source"),
    (payload("snippet", language="rust", code="c", origin="imported"), [NO_HASH], [1], "locator and content_hash"),
    (payload("snippet", language="rust", code="c", origin="imported", dependencies=["serde"]), [FULL], [1], None),
    (payload("snippet", language="rust", code="```mermaid", origin="generated"), [], [1], None),
    (payload("snippet", language="rust", code=" ", origin="generated"), [], [1], "must not be empty"),
    (payload("snippet", language="ru\nst", code="x", origin="generated"), [], [1], "language must be"),
    (payload("observation", statement="s", observed_at="yesterday"), [FULL], [1], "RFC 3339"),
    (payload("observation", statement="s", observed_at="2026-08-30"), [FULL], [1], "RFC 3339"),
    (payload(body="body"), [], [], "at least one active label"),
    (payload(body=" \n"), [], [1], "must not be empty"),
    (payload(body="x"), [], [0], "label_ids must be positive"),
    (payload(body="x"), [], list(range(1, 102)), "label_ids cannot contain more than 100"),
    (payload(body="é" * 500_001), [], [1], "body exceeds 1000000 bytes"),
    (payload(body="```mermaid\nopen"), [], [1], "block 1 is unclosed"),
    (payload("decision", choice="a", question=" "), [], [1], "question must not be empty"),
    (payload("decision", choice="a", decided_at="soon"), [], [1], "decided_at must be"),
    (payload("evidence", claim="a", impact=""), [FULL], [1], "impact must not be empty"),
    (payload("metric", name="l", value=float("nan"), unit="ms", dimensions={}), [FULL], [1], "finite"),
    (payload("metric", name="l", value=float("inf"), unit="ms", dimensions={}), [FULL], [1], "finite"),
    (payload("metric", name="l", value=1.0, unit="ms", dimensions={}, interval=SPAN), [FULL], [1], "must not precede"),
    (payload("metric", name="l", value=1.0, unit="ms", dimensions={}, interval=SPAN[::-1],
             observed_at="2026-01-01T00:00:00Z"), [FULL], [1], "both observed_at and interval"),
    (payload("metric", name="l", value=1.0, unit="ms", dimensions={"a": "x\ny"}), [FULL], [1], "dimension value"),
    (payload("metric", name="l", value=1.0, unit="ms", dimensions={"a": "x"}, method=""), [FULL], [1], "method must not"),
    (payload("note", body="x"), [FULL] * 101, [1], "sources cannot contain more than 100"),
    (payload("note", body="x"), [FULL, (" ",) + (None,) * 5], [1], "source identity"),
    (payload("note", body="x"), [("a", " ", None, None, None, None)], [1], "source locator"),
    (payload("poem"), [], [1], "kind is not known"),
]


def test_record_rules(spark):
    rows = [(i, 1, "title", p, s, labels) for i, (p, s, labels, _) in enumerate(CASES)]
    df = spark.createDataFrame(
        rows,
        f"i int, scope_id bigint, title string, payload {PAYLOAD.simpleString()}, "
        f"sources array<{SOURCE.simpleString()}>, label_ids array<bigint>",
    )
    error = quality.record(*[F.col(c) for c in ("scope_id", "title", "label_ids", "payload", "sources")])
    got = {r["i"]: r["e"] for r in df.select("i", error.alias("e")).collect()}
    for i, (_, _, _, want) in enumerate(CASES):
        if want is None:
            assert got[i] is None, (i, got[i])
        else:
            assert got[i] and want in got[i], (i, got[i], want)


@pytest.mark.parametrize(
    ("text", "ok"),
    [("2026-08-30T10:00:00Z", True), ("2026-08-30t10:00:00.123456789+02:00", True),
     ("2026-08-30T10:00:00", False), ("2026-02-30T10:00:00Z", False), ("now", False),
     ("2026-08-30T25:00:00Z", False), ("today", False), ("epoch", False)],
)
def test_timestamps(spark, text, ok):
    row = spark.range(1).select(quality.timestamp_error("x", F.lit(text)).alias("e")).first()
    assert (row["e"] is None) is ok


def test_scope_name_and_split(spark):
    df = spark.createDataFrame([[" GLOBAL "], ["Work "], ["\n"]], "name string")
    good, bad = quality.split(df, quality.single_line("scope name", F.col("name"), 200))
    assert [r[0] for r in good.select(quality.scope_name(F.col("name"))).collect()] == ["global", "Work"]
    assert bad.count() == 1
