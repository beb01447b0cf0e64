import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import fences, links, text
from tessera.functions.excerpt import excerpt
from tessera.functions.payload import decode, payload_encode, payload_text
from tessera.schemas import PAYLOAD
from tests.helpers import payload


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_whitespace_is_unicode(spark):
    raw = "  a　\u0085b\x0b "
    assert value(spark, text.utrim(F.lit(raw))) == "a　\u0085b"
    assert value(spark, text.squeeze(F.lit(raw))) == "a b"
    assert value(spark, text.words(F.lit(raw))) == ["a", "b"]
    assert value(spark, text.words(F.lit("  "))) == []
    assert value(spark, text.trim_option(F.lit(" "))) is None


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("Élan-vital, x_1 naïve 42ème"))) == [
        "elan", "vital", "x", "1", "naive", "42eme"
    ]


@pytest.mark.parametrize(
    ("number", "shown"),
    [(12.5, "12.5"), (1.0, "1.0"), (12345678.0, "12345678.0"), (1e16, "1e16"), (1.5e300, "1.5e300"),
     (0.0001, "0.0001"), (1e-7, "1e-7"), (-3.25, "-3.25"), (0.0, "0.0"), (123456789.125, "123456789.125")],
)
def test_json_number(spark, number, shown):
    assert value(spark, text.json_number(F.lit(number))) == shown


def test_record_text_is_normalized(spark):
    """The text fields of generated payloads, with blanks and compatibility forms between them."""
    rng = random.Random(3)

    def word():
        return "".join(rng.choices("abcdeé", k=5))

    rows, want = [], []
    for _ in range(40):
        marks = {word(): word() for _ in range(rng.randrange(4))}
        number = rng.randrange(1, 400) + 0.5
        name, unit, method = word(), rng.choice([None, word()]), rng.choice([None, word()])
        title = rng.choice([None, "\ufb01" + word(), word()])
        rows.append([title, payload("metric", name=f"\t{name} ", value=number, unit=unit, dimensions=marks, method=method and f"\u00a0{method}\n")])
        shown = [title and title.replace("\ufb01", "fi"), name, str(number), unit, *(f"{k}: {marks[k]}" for k in sorted(marks)), method]
        want.append(" ".join(x for x in shown if x))
    rows += [["plain  title", payload(body=" two\twords ")], [None, payload(body="")]]
    want += ["plain title two words", ""]
    df = spark.createDataFrame(rows, f"title string, payload {PAYLOAD.simpleString()}")
    joined = df.select(F.concat_ws("\n", "title", payload_text(F.col("payload"))).alias("text"))
    got = [r[0] for r in text.normalized(joined, "text").collect()]
    assert sorted(got) == sorted(want)


def test_ascii_text_stays_out_of_python(spark, tmp_path):
    spark.createDataFrame([["a  b"], ["c\td"]], "text string").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(batch: pd.Series) -> pd.Series:
        seen.add(len(batch))
        return batch

    original, text.nfkc = text.nfkc, counted
    try:
        rows = text.normalized(spark.read.parquet(str(tmp_path / "t")), "text").collect()
    finally:
        text.nfkc = original
    assert sorted(r[0] for r in rows) == ["a b", "c d"] and seen.value == 0


def test_payload_text_and_json_of_a_metric(spark):
    p = payload("metric", name="latency", value=12.5, unit="ms", interval=("2026-01-01T00:00:00Z",
                "2026-01-02T00:00:00Z"), dimensions={"z": "1", "host": "local"}, method="timer")
    df = spark.createDataFrame([[p]], f"payload {PAYLOAD.simpleString()}")
    row = df.select(payload_text(F.col("payload")), payload_encode(F.col("payload"))).first()
    assert row[0] == (
        "latency\n12.5\nms\nstart: 2026-01-01T00:00:00Z\nend: 2026-01-02T00:00:00Z\n"
        "host: local\nz: 1\ntimer"
    )
    assert row[1] == (
        '{"kind":"metric","name":"latency","value":12.5,"unit":"ms","observed_at":null,'
        '"interval":{"start":"2026-01-01T00:00:00Z","end":"2026-01-02T00:00:00Z"},'
        '"dimensions":{"host":"local","z":"1"},"method":"timer"}'
    )
    back = decode(spark.createDataFrame([[row[1]]], "j string"), "j").first()
    assert back["decode_error"] is None and tuple(back["payload"])[:2] == p[:2]
    assert back["payload"]["dimensions"] == {"host": "local", "z": "1"}


@pytest.mark.parametrize(
    ("json", "error"),
    [
        ('{"kind":"note","body":"x"}', None),
        ('{"kind":"note","body":"x","other":1}', "unknown field"),
        ('{"kind":"note"}', "missing field"),
        ('{"kind":"poem","body":"x"}', "unknown kind"),
        ('{"kind":"note","body":3}', "wrong type"),
        ('{"kind":"note","body":true}', "wrong type"),
        ("[1]", "not an object"),
        ("plain", "not an object"),
        ('{"kind":"metric","name":"n","value":"3","unit":"u","dimensions":{}}', "wrong type"),
        ('{"kind":"metric","name":"n","value":3,"unit":"u","dimensions":{"a":1}}', "wrong type"),
        ('{"kind":"metric","name":"n","value":3,"unit":"u","dimensions":{"a, b":"1","value":"2"}}', None),
        ('{"kind":"metric","name":"n","value":3,"unit":"u","dimensions":{},"interval":{"start":"a"}}',
         "missing field"),
        ('{"kind":"metric","name":"n","value":3,"unit":"u","dimensions":{},'
         '"interval":{"start":"a","end":"b","x":"c"}}', "unknown field"),
        ('{"kind":"snippet","language":"l","code":"c","origin":"stolen"}', "wrong type"),
    ],
)
def test_decode(spark, json, error):
    row = decode(spark.createDataFrame([[json]], "j string"), "j").first()
    assert row["decode_error"] == error
    assert (row["payload"] is None) is (error is not None)


LINKED = (
    r"[[note:9|plain]] [[note:7|a \] b]] [[note:0|zero]] [[note:8|]] [[note:99999999999999999999|o]] "
    r"[[note:3|one ] bracket]] [[note:4|bare | pipe]] [[note:x|no]] [[note:5|line" + "\nbreak]]"
)


def test_links(spark):
    body = F.lit(LINKED)
    assert value(spark, links.targets(body)) == [9, 7, 8, 3]
    kept = value(spark, links.redact(body, F.array(F.lit(9), F.lit(3)).cast("array<bigint>")))
    assert kept == LINKED.replace("[[note:8|]]", "").replace(r"[[note:7|a \] b]]", "")


def scanned(lines):
    """(first, last, closed) of tagged blocks, by looking at one line after the other."""
    found, run, tagged, begun = [], None, False, 0
    for at, line in enumerate(lines, 1):
        rest = line.lstrip(" ")
        mark = rest[:1]
        size = len(rest) - len(rest.lstrip(mark)) if mark in ("`", "~") and mark else 0
        if len(line) - len(rest) > 3 or size < 3:
            continue
        info = rest[size:].replace("\t", " ").strip(" ")
        if run is None:
            if mark == "`" and "`" in info:
                continue
            run, tagged, begun = (mark, size), info.split(" ")[0].lower() == fences.TAG, at
        elif run[0] == mark and size >= run[1] and not info:
            if tagged:
                found.append((begun, at, True))
            run = None
    return found + ([(begun, len(lines), False)] if run and tagged else [])


def test_fences(spark):
    rng = random.Random(8)

    def line():
        if rng.random() < 0.4:
            return rng.choice(["", "words", "::: block", "a ``` b", "`` x", "\t```"])
        mark = rng.choice("`~") * rng.randint(2, 5)
        info = rng.choice(["", "", "", "  ", "mermaid", " MerMaid more", "mermaid\tx", "mermaids", "python", "a`b", "~"])
        return " " * rng.choice([0, 0, 0, 1, 3, 4]) + mark + info

    texts = [[line() for _ in range(rng.randrange(12))] or [""] for _ in range(1500)]
    df = spark.createDataFrame([(i, rng.choice(["\n", "\r\n"]).join(t)) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", fences.fence_scan(F.col("t")).alias("b"), fences.fence_error(F.col("t")).alias("e")).collect()}
    for i, lines in enumerate(texts):
        want = scanned(lines)
        open_ones = [n for n, b in enumerate(want, 1) if not b[2]]
        assert [tuple(b) for b in got[i]["b"]] == want, lines
        assert got[i]["e"] == (fences.UNCLOSED.format(open_ones[0]) if open_ones else None)
    assert {len(scanned(t)) for t in texts} >= {0, 1, 2}


def test_excerpt():
    body = "sand and gravel, " * 60 + "then a Lighthouse_7 at the cape, " + "rocks and kelp, " * 60
    shown = excerpt(body, "where is lighthouse_7?", 240)
    assert "Lighthouse_7" in shown
    assert (shown[0], shown[-1]) == ("…", "…")
    assert 200 < len(shown.encode()) <= 240
    assert excerpt("\n one\t\ttwo ", "none", 50) == "one two"
    assert excerpt("word", "word", 0) == ""


def test_excerpt_properties():
    rng = random.Random(5)
    alphabet = "abcdé漢 \n"
    for _ in range(500):
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        query = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        size = rng.randint(10, 200)
        shown = excerpt(body, query, size)
        flat = " ".join(body.split())
        # Moving the start back to a character boundary can add up to three bytes.
        assert len(shown.encode()) <= size + 3
        assert shown.strip("…") in flat
        if len(flat.encode()) <= size:
            assert shown == flat
