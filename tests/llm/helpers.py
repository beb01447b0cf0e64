"""Documents with everything that may come along, and empty tables."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use inside
    "row string, digest string, rep bigint, bucket bigint, kept boolean, score double, chunk bigint, "
    "shard bigint, ids string, words string, n_words string, label string, component string"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "r", "d", 1, 2, True, 0.5, 3, 4, "i", "w", "n", "l", "c")


def words(n, seed, letters="abcdefghij"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)]


def edge_rows():
    base = " ".join(words(80, 1))
    near = base.split()
    near[40] = "changed"
    passage = " ".join(words(50, 2))
    long = " ".join(words(60_000, 3))
    line = "A line that repeats in the table"
    return [
        row(1, None),
        row(2, ""),
        row(3, " \n\t\r\n "),
        row(4, "one"),
        row(5, "One"),
        row(6, "two words here now"),
        row(7, base),
        row(8, base.upper()),
        row(9, " ".join(near)),
        row(9, " ".join(near)),
        row(10, f"{line}\n{base}x\n  {line.lower()}\t\n{line}"),
        row(11, f"{line}\nother text of its own\n{line}"),
        row(12, f"before {passage} after {passage} end"),
        row(13, f"x {passage} y"),
        row(14, long),
        row(15, "tab\x0bword\x1cnot split   wide Ünïcödé \U0001f600\U0001f600 日本語"),
        row(16, "a b " * 300, None),
        row(17, "$$$ ### " + "<|endoftext|> " * 3 + "it's we'll 123 4567"),
        row(None, base),
        row(None, f"{line}\nno id"),
        row(-5, "negative id with some text"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(rows):
    """Rows in an order that doesn't depend on Spark."""
    return sorted((tuple(r) for r in rows), key=repr)
