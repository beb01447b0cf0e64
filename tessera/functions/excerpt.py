"""Excerpts: a byte-limited window of a text around the longest query term it contains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MARK = "…"
MIN_TERM_CHARS = 3
EDGES = regex.compile(r"^[^\p{Alphabetic}\p{N}_-]+|[^\p{Alphabetic}\p{N}_-]+$")
SPACE = regex.compile(r"\p{White_Space}+")


def query_terms(query: str) -> list[str]:
    stripped = (EDGES.sub("", t).lower() for t in SPACE.split(query))
    return [t for t in stripped if len(t) >= MIN_TERM_CHARS]


def boundary(data: bytes, at: int) -> int:
    """Largest character boundary of UTF-8 ``data`` that is not after ``at``."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def focus(folded: str, terms: list[str]) -> int:
    """Byte position of the longest term found; the last of equally long ones."""
    found = [(len(t.encode()), i, t) for i, t in enumerate(terms) if t in folded]
    if not found:
        return 0
    return len(folded[: folded.index(max(found)[2])].encode())


def centred(flat: str, query: str) -> tuple[bytes, int]:
    """UTF-8 bytes of a whitespace-collapsed text, and where its excerpt should centre."""
    return flat.encode(), focus(flat.lower(), query_terms(query))


def window(data: bytes, centre: int, max_bytes: int) -> str:
    """At most ``max_bytes`` of ``data`` around ``centre``, cut marks included."""
    if max_bytes <= 0:
        return ""
    if len(data) <= max_bytes:
        return data.decode()
    mark = len(MARK.encode())
    lead = mark if centre > 0 else 0
    room = max(0, max_bytes - lead - mark)
    start = boundary(data, max(0, centre - room // 3))
    end = max(start, boundary(data, start + room))
    if end == len(data):
        start = boundary(data, len(data) - max(0, max_bytes - lead))
    middle = data[start:end].decode()
    return (MARK if start > 0 else "") + middle + (MARK if end < len(data) else "")


def excerpt(text: str, query: str, max_bytes: int) -> str:
    flat = SPACE.sub(" ", text).strip(" ")
    return window(*centred(flat, query), max_bytes)


@F.pandas_udf(T.StringType())
def excerpts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Excerpts of texts whose whitespace is collapsed already."""
    for texts, queries, sizes in batches:
        yield pd.Series(
            [window(*centred(t, q), int(n)) for t, q, n in zip(texts, queries, sizes, strict=True)]
        )
