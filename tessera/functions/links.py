"""Note links: ``[[note:7|label]]``, with ``\\``, ``|`` and ``]`` escaped in the label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the link pattern. Possessive repeats keep the matcher from recursing.
LINK = (
    r"\[\[note:(\d+)\|[^\n\r|\\\]]*+(?:(?:\\[\\|\]]|\](?!\]))[^\n\r|\\\]]*+)*+\]\]"
)


def link_ids(body: Column) -> Column:
    """Ids of all links in order; null where the number is zero or does not fit."""
    texts = F.regexp_extract_all(body, F.lit(LINK), F.lit(1))
    return F.transform(
        texts, lambda t: F.when(t.try_cast("bigint") > 0, t.try_cast("bigint"))
    )


def targets(body: Column) -> Column:
    """Distinct valid link targets, in order of first use."""
    return F.array_distinct(F.filter(link_ids(body), lambda i: i.isNotNull()))


def redact(body: Column, visible: Column) -> Column:
    """Body without the links whose target is not in ``visible``."""
    pieces = F.split(body, LINK, -1)
    links = F.regexp_extract_all(body, F.lit(LINK), F.lit(0))
    kept = F.transform(
        F.arrays_zip(links.alias("link"), link_ids(body).alias("id")),
        lambda z: F.when(
            z["id"].isNull() | F.array_contains(visible, z["id"]), z["link"]
        ).otherwise(""),
    )
    joined = F.zip_with(
        pieces, kept, lambda piece, link: F.concat(piece, F.coalesce(link, F.lit("")))
    )
    return F.array_join(joined, "")
