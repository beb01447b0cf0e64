"""Tagged fenced blocks in a text: where they are and whether they are closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag, and the shape of a fence line (indent of at most three spaces).
TAG = "mermaid"
UNCLOSED = "Mermaid block {} is unclosed"
FENCE = r"^ {0,3}(`{3,}|~{3,})([^\n]*)$"

_BLOCK = "array<struct<first_line:int,last_line:int,closed:boolean>>"


def fence_scan(text: Column) -> Column:
    """Array of (first_line, last_line, closed) for each tagged block, in order, from line 1.

    Lines that cannot be a fence are dropped before the fold, which therefore costs one step
    per fence line. A fence opens when none is open; it closes on a bare fence of the same
    character that is at least as long. An open block runs to the end of the text.
    """
    lines = F.split(text, "\r?\n")
    marked = F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).alias("line"),
            F.regexp_extract(line, FENCE, 1).alias("run"),
            F.trim(F.regexp_replace(F.regexp_extract(line, FENCE, 2), "\t", " ")).alias("info"),
        ),
    )
    fence_lines = F.filter(marked, lambda m: F.length(m["run"]) > 0)
    start = F.struct(
        F.lit("").alias("run"),
        F.lit(0).alias("line"),
        F.lit(False).alias("tagged"),
        F.array().cast(_BLOCK).alias("blocks"),
    )

    def block(first: Column, last: Column, closed: bool) -> Column:
        return F.array(
            F.struct(
                first.alias("first_line"), last.alias("last_line"), F.lit(closed).alias("closed")
            )
        )

    def step(state: Column, mark: Column) -> Column:
        same = F.substring(mark["run"], 1, 1) == F.substring(state["run"], 1, 1)
        is_open = F.length(state["run"]) > 0
        closes = (
            is_open
            & same
            & (F.length(mark["run"]) >= F.length(state["run"]))
            & (mark["info"] == "")
        )
        # A backtick fence cannot have a backtick in its info text.
        opens = ~is_open & ~(mark["run"].startswith("`") & mark["info"].contains("`"))
        tagged = F.lower(F.split(mark["info"], " ")[0]) == TAG
        return F.struct(
            F.when(closes, "").when(opens, mark["run"]).otherwise(state["run"]).alias("run"),
            F.when(opens, mark["line"]).otherwise(state["line"]).alias("line"),
            F.when(opens, tagged).otherwise(state["tagged"]).alias("tagged"),
            F.when(
                closes & state["tagged"],
                F.concat(state["blocks"], block(state["line"], mark["line"], True)),
            )
            .otherwise(state["blocks"])
            .alias("blocks"),
        )

    def finish(state: Column) -> Column:
        left_open = (F.length(state["run"]) > 0) & state["tagged"]
        rest = block(state["line"], F.size(lines), False)
        return F.when(left_open, F.concat(state["blocks"], rest)).otherwise(state["blocks"])

    scanned = F.aggregate(fence_lines, start, step, finish)
    # Most texts have no fence at all.
    return F.when(text.rlike(r"(?m)^ {0,3}(```|~~~)"), scanned).otherwise(F.array().cast(_BLOCK))


def fence_error(text: Column) -> Column:
    """Message that names the first unclosed block, or null."""
    blocks = fence_scan(text)
    numbers = F.transform(blocks, lambda b, i: F.when(~b["closed"], i + 1))
    bad = F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))
    before, after = UNCLOSED.split("{}")
    return F.concat(F.lit(before), bad.cast("string"), F.lit(after))
