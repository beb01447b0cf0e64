"""Text expressions: whitespace, tokens, number printing, Unicode normalization."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode White_Space as a character class; Java's \s alone is ASCII.
WS = r"[\t-\r\x{85}\p{Z}]"


def _accent_table() -> tuple[str, str]:
    """Latin letters U+00C0..U+024F with a canonical decomposition, and their base letters."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1:
            accented.append(chr(code))
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def utrim(text: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """Trim and collapse every whitespace run to one space."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def trim_option(text: Column) -> Column:
    """Blank optional text becomes null."""
    return F.nullif(utrim(text), F.lit(""))


def blank(text: Column) -> Column:
    return utrim(text) == ""


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits, in order."""
    folded = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace-separated terms; an empty array for blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def json_number(value: Column) -> Column:
    """A double printed as JSON: shortest digits, plain notation from 1e-5 up to 1e16."""
    plain = F.regexp_replace(value.cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    text = value.cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"\.0E", "e"), "E", "e")
    size = F.abs(value)
    return (
        F.when(value == 0, text)
        .when((size >= 1e-5) & (size < 1e16), plain)
        .otherwise(short)
    )


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC normalization, which Spark has no function for."""
    for text in batches:
        yield text.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalized(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a text column in NFKC and its whitespace collapsed.

    Rows are parted first: a UDF under a condition would still get every row, and ASCII text is
    in NFKC already. Rows with a null text stay.
    """
    ascii_only = F.coalesce(F.octet_length(column) == F.char_length(column), F.lit(True))
    plain = rows.filter(ascii_only).withColumn(column, squeeze(F.col(column)))
    other = rows.filter(~ascii_only).withColumn(column, squeeze(nfkc(F.col(column))))
    return plain.unionByName(other)
