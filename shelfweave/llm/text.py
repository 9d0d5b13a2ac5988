"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(*columns: Column) -> Column:
    """A 128-bit key of the given values, NULL apart from the empty text.

    Rows that repeat all the values share a key, and whatever is computed from those
    values alone holds for each of them.
    """
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.md5(F.concat(*parts))


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learned from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def packed(df: DataFrame, **derived: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside derived columns, so that names cannot clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), *[value.alias(name) for name, value in derived.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The columns that ``packed`` put into ``row``."""
    return df.select("row.*")
