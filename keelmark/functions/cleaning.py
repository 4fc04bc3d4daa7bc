"""Coercion and text repair, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelmark.constants import NA_TEXTS, UNKNOWN, UNKNOWN_TEXTS

# Unicode white space: ASCII controls and separators, then the wider spaces.
WHITESPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def na_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NA_TEXTS), col)


def to_double(col: Column) -> Column:
    """Text to double; junk, infinities and NaN become NULL.

    Java reads ``1.5d`` and ``1.5f`` as numbers, which are junk here, so those
    letters are made unreadable first. The column is evaluated only once.
    """
    readable = F.translate(col.cast("string"), "dDfF", "????")
    return F.nanvl(readable.try_cast("double"), F.lit(None).cast("double"))


def to_int(col: Column) -> Column:
    """Text to int; junk and fractions become NULL, ``2000.0`` is 2000."""
    text, number = col.cast("string"), to_double(col)
    return F.coalesce(text.try_cast("int"), F.when(number % 1 == 0, number.try_cast("int")))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def is_unknown(text: Column) -> Column:
    """True for NULL and for stripped text that stands for nothing."""
    return text.isNull() | text.isin(*UNKNOWN_TEXTS)


def fill_unknown(text: Column) -> Column:
    return F.when(is_unknown(text), UNKNOWN).otherwise(text)
