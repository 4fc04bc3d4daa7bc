"""Rounding of doubles, ties to even.

``F.bround`` rounds the shortest decimal text of a double and so differs in
ties from arithmetic rounding. Two kinds are needed: the one of array
libraries, for columns, and correct rounding of the binary value, for quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Veltkamp's constant: splits a double into two halves of 26 bits.
SPLITTER = 134217729.0
# From here on the gaps between doubles are wider than those between the decimals.
WHOLE_FROM = 2.0 ** 53


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded(col: Column | str, digits: int) -> Column:
    """Scale, round to the nearest integer, scale back."""
    factor = F.lit(10.0 ** digits)
    return F.rint(_column(col) * factor) / factor


def rounded_exactly(col: Column | str, digits: int) -> Column:
    """Nearest decimal of the exact binary value: 2.675 is below its tie.

    Scaling can land on a tie that the exact product misses. The error of the
    product (Dekker's, free of rounding) then tells which side is right.
    """
    x, factor = _column(col), 10.0 ** digits
    product = x * F.lit(factor)
    high = x * F.lit(SPLITTER) - (x * F.lit(SPLITTER) - x)
    low = x - high
    factor_high = SPLITTER * factor - (SPLITTER * factor - factor)
    factor_low = factor - factor_high
    error = ((high * factor_high - product) + high * factor_low + low * factor_high) + low * factor_low
    nearest = F.rint(product)
    tie = F.abs(product - nearest) == 0.5
    whole = (
        F.when(tie & (error > 0), product + 0.5)
        .when(tie & (error < 0), product - 0.5)
        .otherwise(nearest)
    )
    return F.when(F.abs(product) >= WHOLE_FROM, x).otherwise(whole / F.lit(factor))
