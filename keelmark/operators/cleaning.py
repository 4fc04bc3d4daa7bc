"""Cleaning: coercion, text repair, NULL and range filters, and their report.

All steps are projections and filters of one narrow stage without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.constants import DOMAIN_BOUNDS
from keelmark.functions.cleaning import fill_unknown, is_unknown, strip, to_double, to_int
from keelmark.schema import (
    FLOAT_COLUMNS, INTEGER_COLUMNS, NUMERIC_COLUMNS, TEXT_COLUMNS, require_columns,
)


def coerce_integers(df: DataFrame, columns: list[str] = INTEGER_COLUMNS) -> DataFrame:
    return df.withColumns({c: to_int(F.col(c)) for c in columns})


def coerce_floats(df: DataFrame, columns: list[str] = FLOAT_COLUMNS) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in columns})


def strip_text(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns})


def drop_critical_nulls(df: DataFrame, columns: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.dropna(subset=columns)


def fill_unknown_text(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: fill_unknown(F.col(c)) for c in columns})


def in_domain(column: str) -> Column:
    """Inclusive range test; NULL for a missing value.

    Filters move below the projection that parses the text, so each mention of
    a column parses it again. The distance from the middle of the range needs
    one mention, and is exact for these bounds.
    """
    low, high = DOMAIN_BOUNDS[column]
    if high is None:
        return F.col(column) >= low
    return F.abs(F.col(column) - (low + high) / 2) <= (high - low) / 2


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def keep_in_domain(df: DataFrame) -> DataFrame:
    return df.where(_all([in_domain(c) for c in DOMAIN_BOUNDS]))


def clean(df: DataFrame) -> DataFrame:
    """Typed, repaired and plausible rows, all other columns kept.

    A missing critical number is in no domain, so the last filter drops those
    rows as ``drop_critical_nulls`` would.
    """
    return (
        require_columns(df, NUMERIC_COLUMNS + TEXT_COLUMNS)
        .transform(coerce_integers)
        .transform(coerce_floats)
        .transform(strip_text)
        .transform(fill_unknown_text)
        .transform(keep_in_domain)
    )


def cleaning_report(df: DataFrame) -> DataFrame:
    """Counts of what ``clean`` does to a raw table, from one scan.

    Unknown texts are counted among the rows without a critical NULL.
    """
    typed = require_columns(df, NUMERIC_COLUMNS + TEXT_COLUMNS)
    typed = typed.transform(coerce_integers).transform(coerce_floats).transform(strip_text)
    complete = _all([F.col(c).isNotNull() for c in NUMERIC_COLUMNS])
    plausible = _all([in_domain(c) for c in DOMAIN_BOUNDS])
    return typed.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~complete).alias("dropped_null"),
        *[F.count_if(complete & is_unknown(F.col(c))).alias(f"filled_{c}") for c in TEXT_COLUMNS],
        F.count_if(complete & ~plausible).alias("dropped_domain"),
        F.count_if(complete & plausible).alias("rows_out"),
    )
