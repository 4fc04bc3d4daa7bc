"""From one row of aggregates to one row per column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_per_column(df: DataFrame, columns: list[str], measures: dict[str, Callable[[str], Column]]) -> DataFrame:
    """All aggregates of all columns in one pass, turned into a row per column.

    ``measures`` maps an output name to a function of the column name.
    """
    row = df.agg(
        F.array(*[
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"),
                *[make(c).alias(name) for name, make in measures.items()],
            )
            for i, c in enumerate(columns)
        ]).alias("rows")
    )
    return row.select(F.inline("rows"))
