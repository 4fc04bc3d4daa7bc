"""Profiles of a table: missing values, categories, moments, outliers, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelmark.constants import IQR_MULTIPLIER
from keelmark.functions.rounding import rounded
from keelmark.functions.statistics import adjusted_skewness, share_pct
from keelmark.operators.quantiles import (
    column_quantiles, long_values, quantiles_of_rows, value_rows,
)
from keelmark.operators.reshape import rows_per_column
from keelmark.schema import NUMERIC_COLUMNS, TEXT_COLUMNS

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, missing values and their share in percent."""
    types = dict(df.dtypes)
    missing: dict[str, Column] = {
        c: F.count_if(F.col(c).isNull() | F.isnan(c)) if types[c] in ("double", "float")
        else F.count_if(F.col(c).isNull())
        for c in df.columns
    }
    rows = F.count(F.lit(1))
    return rows_per_column(df, df.columns, {
        "dtype": lambda c: F.lit(types[c]),
        "n_rows": lambda c: rows,
        "n_missing": lambda c: missing[c],
        "pct_missing": lambda c: share_pct(missing[c], rows),
    })


def categorical_summary(df: DataFrame, columns: list[str] = TEXT_COLUMNS, top: int = 8) -> DataFrame:
    """The most frequent values of each column, ties by name.

    ``n_distinct`` counts all values and ``n_more`` those that are not shown.
    Spark limits the window per task before its shuffle, so that a column of
    high cardinality sends only ``top`` rows from each task.
    """
    counts = (
        df.select(*columns).unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    by_frequency = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(by_frequency)).where(F.col("rank") <= top)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return ranked.join(F.broadcast(distinct), "column").select(
        "column", "rank", "value", "n", "n_distinct",
        F.greatest(F.col("n_distinct") - top, F.lit(0)).alias("n_more"),
    )


def numeric_summary(
    df: DataFrame, columns: list[str] = NUMERIC_COLUMNS, digits: int = 3, exact: bool = True,
) -> DataFrame:
    """Count, mean, spread, quartiles and skewness, one row per column.

    Exact quartiles and the moments come from one written table of (column, value), so ``df`` is made once.
    """
    measures = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": adjusted_skewness,
    }
    names = ["mean", "std", "min", "q25", "q50", "q75", "max", "skew"]
    if exact:
        values = value_rows(long_values(df, columns), ["column"], "value")
        found = values.groupBy("column").agg(*[make("_value").alias(name) for name, make in measures.items()])
        places = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(columns)]
        moments = (
            df.sparkSession.range(1).select(F.inline(F.array(*places)))
            .join(F.broadcast(found), "column", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
        )
        quartiles = quantiles_of_rows(values, ["column"], QUARTILES, fixed_keys=True)
    else:
        moments = rows_per_column(df, columns, {
            name: lambda c, make=make: make(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
            for name, make in measures.items()
        })
        quartiles = column_quantiles(df, columns, QUARTILES, exact=False)
    return (
        moments.join(F.broadcast(quartiles), "column", "left")
        .select("position", "column", "count", *[rounded(n, digits).alias(n) for n in names])
        .orderBy("position").drop("position")
    )


def outliers_iqr(
    df: DataFrame, columns: list[str], multiplier: float = IQR_MULTIPLIER, digits: int = 3,
) -> DataFrame:
    """Quartiles, fences and the rows strictly outside them; no row is removed."""
    values = value_rows(long_values(df, columns), ["column"], "value")
    quartiles = quantiles_of_rows(values, ["column"], {"q1": 0.25, "q3": 0.75}, fixed_keys=True)
    spread = F.col("q3") - F.col("q1")
    fences = (
        quartiles.withColumn("iqr", spread)
        .withColumn("lower_fence", F.col("q1") - F.col("iqr") * multiplier)
        .withColumn("upper_fence", F.col("q3") + F.col("iqr") * multiplier)
    )
    value, n = F.col("_value"), F.col("_n")
    outside = (value < F.col("lower_fence")) | (value > F.col("upper_fence"))
    names = ["q1", "q3", "iqr", "lower_fence", "upper_fence"]
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        values.join(F.broadcast(fences), "column")
        .groupBy("column", *names)
        .agg(F.sum(F.when(outside, n).otherwise(0)).alias("n_outliers"))
        .select(
            "column", *[rounded(c, digits).alias(c) for c in names], "n_outliers",
            rounded(share_pct(F.col("n_outliers"), rows), 2).alias("pct_outliers"),
        )
    )


def correlation_with(
    df: DataFrame, target: str = "shore_distance", columns: list[str] = NUMERIC_COLUMNS, digits: int = 4,
) -> DataFrame:
    """Pearson correlation of each column with the target, strongest first."""
    others = [c for c in columns if c != target]
    rows = rows_per_column(df, others, {
        "correlation": lambda c: F.corr(F.col(c).cast("double"), F.col(target).cast("double"))
    })
    return (
        rows.orderBy(F.abs("correlation").desc_nulls_last(), "column")
        .select("column", rounded("correlation", digits).alias("correlation"))
    )


def explore_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    """The three profiles as one long table: profile, column, item, measure, value."""
    def long(table: DataFrame, profile: str, item: Column, measures: list[str]) -> DataFrame:
        doubles = [F.col(m).cast("double").alias(m) for m in measures]
        return table.select(F.lit(profile).alias("profile"), "column", item.alias("item"), *doubles).unpivot(
            ["profile", "column", "item"], measures, "measure", "value"
        )

    nothing = F.lit("")
    return (
        long(categorical_summary(df), "categories", F.col("value"), ["rank", "n", "n_distinct", "n_more"])
        .unionByName(long(numeric_summary(df, digits=digits), "numbers", nothing,
                          ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew"]))
        .unionByName(long(correlation_with(df, digits=digits), "correlation", nothing, ["correlation"]))
    )


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """The three profiles of a cleaned incident table."""
    return {
        "categories": categorical_summary(df),
        "numbers": numeric_summary(df),
        "correlation": correlation_with(df),
    }
