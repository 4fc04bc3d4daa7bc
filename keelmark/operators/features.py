"""Feature table of the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.constants import TOP_COUNTRIES
from keelmark.functions import features as fx
from keelmark.functions.statistics import share_pct
from keelmark.schema import CATEGORICAL_FEATURES

ENCODED_COLUMNS = ["attack_type", "vessel_status", "nearest_country", "month", "shore_distance"]


def row_features() -> dict[str, Column]:
    """The features that follow from a row alone."""
    sine, cosine = fx.season(F.col("month"))
    return {
        "log_shore_distance": F.log1p("shore_distance"),
        "month_sin": sine,
        "month_cos": cosine,
        "dist_gulf_aden_km": fx.hotspot_km(F.col("latitude"), F.col("longitude")),
        "abs_latitude": F.abs("latitude"),
        "lon_lat_interaction": F.col("longitude") * F.col("latitude"),
        "attack_severity": fx.attack_severity(F.col("attack_type")),
        "vessel_vulnerability": fx.vessel_vulnerability(F.col("vessel_status")),
        "attack_occurred": fx.attack_completed(F.col("attack_type")),
    }


def add_row_features(df: DataFrame, *names: str) -> DataFrame:
    """Some of the features of ``row_features``, all by default."""
    columns = row_features()
    return df.withColumns({name: columns[name] for name in names or columns})


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by name."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column)).limit(n).select(column)
    )


def group_rare(
    df: DataFrame, column: str = "nearest_country", output: str = "country_grouped", n: int = TOP_COUNTRIES,
) -> DataFrame:
    """Keep the n most frequent values, name all others ``Other``.

    The n kept values are the only thing that is broadcast.
    """
    kept = top_values(df, column, n).select(F.col(column).alias("_kept"))
    return (
        df.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left")
        .withColumn(output, F.coalesce("_kept", F.lit("Other")))
        .drop("_kept")
    )


def year_trend(df: DataFrame) -> Column:
    """Years since the first one of ``df``, which is a scalar subquery."""
    return F.col("year") - df.agg(F.min("year").alias("first")).scalar()


def add_year_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("year_trend", year_trend(df))


def class_balance(df: DataFrame, label: str = "attack_occurred") -> DataFrame:
    positive, rows = F.count_if(F.col(label) == 1), F.count(F.lit(1))
    return df.agg(
        positive.alias("n_positive"),
        (rows - positive).alias("n_negative"),
        share_pct(positive, rows).alias("pct_positive"),
    )


def drop_encoded(df: DataFrame) -> DataFrame:
    return df.drop(*ENCODED_COLUMNS)


def add_features(df: DataFrame, country_top_n: int = TOP_COUNTRIES) -> DataFrame:
    """All derived columns next to the raw ones, so that scores need no join back."""
    grouped = df.transform(group_rare, n=country_top_n)
    return grouped.withColumns({**row_features(), "year_trend": year_trend(df)})


def engineer_features(df: DataFrame, country_top_n: int = TOP_COUNTRIES) -> tuple[DataFrame, list[str]]:
    """Feature table without the raw columns, and the names of its categorical columns."""
    return add_features(df, country_top_n).transform(drop_encoded), list(CATEGORICAL_FEATURES)
