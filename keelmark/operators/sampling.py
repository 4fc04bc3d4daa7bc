"""Fixed-size samples, first rows and extreme rows.

All are bounded sorts: each task keeps n rows, and one task merges what they kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.constants import SEED
from keelmark.schema import PREMIUM_TABLE_COLUMNS, RECORD_COLUMNS

HASH_DIGITS = 12


def _top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, n: int, id_column: str = "incident_id", seed: int = SEED) -> DataFrame:
    """n rows without replacement, or all if there are fewer; same seed, same rows.

    The sample is the n rows with the lowest hashes. One count over the keys
    finds the lowest power of two below which there are at least n hashes, so
    about 2n rows of the whole table are sorted.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    number = F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")
    bounds = [2 ** bit for bit in range(4 * HASH_DIGITS + 1)]
    enough = F.least(*[F.when(F.count_if(number < bound) >= n, bound) for bound in bounds])
    bound = df.agg(F.coalesce(enough, F.lit(bounds[-1])).alias("bound")).scalar()
    return df.where(number < bound).orderBy(digest, id_column).limit(n)


def map_sample(df: DataFrame, n: int = 3000, id_column: str = "incident_id") -> DataFrame:
    columns = [id_column, "latitude", "longitude", "region", "year", "attack_type", "vessel_status", "shore_distance"]
    return seeded_sample(df.select(*columns), n, id_column)


def premium_sample(df: DataFrame, n: int = 2000, id_column: str = "incident_id") -> DataFrame:
    columns = ["attack_probability_pct", "total_premium_usd", "risk_band"]
    return seeded_sample(df.select(id_column, *columns), n, id_column).select(*columns)


def _first(df: DataFrame, columns: list[str], n: int, id_column: str) -> DataFrame:
    return _top(df.select(id_column, *columns), n, id_column)


def sample_records(df: DataFrame, n: int = 200, id_column: str = "incident_id") -> DataFrame:
    return _first(df, RECORD_COLUMNS, n, id_column)


def filtered_results(df: DataFrame, n: int = 50, id_column: str = "incident_id") -> DataFrame:
    return _first(df, RECORD_COLUMNS, n, id_column)


def premium_preview(df: DataFrame, n: int = 50, id_column: str = "incident_id") -> DataFrame:
    return _first(df, [c for c in PREMIUM_TABLE_COLUMNS if c in df.columns], n, id_column)


def highest_risk(df: DataFrame, k: int = 10, id_column: str = "incident_id") -> DataFrame:
    rows = df.select(id_column, *RECORD_COLUMNS)
    return _top(rows, k, F.col("attack_probability_pct").desc_nulls_last(), id_column)


def lowest_risk(df: DataFrame, k: int = 5, id_column: str = "incident_id") -> DataFrame:
    rows = df.select(id_column, *RECORD_COLUMNS)
    return _top(rows, k, F.col("attack_probability_pct").asc_nulls_last(), id_column)
