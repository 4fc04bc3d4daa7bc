"""Incident tables derived from the order tables of the test data.

One order is one raw incident. The raw text columns hold junk, blanks, NULLs
and values out of range on purpose, so that cleaning has work to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelmark.functions.features import attack_completed
from keelmark.functions.risk import risk_band
from keelmark.operators.cleaning import clean

ATTACKS_BY_SCORE = [
    (1, "Suspicious"), (4, "Attempted"), (5, " Boarding "), (18, "Boarded"),
    (20, "Hijacked"), (22, "Fired Upon"), (24, "Detained"),
]
STATUSES = [
    "Berthed", "Moored", "Anchored", "Stationary", "Grounded", "Drifting",
    "Towed", "Fishing", "Steaming", "Underway", "   ", "None",
]
REGION_NAMES = {
    "AFRICA": "Sub-Saharan Africa",
    "AMERICA": "South America",
    "ASIA": "South Asia",
    "EUROPE": "Europe & Central Asia",
}


TABLE_COLUMNS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The needed columns; a stated schema saves the job that infers it."""
    return spark.read.schema(TABLE_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _decimal_text(whole: Column, key: Column, factor: int) -> Column:
    """Text ``whole.dd``; the key is reduced first so that no product overflows."""
    hundredths = (key % 100) * factor % 100
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(hundredths.cast("string"), 2, "0"))


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    x = F.floor(F.col("o_totalprice") / 10000).cast("long")
    score = (key * 37 + customer) % 20 + F.when(x < 20, 5).otherwise(0)

    attack = F.when(key % 211 == 1, F.lit(None).cast("string")).when(key % 199 == 1, "Unlisted")
    for edge, name in ATTACKS_BY_SCORE:
        attack = attack.when(score < edge, name)
    status = F.element_at(
        F.array(*[F.lit(s) for s in STATUSES]), ((key * 17 + customer) % 12 + 1).cast("int")
    )
    region = F.lit("Unmapped Waters")
    for name, label in REGION_NAMES.items():
        region = F.when(F.col("r_name") == name, label).otherwise(region)

    orders = _table(spark, sf_dir, "orders")
    places = (
        _table(spark, sf_dir, "nation")
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    customers = _table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, customer == F.col("c_custkey")).select(
        key.alias("incident_id"),
        F.when(key % 997 == 5, "n/a").when(key % 991 == 7, "1850")
        .otherwise(F.year("o_orderdate").cast("string")).alias("year"),
        F.when(key % 983 == 3, "13").otherwise(F.month("o_orderdate").cast("string")).alias("month"),
        _decimal_text(key % 360 * 7919 % 360 - 180, key, 104729).alias("longitude"),
        F.when(key % 503 != 2, _decimal_text(key % 181 * 31 % 181 - 90, key, 1299709)).alias("latitude"),
        attack.otherwise("Explosion").alias("attack_type"),
        status.alias("vessel_status"),
        F.when(key % 787 == 9, "-1.00").otherwise(_decimal_text(x * x, key, 15485863)).alias("shore_distance"),
        F.col("n_name").alias("nearest_country"),
        region.alias("region"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_incidents(spark, sf_dir))


def scored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned incidents with a fixed pseudo-probability in place of a model's."""
    pct = (F.col("incident_id") % 10001 * 7907 % 10001).cast("double") / 100
    return incidents(spark, sf_dir).withColumns({
        "attack_occurred": attack_completed(F.col("attack_type")),
        "attack_probability_pct": pct,
        "risk_band": risk_band(pct),
    })


def quote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing requests: NULL asks for a default, some values are invalid."""
    key = F.col("incident_id")
    null = F.lit(None).cast("double")
    return incidents(spark, sf_dir).select(
        key.alias("request_id"),
        F.when(key % 97 == 11, 1.25).when(key % 89 == 7, -0.1)
        .otherwise((key % 10001 * 7907 % 10001).cast("double") / 10000).alias("p_attack"),
        "region",
        F.when(key % 83 == 5, 0.0).when(key % 4 == 0, null)
        .otherwise((key % 500 + 1).cast("double") * 500000.0).alias("insured_value"),
        F.when(key % 3 == 0, null).otherwise((key % 76 + 5).cast("double") / 100).alias("lgd"),
        F.when(key % 3 == 1, null).otherwise((key % 61).cast("double") / 100).alias("theta"),
        F.when(key % 3 == 2, null).otherwise((key % 50 + 1).cast("double") / 10000).alias("base_rate"),
    )
