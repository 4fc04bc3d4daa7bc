"""Column lists, schemas and column checks shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values: column names and their order, which are the output contract ---
INTEGER_COLUMNS = ["year", "month"]
FLOAT_COLUMNS = ["longitude", "latitude", "shore_distance"]
NUMERIC_COLUMNS = ["year", "month", "longitude", "latitude", "shore_distance"]
TEXT_COLUMNS = ["attack_type", "vessel_status", "nearest_country", "region"]
INCIDENT_COLUMNS = [
    "year", "month", "longitude", "latitude", "attack_type", "vessel_status",
    "shore_distance", "nearest_country", "region",
]
SCORE_COLUMNS = ["attack_occurred", "attack_probability_pct", "risk_band"]
PREMIUM_COLUMNS = [
    "lambda_region", "expected_loss_usd", "risk_premium_usd",
    "base_premium_usd", "total_premium_usd", "premium_rate_pct",
]
ENRICHED_COLUMNS = INCIDENT_COLUMNS + SCORE_COLUMNS + PREMIUM_COLUMNS

RECORD_COLUMNS = [
    "year", "month", "region", "nearest_country", "attack_type", "vessel_status",
    "shore_distance", "attack_occurred", "attack_probability_pct", "risk_band",
]
PREMIUM_TABLE_COLUMNS = [
    "year", "month", "region", "nearest_country", "attack_type",
    "attack_probability_pct", "risk_band",
] + PREMIUM_COLUMNS

CATEGORICAL_FEATURES = ["region", "country_grouped"]
REGRESSION_TARGET = "log_shore_distance"
CLASS_TARGET = "attack_occurred"
REGRESSION_NUMERIC = [
    "year", "longitude", "latitude", "month_sin", "month_cos",
    "dist_gulf_aden_km", "abs_latitude", "lon_lat_interaction",
    "attack_severity", "vessel_vulnerability", "year_trend",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in INCIDENT_COLUMNS])
INCIDENT_SCHEMA = T.StructType(
    [T.StructField("incident_id", T.LongType())]
    + [
        T.StructField(
            c,
            T.IntegerType() if c in INTEGER_COLUMNS
            else T.DoubleType() if c in FLOAT_COLUMNS
            else T.StringType(),
        )
        for c in INCIDENT_COLUMNS
    ]
)
QUOTE_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("p_attack", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("insured_value", T.DoubleType()),
    T.StructField("lgd", T.DoubleType()),
    T.StructField("theta", T.DoubleType()),
    T.StructField("base_rate", T.DoubleType()),
])


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
