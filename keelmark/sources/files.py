"""CSV and Parquet files in, CSV and Parquet folders out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelmark.functions.cleaning import na_to_null
from keelmark.schema import (
    ENRICHED_COLUMNS, PREMIUM_TABLE_COLUMNS, RAW_SCHEMA, RECORD_COLUMNS, require_columns,
)

# Quotes are doubled inside quoted text, and blanks at the ends are kept.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
COPIES_PER_BLOCK = 10_000


def _without_na(raw: DataFrame) -> DataFrame:
    return raw.select(*[
        na_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in raw.schema
    ])


def load_incidents(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, multiline: bool = False,
) -> DataFrame:
    """All columns as text, with the texts that stand for a missing value as NULL.

    ``multiline`` admits line breaks inside quoted text; such files cannot be split.
    """
    return _without_na(spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multiline).csv(path))


def load_incident_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """The same for files that arrive in a folder."""
    return _without_na(spark.readStream.schema(schema).options(**CSV_OPTIONS).csv(path))


def add_incident_id(df: DataFrame, name: str = "incident_id") -> DataFrame:
    """A text key for files that have none, the same on every read.

    Equal rows are counted first and then dealt out again with numbers, in blocks of
    copies that go to different tasks.
    """
    columns = df.columns
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    n = F.col("_n")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES_PER_BLOCK)))
    )
    first = F.col("_block") * COPIES_PER_BLOCK
    dealt = blocks.repartition(*columns, "_block").withColumn(
        "_copy", F.explode(F.sequence(first, F.least(first + COPIES_PER_BLOCK, n) - 1))
    )
    return dealt.select(
        F.concat_ws("-", digest, F.col("_copy").cast("string")).alias(name), *columns
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_enriched(
    df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists",
) -> None:
    """The scored and priced table; Parquet goes into one folder per year.

    The rebalance hint gathers each year into few files and splits a year
    that is larger than the advisory partition size.
    """
    table = require_columns(df, ENRICHED_COLUMNS)
    if file_format == "csv":
        write_csv(table, path, mode)
    else:
        table.hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year").format(file_format).save(path)


def export_filtered(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(df, path, mode)


def export_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(require_columns(df, RECORD_COLUMNS).select(*RECORD_COLUMNS), path, mode)


def export_premiums(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The premium columns that the table has, in their fixed order."""
    write_csv(df.select(*[c for c in PREMIUM_TABLE_COLUMNS if c in df.columns]), path, mode)
