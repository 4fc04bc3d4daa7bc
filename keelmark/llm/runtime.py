"""What the operators share: importable workers, written tables, sizes."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import keelmark
from keelmark.session import new_folder, remove_folders

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(keelmark.__file__)))
#: Java, RE2 and Python read this class alike.
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut and any
    executor can read it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that ``bucketed`` made in this program and ``remove_intermediates`` has not yet dropped.
_tables: list[str] = []


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """As ``saved``, in ``buckets`` by ``column``: joins and groups on that column read rows where they lie."""
    spark = df.sparkSession
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", buckets)
    table = f"keelmark_{name}_{uuid.uuid4().hex}"
    _tables.append(table)
    (
        df.write.option("path", new_folder(spark, name)).option("compression", "zstd")
        .bucketBy(buckets, column).saveAsTable(table)
    )
    return spark.table(table)


def remove_intermediates(spark: SparkSession) -> None:
    """Drop all tables and delete all folders that the operators wrote in this program. Call it once their results have
    been written: a result that is not yet computed reads them."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables[-1]}")
        _tables.pop()
    remove_folders(spark)


def give_back() -> None:
    """Return freed memory to the system. Workers are used again by later stages, whose needs would else add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back when its task ends."""
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hashed_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the rule that holds rows out of a fit."""
    return F.crc32(column.cast("string")) % n
