"""Clean, score and price new CSV files only.

Every step is a stateless projection, so the batch functions run unchanged on
a streaming DataFrame and no watermark or state is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelmark.operators.cleaning import clean
from keelmark.operators.premium import append_premiums
from keelmark.sources.files import load_incident_stream


def price_new_files(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, schema: T.StructType,
    add_scores: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Start one run over the files that no earlier run has seen.

    ``add_scores`` adds ``attack_probability_pct``. The checkpoint folder keeps
    which files are done, and must survive its machine.
    """
    rows = load_incident_stream(spark, in_path, schema)
    priced = append_premiums(add_scores(clean(rows)))
    return (
        priced.writeStream.format("parquet").option("path", out_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
