"""Bounded samples of distinct labelled texts, for fits on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Slices of the hashes, limited one by one before a label's rows meet in one task.
SLICES = 64


def sample_texts(labelled: DataFrame, texts: DataFrame, rows: int, chars: int) -> dict[object, list[str]]:
    """For each label, ``rows`` of its distinct texts at most, in the order of their hashes.

    Texts are of any length; of one of more than ``chars`` characters a stretch of that length is taken, placed by its hash.

    ``labelled`` has label and h, ``texts`` has text and h, the XXH64 of the text. Labels meet
    hashes only; texts are then picked by the chosen hashes. No more than labels x rows texts reach the driver.
    """
    chosen = labelled.select("label", "h").distinct().withColumn("slice", F.pmod("h", F.lit(SLICES)))
    for keys in (["label", "slice"], ["label"]):
        least = Window.partitionBy(*keys).orderBy("h")
        chosen = chosen.withColumn("n", F.row_number().over(least)).where(F.col("n") <= rows)
    chosen = chosen.collect()
    hashes = sorted({r["h"] for r in chosen})
    # One hash, one text; rows that share it are cut before they meet.
    start = (F.pmod(F.col("h"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1).cast("int")
    picked = texts.where(F.col("h").isin(hashes)).groupBy("h").agg(F.min(F.col("text").substr(start, F.lit(chars))).alias("text"))
    by_hash = {r["h"]: r["text"] for r in picked.collect()}
    out: dict[object, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (str(r["label"]), r["n"])):
        if r["h"] in by_hash:
            out.setdefault(r["label"], []).append(by_hash[r["h"]])
    return out
