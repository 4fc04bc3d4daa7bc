"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.llm import golomb
from keelmark.llm.runtime import SPACES, bucketed, prepare, saved, shuffle_partitions

#: Fingerprints that an owner decodes at once, as a mean.
OWNED = 8_000_000


def normalised(text: Column) -> Column:
    """Every run of the six ASCII spaces as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _sending(bits: int, owners: int):
    """Pass rows on, then send each owner the partition's distinct fingerprints.

    A fingerprint that the partition itself repeats needs no answer, yet is sent once,
    for other partitions. ``places`` lists row numbers by fingerprint and ``starts`` the
    first place of each; both stay with the sender.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, n = [], 0
        schema = None
        for batch in batches:
            rows = batch.num_rows
            prints = batch.column("print").to_numpy()
            seen.append(prints)
            columns = [
                batch.column("row"), batch.column("sha"), pa.array(np.full(rows, part, np.int64)),
                pa.array(np.arange(n, n + rows, dtype=np.int64)), pa.nulls(rows, pa.int64()),
                pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary()),
            ]
            names = ["row", "sha", "part", "place", "owner", "block", "places", "starts"]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            schema = out.schema
            n += rows
            yield out
        if not n:
            return
        prints = np.concatenate(seen)
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        distinct = ordered[starts]
        owner = (distinct * owners) >> bits
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(distinct)]
        sent = {"owner": [], "block": [], "places": [], "starts": []}
        for a, b in zip(cuts, cuts[1:]):
            first = int(starts[a])
            last = int(starts[b]) if b < len(starts) else n
            sent["owner"].append(int(owner[a]))
            sent["block"].append(golomb.encode(distinct[a:b]))
            sent["places"].append(order[first:last].astype(np.int32).tobytes())
            sent["starts"].append((starts[a:b] - first).astype(np.int32).tobytes())
        m = len(cuts) - 1
        columns = [
            pa.nulls(m, schema.field("row").type), pa.nulls(m, pa.string()), pa.array([part] * m, pa.int64()),
            pa.nulls(m, pa.int64()), pa.array(sent["owner"], pa.int64()), pa.array(sent["block"], pa.binary()),
            pa.array(sent["places"], pa.binary()), pa.array(sent["starts"], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return send


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers: one bit per fingerprint sent, set where other partitions sent it too."""
    lists = [golomb.decode(x) for x in blocks["block"]]
    values, at, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    repeated = np.split((counts > 1)[at], np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({
        "part": blocks["part"], "owner": blocks["owner"], "bitmap": [np.packbits(x).tobytes() for x in repeated],
    })


def _marks(rows: pd.DataFrame) -> pd.DataFrame:
    """A partition's answers as words of 64 bits, by row number: set for suspects."""
    places = []
    for bitmap, where, starts in zip(rows["bitmap"], rows["places"], rows["starts"]):
        where, starts = np.frombuffer(where, np.int32), np.frombuffer(starts, np.int32)
        runs = np.diff(starts, append=len(where))
        told = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(starts)).astype(bool)
        places.append(where[np.repeat(told | (runs > 1), runs)])
    places = np.concatenate(places)
    if not len(places):
        return pd.DataFrame({"part": pd.Series(dtype="int64"), "words": pd.Series(dtype="object")})
    words = np.zeros(int(places.max()) // 64 + 1, dtype=np.uint64)
    np.bitwise_or.at(words, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "words": [words.view(np.int64)]})


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 40,
) -> DataFrame:
    """One row per input row: row (a struct of its columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII spaces became one space; null
    counts as empty. Of equal texts the row with the smallest id is kept (a null id
    comes last; of rows that also share the id, one is kept).

    Each partition sorts the fingerprints (``bits`` of XXH64) of its rows and sends them, Golomb-coded, to the
    owners of their ranges; owners return bitmaps of those that other partitions sent. Only
    rows marked by a bitmap, the suspects, are shuffled with their texts and compared byte by byte, so
    a false match of fingerprints costs a comparison and nothing else. The rows are
    written once, bucketed by the partition that numbered them, which fixes partitions and row numbers for both
    directions: the bitmaps come to the rows, and texts of other rows than suspects never move. ``docs`` is read
    once more before, without its columns, to count its rows and partitions: owners follow from the count.
    A text shared by any part of all rows is one fingerprint per partition, then one
    partial group per task; joins of suspects to groups can be split by AQE.
    """
    spark = docs.sparkSession
    prepare(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = normalised(F.col(f"row.`{text_col}`"))
    prepared = docs.select(row.alias("row")).select(
        "row", F.sha2(text, 256).alias("sha"), F.shiftrightunsigned(F.xxhash64(text), 64 - bits).alias("print"),
    )
    kind = prepared.schema["row"].dataType.simpleString()
    count = docs.select(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.max("p").alias("last")).first()
    owners = max(shuffle_partitions(spark), -(-count["rows"] // OWNED))
    stored = bucketed(prepared.mapInArrow(
        _sending(bits, owners),
        f"row {kind}, sha string, part long, place long, owner long, block binary, places binary, starts binary",
    ), "fingerprints", (count["last"] or 0) + 1, "part")
    sent = stored.where("owner is not null")
    answers = sent.select("part", "owner", "block").groupBy("owner").applyInPandas(
        _answer, "part long, owner long, bitmap binary"
    )
    marks = saved(
        sent.select("part", "owner", "places", "starts").join(answers, ["part", "owner"])
        .groupBy("part").applyInPandas(_marks, "part long, words array<long>"),
        "marks",
    )
    # Marks take a bit a row: each bucket hashes its own few, so its rows are neither shuffled nor sorted.
    word = F.get("words", (F.col("place") / 64).cast("int"))
    rows = (
        stored.where("owner is null").join(marks.hint("shuffle_hash"), "part", "left")
        .withColumn("suspect", F.coalesce(word.bitwiseAND(F.expr("shiftleft(1L, cast(place % 64 as int))")) != 0, F.lit(False)))
        .select("row", "sha", "part", "place", "suspect", F.col(f"row.`{id_col}`").alias("id"))
    )
    suspects = rows.where("suspect").withColumn("body", text)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "part", "place")
    # Written, so that AQE may split the join below where one text has many rows.
    groups = saved(
        suspects.groupBy("sha", "body").agg(F.min(order).alias("first"), F.count("*").alias("size")), "equal-texts"
    )
    compared = suspects.join(groups, ["sha", "body"]).select(
        "row", F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        ((F.col("first.part") == F.col("part")) & (F.col("first.place") == F.col("place"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    single = rows.where("not suspect").select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(compared)
