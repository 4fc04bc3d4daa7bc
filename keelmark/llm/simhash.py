"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keelmark.llm.components import connected_components
from keelmark.llm.runtime import prepare, saved, tidy

SEED = 42
DISTANCE = 4
#: The most fingerprints of a table entry that are compared in one group.
BLOCK = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(width, len(words))
    last = ends[k - 1:].tolist()
    first = [0, *(ends[:len(words) - k] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(body[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
    counts = np.empty((8, 8), dtype=np.int64)
    for i, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        counts[i] = np.bincount(column, minlength=256) @ _BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(x.as_py()) for x in texts), dtype=np.int64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])


def _links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each run of equal keys, what is connected by full distances.

    A run is searched breadth first: what is near the present fingerprint leaves
    the unvisited ones, so a run of n yields fewer than n edges.
    """
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    sizes = np.diff(starts, append=len(keys))
    two = starts[sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance
    a, b = [prints[two[near]]], [prints[two[near] + 1]]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left = np.unique(prints[start:start + size])
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = np.bitwise_count(left ^ x) <= distance
                if hit.any():
                    found = left[hit]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    todo.extend(found)
                    left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _linking(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key; a batch's last run waits for the next batch."""
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(keys, prints, distance)
            pairs = np.unique(np.stack([a, b]), axis=1).view(np.int64)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            earlier = np.flatnonzero(keys != keys[-1])
            if len(earlier):
                cut = int(earlier[-1]) + 1
                yield from edges(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield from edges(keys, prints)

    return link


def hamming_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of at most ``distance`` differing bits.

    ``prints`` has one column of distinct 64-bit numbers. At most four differing bits
    leave one half with at most two. So every number is entered into both tables, one
    for each half, under the half itself and under the 32 values one bit away: two
    halves at most two bits apart meet in an entry. An entry's numbers are then compared over
    all 64 bits. Each number makes 66 rows whatever the data are. An entry of more than
    ``BLOCK`` numbers is cut into blocks, and each pair of blocks is a group of its own.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the balls of radius one find distances up to 4")
    (name,) = prints.columns
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    low = F.col(name).bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned(name, 32)
    entries = (
        prints.select(F.col(name).alias("print"), F.posexplode(F.array(low, high)).alias("half", "value"))
        .select("print", "half", "value", F.explode(ball).alias("flip"))
        .select(F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), "print")
    )
    shared = entries.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    out = "a long, b long"
    usual = shared.where(F.col("n") <= BLOCK).select("key", "print").mapInArrow(_linking(distance), out)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("print"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")),
    )
    large = (
        shared.where(F.col("n") > BLOCK).select("key", "print", F.explode(pairs).alias("pair"))
        .select(F.xxhash64("key", "pair.i", "pair.j").alias("key"), "print")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_linking(distance), out)
    )
    return usual.union(large)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits) and component_id.

    Words are runs of characters other than the six ASCII spaces, A-Z in lower case; a
    fingerprint takes every shingle of four words (fewer words: all of them), repeats
    included. Null and wordless texts have fingerprint zero, linked like any other. Texts whose
    fingerprints differ in at most ``distance`` bits are linked; component_id is the smallest
    id reachable. Rows of a null id get a component too, named by a non-null id where it has one.

    Equal fingerprints are one node, however many rows share them, so hot groups of copies
    cost nothing beyond their scan. Fingerprints are written once; all later steps read that narrow table.
    """
    rows, labels = _components(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), distance)
    return rows.join(labels, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"),
    )


def _components(texts: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(id, print) of every row of (id, text), written, and (print, least): the smallest id of the print's component."""
    prepare(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    rows = saved(texts.mapInArrow(tidy(_fingerprints), f"id {kind}, print long"), "simhash")
    classes = saved(rows.groupBy("print").agg(F.min("id").alias("first")), "simhash-classes")
    component = connected_components(hamming_links(classes.select("print"), distance))
    named = (
        classes.join(component.withColumnRenamed("node", "print"), "print", "left")
        .select("print", "first", F.coalesce("component", "print").alias("component"))
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("least"))
    return rows, named.join(lowest, "component").select("print", "least")


def first_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, as ``near_duplicates`` finds these: the smallest id stays (null last), of rows
    that share it, or have none, one.

    Null and wordless texts are linked to each other. Columns may have any names; an empty table gives an empty one. Rows are written once; texts
    are read for their fingerprints and when the rows that stay are taken. What says that a row goes is its place in the written table: where
    these are few enough they are broadcast, so that no text moves.
    """
    rows = saved(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("uid", F.monotonically_increasing_id()), "texts"
    )
    key = F.col(f"row.`{id_col}`")
    # The row's place breaks ties of ids, and nulls come last.
    place = F.struct(key.isNull().alias("none"), key.alias("id"), "uid")
    prints, labels = _components(rows.select(place.alias("id"), F.col(f"row.`{text_col}`").cast("string").alias("text")), distance)
    gone = prints.join(labels, "print").where(F.col("id.uid") != F.col("least.uid")).select("id.uid")
    return rows.join(gone, "uid", "left_anti").select("row.*")
