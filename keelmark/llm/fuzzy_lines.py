"""Near-duplicate lines by MinHash, exact Jaccard and distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.llm.components import connected_components
from keelmark.llm.runtime import bucketed, prepare, saved, shuffle_partitions, tidy
from keelmark.llm.words import Rolling, in_chunks, mixed

SIMILARITY, SHINGLE = 0.8, 8
#: At similarity 0.8 a pair misses all twelve bands of four once in 550 times; more similar pairs hardly ever.
BANDS, BAND_ROWS = 12, 4
#: The most lines of a candidate group that are compared together.
BLOCK = 1000
#: A line with more copies than this, and than one in ``SHARES`` of all lines, is joined with its places in shares.
COPIES, SHARES = 1000, 10_000
ASCII_SPACES = " \t\n\r\x0b\x0c"
_BINS = BANDS * BAND_ROWS
_EMPTY = np.uint64((1 << 64) - 1)
_SOURCES = np.stack([np.random.default_rng(20_240_700 + j).permutation(_BINS) for j in range(_BINS)])


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of every line's stretches of ``SHINGLE`` characters, one line after the
    other, and how many each has. A shorter line is its only shingle."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    start = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
    stop = start + np.repeat(np.minimum(sizes, SHINGLE), counts)
    return Rolling(mixed(codes + np.uint64(1))).of(start, stop), counts


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of every line, in order."""
    hashes, counts = shingle_hashes(lines)
    ends = np.cumsum(counts).tolist()
    return [np.unique(hashes[a:b]) for a, b in zip([0, *ends], ends)]


def bands_of(hashes: np.ndarray, counts: np.ndarray, bands: int = BANDS, band_rows: int = BAND_ROWS) -> np.ndarray:
    """[line, band]: hashes of the bands of one-permutation MinHash signatures, from what ``shingle_hashes`` gives.

    Each shingle's hash falls into one bin, whose least hash counts. An empty bin borrows from the first filled one of its own
    random order, which leaves equal lines equal and the chance of agreement the Jaccard similarity.
    """
    line = np.repeat(np.arange(len(counts)), counts)
    bins = ((hashes >> np.uint64(40)) * np.uint64(_BINS)) >> np.uint64(24)
    table = np.full(len(counts) * _BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(table, line * _BINS + bins.astype(np.int64), mixed(hashes) >> np.uint64(1))
    table = table.reshape(-1, _BINS)
    filled = table.copy()
    row, column = np.nonzero(table == _EMPTY)
    for turn in range(_BINS):
        if not len(row):
            break
        value = table[row, _SOURCES[column, turn]]
        got = value != _EMPTY
        filled[row[got], column[got]] = value[got]
        row, column = row[~got], column[~got]
    out = np.empty((len(counts), bands), dtype=np.uint64)
    for band in range(bands):
        held = np.full(len(counts), band + 1, dtype=np.uint64)
        for value in filled[:, band * band_rows:(band + 1) * band_rows].T:
            held = mixed(held * np.uint64(0x9E3779B97F4A7C15) + value)
        out[:, band] = held
    return out.view(np.int64)


def band_hashes(lines: list[str]) -> np.ndarray:
    """[line, band]: the bands of every line."""
    return bands_of(*shingle_hashes(lines))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            bands = band_hashes(part.column("line").to_pylist())
            uids = np.repeat(part.column("uid").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(uids)], names=["band", "uid"])


def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, first uid) for lines that share a band. Rows come ordered by both, and only a run's first line is kept."""
    band = first = None
    alone = False  # the present run has no second line yet
    for batch in batches:
        if not batch.num_rows:
            continue
        bands, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.diff(bands, prepend=bands[:1] ^ 1))
        sizes = np.diff(starts, append=len(bands))
        firsts = uids[starts]
        shared = sizes > 1
        out_uid, out_rep = [], []
        if band is not None and bands[0] == band:
            if alone:
                out_uid.append([first])
                out_rep.append([first])
            firsts[0], shared[0] = first, True
        rows = np.repeat(shared, sizes)
        out_uid.append(uids[rows])
        out_rep.append(np.repeat(firsts, sizes)[rows])
        band, first, alone = bands[-1], firsts[-1], not shared[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_uid), pa.int64()), pa.array(np.concatenate(out_rep), pa.int64())], names=["uid", "rep"]
        )


def _fetch(lines: pa.Table, wanted: pa.Table) -> pa.Table:
    """The texts of the wanted lines, each for every group that it is in."""
    if not wanted.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["group", "uid", "line"])
    ids = lines.column("uid").to_numpy()
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, wanted.column("uid").to_numpy(), sorter=order)]
    texts = lines.column("line").combine_chunks().take(pa.array(at))
    return pa.table([wanted.column("group"), wanted.column("uid"), texts], names=["group", "uid", "line"])


def links(uids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what exact similarities connect. Searched breadth first, so n lines yield fewer than n."""
    if len(uids) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [tuple(uids)] if both >= SIMILARITY * (len(sets[0]) + len(sets[1]) - both) else []
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    own = [codes[a:a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
    left = np.arange(len(uids))  # lines not reached yet, whose codes lie in ``flat``
    flat, begin = codes, starts
    out, todo = [], []
    while len(left):
        if todo:
            x = todo.pop()
        else:
            x, keep = left[0], np.arange(1, len(left))
            left = left[keep]
            flat, begin = flat[int(sizes[x]):], begin[1:] - int(sizes[x])
            if not len(left):
                break
        mark[own[x]] = 1
        both = np.add.reduceat(mark[flat], begin)
        mark[own[x]] = 0
        hit = both >= SIMILARITY * (sizes[x] + sizes[left] - both)
        if hit.any():
            found = left[hit]
            out += [(uids[x], uids[y]) for y in found.tolist()]
            todo += found.tolist()
            flat = flat[np.repeat(~hit, sizes[left])]
            left = left[~hit]
            begin = np.cumsum(sizes[left]) - sizes[left]
    return out


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by group."""
    group, uids, sets = None, [], []
    for batch in batches:
        groups, ids, lines = (c.to_pylist() for c in batch.columns)
        edges = []
        for a, b in in_chunks(lines):
            for g, u, x in zip(groups[a:b], ids[a:b], shingle_sets(lines[a:b])):
                if g != group:
                    edges += links(uids, sets) if len(uids) > 1 else []
                    group, uids, sets = g, [], []
                uids.append(u)
                sets.append(x)
        yield _edges(edges)
    if len(uids) > 1:
        yield _edges(links(uids, sets))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, ``more``, line_no from 0, line) of all lines that hold more than ASCII spaces, without those at their ends."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), *more, F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line_no", "line")
    ).withColumn("line", F.btrim("line", F.lit(ASCII_SPACES))).where("line <> ''")


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct line: doc_id and line_no of its first place, copies, keep_doc_id, keep_line_no, kept.

    Two lines are linked if their sets of 8-character shingles have a Jaccard similarity of at least 0.8. Of every
    connected group the line whose first place comes first is kept: the smallest doc_id (null last), then line_no. Candidates are lines that share a band of their
    MinHash signatures, so a few links near the threshold are missed, while every link made is exact (over 64-bit hashes of the shingles). Null and empty texts have no lines.

    Equal lines are one row from the first aggregate on. Lines of a band meet at its first line, so one pair of lines is usually compared in one
    group, not in twelve; a group of more than ``BLOCK`` lines is cut into blocks, of which each pair is a group of its own. Distinct lines are
    written once, bucketed as they lie, and read there by later steps: only lines with candidates travel again.
    """
    return _decided(text_lines(docs, id_col, text_col)).select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "copies",
        F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), (F.col("first") == F.col("keep")).alias("kept"),
    )


def _decided(found: DataFrame, *keys: Column) -> DataFrame:
    """(``keys``, first, copies, keep) of every distinct line. ``found`` has doc_id, line_no, line, and row if rows share ids."""
    spark = found.sparkSession
    prepare(spark)
    place = F.struct(F.col("doc_id").isNull().alias("n"), *[c for c in ("doc_id", "line_no", "row") if c in found.columns])
    distinct = found.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    lines = bucketed(
        distinct.withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("uid", 33).cast("int")),
        "lines", shuffle_partitions(spark), "part",
    )
    meetings = saved(
        lines.select("uid", "line").mapInArrow(tidy(_bands), "band long, uid long")
        .repartition("band").sortWithinPartitions("band", "uid").mapInArrow(meeting, "uid long, rep long").distinct(),
        "meetings",
    )
    large = saved(meetings.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large-groups")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    groups = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64("rep", F.least(mine, other), F.greatest(mine, other))
    )
    wanted = meetings.join(large, "rep", "left").select(
        F.shiftright("uid", 33).cast("int").alias("part"), "uid", F.explode(groups).alias("group")
    )
    edges = (
        lines.select("part", "uid", "line").groupBy("part").cogroup(wanted.groupBy("part"))
        .applyInArrow(_fetch, "group long, uid long, line string")
        .repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_comparing), "a long, b long")
    )
    components = connected_components(edges)
    placed = lines.select("uid", *keys, "first", "copies").join(components.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid")
    ).drop("uid")
    kept = placed.groupBy("component").agg(F.min("first").alias("keep"))
    return placed.join(kept, "component").drop("component")


def _places(rows: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, keep, kept) of every line of ``rows`` (doc_id, text, row; written, and row is unique).

    A line is known by 128 bits of hashes, which alone are joined with the decisions on distinct lines. Very common lines, fewer than ``SHARES``, are
    broadcast; their places are dealt into shares, each of which gets the decision.
    """
    found = text_lines(rows, "doc_id", "text", "row")
    keys = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g")]
    decided = saved(_decided(found, *keys), "decided-lines")
    most = max(COPIES, -(-(decided.agg(F.sum("copies")).first()[0] or 0) // SHARES))
    common = F.broadcast(decided.where(F.col("copies") > most).select("h", "g", F.ceil(F.col("copies") / most).cast("int").alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    places = found.select(*keys, "doc_id", "row", "line_no").join(common, ["h", "g"], "left").withColumn(
        "share", F.pmod(F.xxhash64("row", "line_no"), shares).cast("int")
    ).drop("shares")
    decisions = decided.join(common, ["h", "g"], "left").select("h", "g", "keep", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    kept = (F.col("row") == F.col("keep.row")) & (F.col("line_no") == F.col("keep.line_no"))
    return places.join(decisions, ["h", "g", "share"]).select("doc_id", "row", "line_no", "keep", kept.alias("kept"))


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every text, repeats included: doc_id, line_no, keep_doc_id, keep_line_no, kept.

    Lines and groups are those of ``fuzzy_lines``; of each group one place is kept, also where rows share an id or have none.
    """
    rows = saved(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")
    ), "line-texts")
    return _places(rows).select(
        "doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), "kept"
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if gone:
                gone = set(gone)
                text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "text"])


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``line_places`` does not keep taken out of the texts; blank lines and all rows stay."""
    rows = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "line-texts")
    text = F.col(f"doc.`{text_col}`").cast("string").alias("text")
    gone = _places(rows.select(F.col(f"doc.`{id_col}`").alias("doc_id"), text, "row")).where(~F.col("kept")).groupBy("row").agg(
        F.collect_list("line_no").alias("gone")
    )
    kind = rows.schema["doc"].dataType.simpleString()
    left = rows.join(gone, "row", "left").select("doc", text, "gone").mapInArrow(tidy(_without), f"doc {kind}, text string")
    return left.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
