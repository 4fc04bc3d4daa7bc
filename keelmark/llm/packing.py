"""Packing of token sequences: best fit, decreasing, over a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.bpe import WordBpe
from keelmark.llm.runtime import prepare, saved, tidy
from keelmark.llm.words import in_chunks

WINDOW = 4096
END_ID = 2
#: Pieces that are packed together: about so many per group.
GROUP_PIECES = 20_000
GROUP = "_packed_together"


def _tokenizing(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts, 2_000_000):
                ids, ends = bpe.encode_texts(texts[a:b], end_id)
                offsets = np.concatenate([[0], 4 * ends])
                if offsets[-1] > np.iinfo(np.int32).max:
                    raise ValueError("the ids of a text exceed 2 GB")
                coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), coded], names=["doc_id", "ids"])

    return run


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each text's ids and ``end_id``, as little-endian unsigned 32-bit numbers. Null texts are empty.

    The tokenizer must neither join nor look at anything across ASCII spaces, as one that drops white space does.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _tokenizing(path, end_id), f"doc_id {kind}, ids binary"
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full windows of a long document, and what is left of it."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for batch in batches:
        rows, out = [], [[], [], [], []]
        for i, ids in enumerate(batch.column(1)):
            data = ids.as_buffer()
            n = data.size // 4
            for start in range(0, n, WINDOW):
                stop = min(start + WINDOW, n)
                rows.append(i)
                for values, x in zip(out, (start, stop - start, zlib.crc32(data[4 * start:4 * stop]), n)):
                    values.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in out)],
            names=names,
        )


class OpenWindows:
    """Open windows by remaining room: a segment tree over rooms says where there are any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.by_room[room].append(window)
        x = self.leaves + room
        while x and not self.some[x]:
            self.some[x] = 1
            x >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with that much room; it is closed."""
        some, x = self.some, self.leaves + need
        if not some[x]:
            while x > 1 and (x & 1 or not some[x + 1]):
                x >>= 1
            if x <= 1:
                return None
            x += 1
            while x < self.leaves:
                x = 2 * x if some[2 * x] else 2 * x + 1
        room = x - self.leaves
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            some[x] = 0
            while x > 1 and not some[x ^ 1]:
                x >>= 1
                some[x] = 0
        return room, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece: the longest first, each into the tightest window that it fits."""
    number, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    windows, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = windows.take(need)
        if not found:
            found, opened = (window, opened), opened + 1
        room, number[i] = found
        offset[i] = window - room
        if room > need:
            windows.add(room - need, int(number[i]))
    return number, offset


def _pack_group(key: tuple, pieces: pa.Table) -> pa.Table:
    number, offset = best_fit(pieces.column("length").to_numpy())
    first = key[0].as_py() << 32
    return pieces.drop_columns([GROUP]).append_column("sequence_id", pa.array(number + first)).append_column(
        "offset", pa.array(offset)
    )


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(tokens: DataFrame) -> DataFrame:
    """Pieces of (doc_id, ids): full windows of a long document and what is left of it."""
    prepare(tokens.sparkSession)
    return tokens.mapInArrow(_pieces, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def pack(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces`` is a written table with length (1 to 4096); other columns are carried along, whatever their names and nulls, but for sequence_id and
    offset, which are replaced. Pieces are dealt by a hash of their place in the table into groups of about
    ``GROUP_PIECES``, also if ids are null or repeated, and each group is packed by itself: longest pieces first, ties in
    any order, each into the open window with the least sufficient room. A group leaves about one
    window unfilled. Offsets are gapless from 0. An empty table gives an empty one.
    """
    prepare(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    groups = -(-pieces.count() // GROUP_PIECES) or 1
    dealt = pieces.withColumn(GROUP, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(GROUP).applyInArrow(_pack_group, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every text.

    Tokens are made once and cut in the same worker: the pieces, without their ids, are a narrow written table.
    """
    prepare(docs.sparkSession)
    tokenize = _tokenizing(path, END_ID)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        tidy(lambda batches: _pieces(tokenize(batches))), f"doc_id {kind}, {PIECES}"
    )
    return pack(saved(pieces, "pieces"))
