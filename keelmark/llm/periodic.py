"""Periodic runs of words, found by recompression.

The word sequences of many texts become one run-length grammar: block compression names
every maximal repetition of one symbol, pair compression names neighbours of which the first
lies on one side of a split of the symbols and the second on the other, and both alternate
until each text is a single symbol. Equal stretches are parsed alike but for their ends, so
longest common extensions of two places climb the grammar while the symbols above are equal
and step down where they differ. Places a period apart on a grid are the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare, tidy
from keelmark.llm.words import in_chunks, mixed

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Candidates that are looked at together.
CANDIDATES = 2_000_000
#: Bytes of text that share a grammar; a longer text has one of its own.
TOGETHER = 1_000_000
FENCE = 0  # the symbol between texts


class Grammar:
    """Run-length grammar of sequences of positive whole numbers, given with a ``FENCE`` before, between and after them.

    Level 0 is the given array. A node of a level is a symbol of it; the arrays below have one entry for each node of all levels.
    """

    def __init__(self, symbols: np.ndarray):
        now = symbols.astype(np.int64)
        fresh, level, base = int(now.max(initial=0)) + 1, 0, 0
        size = np.ones(len(now), dtype=np.int32)
        low = np.full(len(now), -1, dtype=np.int32)
        high = low
        parts: dict[str, list] = {k: [] for k in ("symbol", "size", "up", "low", "high", "ahead", "behind")}

        def close(up: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> None:
            for k, x in (("symbol", now), ("size", size), ("up", up), ("low", low), ("high", high), ("ahead", ahead), ("behind", behind)):
                parts[k].append(x.astype(np.int32))

        while True:
            inner = now != FENCE
            again = inner[1:] & (now[1:] == now[:-1])
            beside = inner[1:] & inner[:-1]
            if not beside.any():
                alone = np.ones(len(now), dtype=np.int32)
                close(np.full(len(now), -1), alone, alone)
                break
            here = np.arange(len(now), dtype=np.int32)
            one = np.ones(len(now), dtype=np.int32)
            if again.any():  # blocks
                start = np.flatnonzero(np.concatenate([[True], ~again]))
                stop = np.append(start[1:], len(now))
                owner = np.cumsum(np.concatenate([[False], ~again])).astype(np.int32)
                ahead, behind = stop[owner] - here, here - start[owner] + 1
                length, merged = stop - start, now[start]
                long = np.flatnonzero(length > 1)
                codes = pd.factorize(merged[long] * (len(now) + 1) + length[long])[0]
                merged[long] = fresh + codes
            else:  # pairs
                side = (mixed(now.astype(np.uint64) + np.uint64(level << 40)) & np.uint64(1)).astype(bool)
                falls, rises = beside & side[:-1] & ~side[1:], beside & ~side[:-1] & side[1:]
                paired = falls if falls.sum() >= rises.sum() else rises
                start = np.flatnonzero(np.concatenate([[True], ~paired]))
                stop = np.append(start[1:], len(now))
                owner = np.cumsum(np.concatenate([[False], ~paired])).astype(np.int32)
                ahead = behind = one
                merged = now[start]
                long = np.flatnonzero(stop - start == 2)
                codes = pd.factorize(merged[long] * fresh + now[start[long] + 1])[0]
                merged[long] = fresh + codes
            above = base + len(now)
            close(owner + above, ahead, behind)
            size = np.add.reduceat(size, start)
            low, high = (base + start).astype(np.int32), (base + stop - 1).astype(np.int32)
            fresh += int(codes.max(initial=-1)) + 1
            now, base, level = merged, above, level + 1
        for k, x in parts.items():
            setattr(self, k, np.concatenate(x))

    def _extensions(self, x: np.ndarray, y: np.ndarray, edge: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
        total = np.zeros(len(x), dtype=np.int64)
        at = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        while len(at):
            up, other = self.up[x], self.up[y]
            rise = (up >= 0) & (edge[up] == x) & (edge[other] == y) & (self.symbol[up] == self.symbol[other])
            same = ~rise & (self.symbol[x] == self.symbol[y])
            many = np.where(same, np.minimum(left[x], left[y]), 0)
            total[at] += many * self.size[x].astype(np.int64)
            down, other_down = edge[x], edge[y]
            going = rise | same | (down >= 0)
            x = np.where(rise, up, np.where(same, x + step * many, down))[going]
            y = np.where(rise, other, np.where(same, y + step * many, other_down))[going]
            at = at[going]
        return total

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from places x on equal those from places y > x on, both in one sequence."""
        return self._extensions(x, y, self.low, self.ahead, 1)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before places x equal those before places y > x."""
        return self._extensions(x - 1, y - 1, self.high, self.behind, -1)


def _grid(n: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequence, place, period) of the candidates of sequences of n symbols.

    A run of period q is ``max(min_length, min_exponent * q)`` long at least, so the places whose symbol equals
    the one q further on are a stretch of that less q: a grid of this step meets it.
    """
    most = np.where(n >= min_length, n // min_exponent, 0)
    owner = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(min_length, min_exponent * period) - period
    count = -(-(n[owner] - period) // step)
    ends = np.cumsum(count)
    start = 0
    while start < len(owner):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + CANDIDATES, side="right")))
        c = count[start:stop]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(owner[start:stop], c), k * np.repeat(step[start:stop], c), np.repeat(period[start:stop], c)
        start = stop


def find_runs(
    sequences: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of every run, ordered by sequence, start and period.

    A run is a stretch with smallest period q, at least ``min_length`` and ``min_exponent * q`` (two at least) symbols long,
    that no neighbour extends. Symbols are positive whole numbers.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has its period twice, and two symbols, at least")
    n = np.array([len(x) for x in sequences], dtype=np.int64)
    flat = np.full(int(n.sum()) + len(n) + 1, FENCE, dtype=np.int64)
    first = np.cumsum(n + 1) - n
    for a, x in zip(first.tolist(), sequences):
        flat[a:a + len(x)] = x
    grammar, found = None, []
    for owner, place, period in _grid(n, min_length, min_exponent):
        x = first[owner] + place
        hit = flat[x] == flat[x + period]
        owner, period, x = owner[hit], period[hit], x[hit]
        if not len(x):
            continue
        grammar = grammar or Grammar(flat)
        before = grammar.backward(x, x + period)
        length = before + period + grammar.forward(x, x + period)
        whole = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([owner, x - before - first[owner], length, period])[:, whole])
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    owner, start, length, period = np.concatenate(found, axis=1)
    # Multiples of a period give the same stretch: the smallest stays.
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = owner[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def _collapsing(min_length: int, min_exponent: int):
    names = ["row", "n_words", "runs", "kept_text"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def chunk(rows: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        codes = pd.factorize(np.array([w for ws in words for w in ws] + [None], dtype=object)[:-1])[0] + 1
        ends = np.cumsum(counts)
        owner, start, length, period = find_runs([codes[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())], min_length, min_exponent)
        kept = [b" ".join(w) for w in words]
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in np.unique(owner).tolist():
            a, b = edges[i], edges[i + 1]
            gone = np.zeros(int(counts[i]) + 1, dtype=np.int64)
            np.add.at(gone, start[a:b] + period[a:b], 1)
            np.add.at(gone, start[a:b] + length[a:b], -1)
            gone = np.cumsum(gone)
            kept[i] = b" ".join(w for w, g in zip(words[i], gone.tolist()) if not g)
        runs = pa.ListArray.from_arrays(
            pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind.value_type)),
        )
        return pa.RecordBatch.from_arrays([rows, pa.array(counts), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in in_chunks(texts, TOGETHER):
                yield chunk(batch.column(0).slice(a, b - a), texts[a:b])

    return run


def periodic_runs(
    docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per input row: row (a struct of its columns), n_words, runs (start, length, period, ordered by start, then period), kept_text.

    Words are runs of other characters than the six ASCII spaces, numbered from 0. A run is a maximal stretch of words
    with smallest period q that is at least ``min_length`` and ``min_exponent * q`` words long. kept_text has the words that lie in no run behind
    its first period, joined by single spaces. Null, empty and wordless texts have no runs and an empty kept_text. Repeated rows,
    null ids and equal texts are each a row of their own; columns of the input may have any names. An empty table gives an empty one.

    The work is narrow: no shuffle, nothing shared between texts. A text of n words has about n log n candidates, looked at
    ``CANDIDATES`` at a time; grammar and words of the longest text must fit into a worker, some 300 bytes a word.
    """
    prepare(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = taken.schema["row"].dataType.simpleString()
    return taken.mapInArrow(
        tidy(_collapsing(min_length, min_exponent)),
        f"row {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string",
    )
