"""Words of many texts at once: their places and hashes in flat arrays."""

from __future__ import annotations

import numpy as np

_P, _P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        grown = []
        for base in (_P, _P_INVERSE):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            grown.append(np.multiply.accumulate(factors))
        _powers, _inverses = grown
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit numbers, from one pass over it."""

    def __init__(self, values: np.ndarray):
        powers, self.inverses = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers[:len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64)
        return mixed((self.sums[stop] - self.sums[start]) * self.inverses[start] + size * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a list of texts, as runs of other bytes than the six ASCII spaces."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        codes = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.zeros(len(codes) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[codes]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)
        sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        #: text of each word, and each text's first word
        self.text = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self._codes = codes

    def hashes(self) -> np.ndarray:
        return Rolling(_BYTE[self._codes]).of(self.start, self.stop)


def in_chunks(texts: list[bytes] | list[str], size: int = 500_000) -> list[tuple[int, int]]:
    """Ranges of the list with about ``size`` bytes or characters each, a longer text alone in its own."""
    out, start, held = [], 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            out.append((start, i))
            start, held = i, 0
        held += len(x) + 1
    if start < len(texts):
        out.append((start, len(texts)))
    return out
