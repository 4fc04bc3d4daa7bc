"""Quality rules from repetition: characters inside repeated lines and word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare, tidy
from keelmark.llm.words import Rolling, in_chunks, mixed

#: Published limits (Rae et al., 2021): the share of a text's characters inside repeated n-grams of so many words.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The same for lines that equal an earlier line.
LINE_CHARS_LIMIT = 0.20
#: Words of the windows whose coverage is counted with the first occurrence.
COUNTED = 3
SYMBOLS = b"#*$%&|<>"
TOGETHER = 1_000_000


def _exact(ids: np.ndarray, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the windows of n words at these places, equal for equal windows of one text only."""
    name = text[at]
    for k in range(n):
        name = pd.factorize(name * (len(ids) + 1) + ids[at + k])[0].astype(np.int64)
    return name


def repeated_windows(ids: np.ndarray, text: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the places of windows found twice or more in their text, and which of them repeat an earlier one.

    ``ids`` has the words of many texts one after the other, ``text`` the text of each. Windows are named by rolling
    hashes and sorted; neighbours of one hash are compared word by word. Only where a shorter window is
    repeated can a longer one be.
    """
    rolling = Rolling(mixed(ids.astype(np.uint64) + np.uint64(1)))
    at, out = np.arange(len(ids)), {}
    for n in sorted(lengths):
        at = at[at + n <= len(ids)]
        at = at[text[at] == text[at + n - 1]]
        name = mixed(rolling.of(at, at + n) ^ mixed(text[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        x, y = at[order][:-1][same], at[order][1:][same]
        equal = text[x] == text[y]
        for k in range(n):
            equal &= ids[x + k] == ids[y + k]
        if not equal.all():  # windows that share a hash
            name = _exact(ids, text, at, n)
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
        later = np.concatenate([[False], same])[:len(at)]
        several = later | np.concatenate([same, [False]])[:len(at)]
        repeats, chosen = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
        repeats[order], chosen[order] = later, several
        at, repeats = at[chosen], repeats[chosen]
        out[n] = at, repeats
    return out


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    edges = np.bincount(at, minlength=words + 1) - np.bincount(at + n, minlength=words + 1)
    return np.cumsum(edges)[:words] > 0


def _repeated_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those of them that equal an earlier line, and the word characters in these."""
    lines = text.split(b"\n")
    worded = [x for x in lines if x and not x.isspace()]
    if len(set(worded)) == len(worded):
        return len(worded), 0, 0
    seen, repeated, chars = set(), 0, 0
    for x in worded:
        if x in seen:
            repeated += 1
            chars += len(b"".join(x.split()).decode())
        seen.add(x)
    return len(worded), repeated, chars


def _measuring(lengths: list[int]):
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]

    def chunk(rows: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        split = [t.split() for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        ids, distinct = pd.factorize(np.array([w for ws in split for w in ws] + [None], dtype=object)[:-1])
        text = np.repeat(np.arange(len(texts)), counts)
        chars = np.array([len(w.decode()) for w in distinct], dtype=np.int64)[ids]
        found = repeated_windows(ids, text, sorted({COUNTED, *lengths}))

        def per_text(values: np.ndarray, where: np.ndarray) -> np.ndarray:
            return np.bincount(text[where], weights=values[where], minlength=len(texts)).astype(np.int64)

        at, _ = found[COUNTED]
        lines = np.array([_repeated_lines(t) for t in texts], dtype=np.int64).reshape(-1, 3)
        out = [
            counts, per_text(chars, np.ones(len(ids), dtype=bool)),
            np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64), *lines.T,
            per_text(np.ones(len(ids)), _covered(at, COUNTED, len(ids))),
        ]
        for n in lengths:
            at, repeats = found[n]
            out.append(per_text(chars, _covered(at[repeats], n, len(ids))))
        return pa.RecordBatch.from_arrays([rows, *(pa.array(x) for x in out)], names=["row", *names, *(f"dup_chars_{n}" for n in lengths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in in_chunks(texts, TOGETHER):
                yield chunk(batch.column(0).slice(a, b - a), texts[a:b])

    return names, run


def repetition(docs: DataFrame, text_col: str = "text", lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """One row per input row: row (a struct of its columns) and the measures of its whole text.

    Words are runs of other characters than the six ASCII spaces. n_words; word_chars, their code points; n_symbols, characters of
    ``[#*$%&|<>]``; n_lines, lines (cut at \\n) with a word; n_dup_lines, those equal to an earlier one, and dup_line_chars, the code points of
    words in them; n_repeat_words, words in windows of three words found twice or more, first included; for each length n
    dup_chars_n, code points of words in windows of n words that equal an earlier window of the text.

    Null, empty and wordless texts have zeros (symbols aside). Repeated rows and null ids are rows of their own, input columns may have any names,
    an empty table gives an empty one. The work is narrow; words of the longest text must fit into a worker, some 200 bytes a word.
    """
    prepare(docs.sparkSession)
    lengths = sorted(set(lengths))
    names, run = _measuring(lengths)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    measures = ", ".join(f"{c} long" for c in [*names, *(f"dup_chars_{n}" for n in lengths)])
    return taken.mapInArrow(tidy(run), f"row {taken.schema['row'].dataType.simpleString()}, {measures}")


def repeats_little(limits: dict[int, float] = NGRAM_LIMITS) -> Column:
    """The verdict on the output of ``repetition``: of a text's word characters no more than these shares lie in repeated n-grams or lines.

    A text without words passes. Lines are judged by their characters, not by their number: of three lines one may be a refrain.
    """
    shares = {"dup_line_chars": LINE_CHARS_LIMIT, **{f"dup_chars_{n}": limit for n, limit in limits.items()}}
    return reduce(lambda a, b: a & b, [F.col(c) * 100 <= F.col("word_chars") * round(100 * limit) for c, limit in shares.items()])
