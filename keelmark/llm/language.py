"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import hashed_mod, prepare, tidy
from keelmark.llm.sampling import sample_texts

UNKNOWN = "und"
#: The fit: at most so many rows a language, a stretch of so many characters of a longer one, until they hold so many bytes.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_BYTES = 64, 4_000, 24_000
#: Texts are parsed in pieces of so many bytes, many pieces at a time.
PIECE, TOGETHER = 512, 1_000_000
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters_only(text: str | None) -> bytes:
    """Lower case, with every run of other characters than letters as one space."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def suffix_automaton(codes: bytes, width: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings; 0 where there is none."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.zeros((len(following), width), dtype=np.uint16 if len(following) < 65_536 else np.int32)
    for state, go in enumerate(following):
        for c, to in go.items():
            table[state, c] = to
    return table


class CrossParser:
    """Phrases that a text needs when each is the longest match in a language's sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.codes = np.zeros(256, dtype=np.uint8)  # 0: in no sample, so it never matches
        self.codes[used] = np.arange(1, len(used) + 1)
        coded = self.codes.tobytes()
        self.tables = [suffix_automaton(samples[x].translate(coded), len(used) + 1) for x in self.languages]
        self.cost = [math.log2(len(samples[x]) + 1) for x in self.languages]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: how many phrases. A piece's end also ends a phrase, for every language alike."""
        data = self.codes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        lengths = np.array([len(x) for x in texts])
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * PIECE
        size = np.minimum(PIECE, np.repeat(lengths, pieces) - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # pieces longer than j
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        steps = [data[start[:n] + j] for j, n in enumerate(active.tolist())]
        for k, table in enumerate(self.tables):
            state = np.zeros(len(size), dtype=table.dtype)
            count = np.zeros(len(size), dtype=np.int64)
            flat, width, first = table.ravel(), table.shape[1], table[0]
            for codes in steps:
                n = len(codes)
                went = flat[state[:n].astype(np.int64) * width + codes]
                ended = went == 0
                count[:n] += ended | (state[:n] == 0)  # state 0: the piece's start, or a code in no sample
                state[:n] = np.where(ended, first[codes], went)
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cleaned = [letters_only(x) for x in texts]
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, x in enumerate(cleaned) if x and self.languages]
        if not known:
            return languages, scores
        bits = self.phrases([cleaned[i] for i in known]) * np.array(self.cost)
        best = bits.argmin(axis=1)
        ranked = np.sort(bits, axis=1)
        margin = 1 - ranked[:, 0] / ranked[:, 1] if bits.shape[1] > 1 else np.ones(len(known))
        for i, k, m in zip(known, best.tolist(), margin.tolist()):
            languages[i], scores[i] = self.languages[k], m
        return languages, scores


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """A parser from a bounded sample of the rows with a language and letters.

    Of each language the distinct texts with the smallest hashes are taken, ``SAMPLE_ROWS`` at most, until they hold
    ``SAMPLE_BYTES``; of a text of more than ``ROW_CHARS`` characters a stretch of that length, placed by its hash. Only these few reach the driver.
    """
    rows = labelled.select(F.col(lang_col).alias("label"), F.col(text_col).alias("text")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("h", F.xxhash64("text"))
    samples: dict[str, bytes] = {}
    for language, texts in sample_texts(rows, rows, SAMPLE_ROWS, ROW_CHARS).items():
        held = b""
        for text in texts:
            if len(held) < SAMPLE_BYTES:
                held += b" " + letters_only(text)
        samples[language] = held
    return CrossParser(samples)


def identify_languages(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced).

    The language whose sample parses the text into the fewest phrases, each weighed with the
    bits of a position in the sample, is predicted; the score is by how much less it costs than
    the second (0 to 1; 1 if only one language was learned). Ties go to the name that sorts first.
    Null texts, and texts without a letter, are ``und`` with score 0, as all are if nothing was learned.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    languages, scores = model.predict(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(languages), pa.array(scores)],
                        names=[*part.schema.names, "lang_pred", "score"],
                    )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that the fit never sees."""
    return hashed_mod(F.col(id_col), 3) == 1


def fit_documents(docs: DataFrame) -> CrossParser:
    """A parser from the rows of ``docs`` that are not held out."""
    return fit_languages(docs.where(~F.coalesce(held_out(), F.lit(True))))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from its rows that are not held out."""
    return identify_languages(docs, fit_documents(docs))
