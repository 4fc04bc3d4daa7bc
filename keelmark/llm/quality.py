"""Quality scores from compressed sizes with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import hashed_mod, prepare, tidy
from keelmark.llm.sampling import sample_texts

#: The fit: at most so many texts of at most so many bytes for each label, half for the dictionaries, half for calibration.
SAMPLE_ROWS, ROW_CHARS = 4_000, 16_000
DICTIONARY_BYTES, BLOCK, LEVEL = 112_640, 512, 3
THRESHOLD = 0.7


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of P(y = 1) by Newton's method, with a slight pull of the slope to zero."""
    design = np.column_stack([np.ones_like(x), x])
    weights = np.zeros(2)
    pull = np.diag([1e-6, 1e-3 * max(float(np.var(x)), 1e-12)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - pull @ weights
        curvature = (design * (p * (1 - p))[:, None]).T @ design + pull + 1e-9 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


class CompressionClassifier:
    """Scores by how many bytes fewer a text takes with the dictionary of good text than with that of bad text.

    Both sizes are sums over blocks of ``BLOCK`` bytes, each compressed by itself, so that a long or repetitive text
    cannot be its own dictionary; the difference is divided by the text's length.
    """

    def __init__(self, good: bytes, bad: bytes, intercept: float = 0.0, slope: float = 0.0):
        self.good, self.bad, self.intercept, self.slope = good, bad, intercept, slope
        self._compressors: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": None}

    def difference(self, text: bytes) -> float:
        if self._compressors is None:
            self._compressors = []
            for content in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(content)
                held.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(
                    dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
                ))
        good, bad = self._compressors
        less = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(text))
        return less / max(1, len(text))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * x, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame) -> CompressionClassifier | float:
    """A classifier from rows of ``docs`` (doc_id, text) with a quality of 0 or 1 in ``labels``; without both labels, the share of label 1
    (0.5 without any)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    labelled = (
        texts.select("doc_id", "h")
        .join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label")), "doc_id")
    )
    found = sample_texts(labelled, texts, SAMPLE_ROWS, ROW_CHARS)
    good, bad = ([t.encode() for t in found.get(k, [])] for k in (1, 0))
    if not good or not bad:
        return 1.0 if good else 0.0 if bad else 0.5
    # hashes order the texts, so every second one is a random half
    model = CompressionClassifier(dictionary(good[::2]), dictionary(bad[::2]))
    rest = (good[1::2] or good, bad[1::2] or bad)
    # the sample has equal caps for both labels; the prior of the labelled rows is put back
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    x = np.array([model.difference(t) for part in rest for t in part])
    y = np.repeat([1.0, 0.0], [len(part) for part in rest])
    model.intercept, model.slope = logistic(x, y)
    model.intercept += float(np.log(counts[1] / counts[0]) - np.log(len(rest[0]) / len(rest[1])))
    return model


def score_quality(docs: DataFrame, model: CompressionClassifier | float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: label 1 is likelier) and ``predicted`` (1 if the score is at least ``THRESHOLD``).

    Columns of these names are replaced. Whole texts are scored; null counts as empty, and an empty text's sizes do not differ.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            if isinstance(fitted, float):
                scores = np.full(batch.num_rows, fitted)
            else:
                scores = fitted.scores([x.as_py() or b"" for x in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows that the fit never sees."""
    return hashed_mod(F.col(id_col), 4) == 2


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, learned from labelled rows that are not held out."""
    seen = docs.where(~F.coalesce(held_out(), F.lit(True)))
    return score_quality(docs, fit_quality(seen, labels))
