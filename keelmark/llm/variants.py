"""Spelling variants of words by generation over a reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare, saved, tidy
from keelmark.llm.words import mixed

#: A maximal run of letters; Java and Python read it alike.
LETTERS = r"[A-Za-zÀ-ÿ]"
RATIO = 5
#: Words that share a reduced word, beyond which they are looked up over a finer alphabet.
BUCKET = 1000
#: Neighbours that are made together.
TOGETHER = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_runs(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """The columns of ``docs`` but the text, and ``run``: a row for each maximal run of letters of at least ``least`` code points."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(*rest, F.explode(runs).alias("run"))


def _codes(words: list[str], symbols: int) -> np.ndarray:
    """Reduced symbols (1 to ``symbols``) of all words, one after the other; without a number all letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if symbols:
        points = mixed(points) % np.uint64(symbols)
    return points + np.uint64(1)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Per row the hash of every prefix: the sum of symbol times power, modulo 2**64."""
    powers = np.full(codes.shape[1] + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(codes * np.multiply.accumulate(powers)[:codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _named(hashes: np.ndarray, length: int) -> np.ndarray:
    return mixed(hashes ^ mixed(np.uint64([length]))).view(np.int64)


def _neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the full one-edit neighbourhood of words of one length (rows of ``codes``), each neighbour once a word.

    A hash of any neighbour follows from the hashes of the word's prefixes, so each costs the same however long the word is.
    """
    m, length = codes.shape
    sums = _sums(codes)
    powers = np.full(length + 2, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    before, after = sums[:, :-1], sums[:, -1:] - sums[:, 1:]
    new = np.ones((m, length), dtype=bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    # A letter left out of a run of equal ones, or put into it, counts once.
    yield np.arange(m), _named(sums[:, -1], length)
    yield np.nonzero(new)[0], _named((before + after * inverse)[new], length - 1)
    for letter in alphabet:
        other = codes != letter
        yield np.nonzero(other)[0], _named((before + letter * powers[:length] + after)[other], length)
        put = np.ones((m, length + 1), dtype=bool)
        put[:, :-1] = other
        rest = (sums[:, -1:] - sums) * _BASE
        yield np.nonzero(put)[0], _named((sums + letter * powers[:length + 1] + rest)[put], length + 1)


def _making(symbols: int, alphabet: list[int], whole: bool):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, id) of every word, or of every neighbour of every word."""
        letters = np.array(alphabet, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words = np.array(batch.column(1).to_pylist() + [None], dtype=object)[:-1]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            for length in np.unique(sizes).tolist():
                where = np.flatnonzero(sizes == length)
                rows = max(1, TOGETHER // (2 * length + 2))
                for a in range(0, len(where), rows):
                    part = where[a:a + rows]
                    codes = _codes(words[part].tolist(), symbols).reshape(len(part), length)
                    made = _neighbours(codes, letters) if whole else [(np.arange(len(part)), _named(_sums(codes)[:, -1], length))]
                    for owner, key in made:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[part][owner])], names=["key", "id"])

    return tidy(keys)


def _keyed(words: DataFrame, symbols: int, alphabet: list[int], whole: bool) -> DataFrame:
    return words.select("id", "word").mapInArrow(_making(symbols, alphabet, whole), "key long, id long")


def _verified(around: DataFrame, keyed: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of different words one edit apart, out of those that share a key: numbers meet first, then words are fetched for them.

    Spark takes neighbourhoods to be as many as their words and would broadcast them, so the join is told to merge.
    """
    there = keyed.join(words.select("id", F.col("word").alias("other")), "id").select("key", F.col("id").alias("other_id"), "other")
    pairs = around.hint("merge").join(there, "key").where("id <> other_id").join(words.select("id", "word"), "id")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("id", "other_id")


def near_words(words: DataFrame) -> DataFrame:
    """(id, other_id) for all ordered pairs of words that differ by one inserted, deleted or replaced code point.

    ``words`` is a written table of distinct longs ``id`` and distinct strings ``word``, not null, not empty. Letters are hashed to a few symbols: so many that reduced words
    of seven letters are about as many as the words. The full one-edit neighbourhood of each reduced
    word, in 64-bit keys, is joined to the keys of the reduced words themselves: one edit changes a reduced word
    by one edit at most. Words that meet are compared as they are. Where more than ``BUCKET`` words share a reduced word, they are left out of this join, and the words that
    have it for a neighbour look them up over all letters, where each word has a key of its own.
    """
    spark = words.sparkSession
    prepare(spark)
    symbols = max(4, int(np.ceil(words.count() ** (1 / 7))))
    alphabet = list(range(1, symbols + 1))
    keyed = saved(_keyed(words, symbols, alphabet, False), "reduced-words")
    hot = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "hot-words")
    around = _keyed(words, symbols, alphabet, True)
    if hot.isEmpty():
        return _verified(around, keyed, words).distinct()
    many = saved(words.join(keyed.join(hot, "key", "left_semi"), "id", "left_semi"), "words-of-hot")
    # At most as many as there are letters.
    letters = [ord(r["c"]) + 1 for r in many.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    asking = words.join(around.join(hot, "key", "left_semi").hint("merge"), "id", "left_semi")
    return _verified(around, keyed.join(hot, "key", "left_anti"), words).union(
        _verified(_keyed(asking, 0, letters, True), _keyed(many, 0, letters, False), words)
    ).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to their end. Every round doubles the steps taken."""
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("end"))
        now = saved(now.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(
    occurrences: DataFrame, word_col: str = "word", least_length: int = 6, least_count: int = 5, ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of enough letters and rows.

    ``occurrences`` has a row per occurrence; other columns are ignored, null words left out. n is the number of
    a word's rows, n_near the number of words one inserted, deleted or replaced code point away. form is the most frequent of these
    (ties: the smallest in code-point order) if it is at least ``ratio`` (two or more) times as frequent, form_n its n, else both are null; root
    is where the forms lead, the word itself if it has none. Case and accents count. An empty table gives an empty one.

    Occurrences are counted by partial aggregates, so a frequent word is one row per task. All later steps read the words only. Counts grow along forms, so these have no
    cycles and are at most ``log(rows)`` long. Words are of any length; comparing two that meet takes the square of it.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = saved(
        occurrences.where(F.length(F.col(f"`{word_col}`")) >= least_length).groupBy(F.col(f"`{word_col}`").alias("word"))
        .agg(F.count("*").alias("n")).where(F.col("n") >= least_count).withColumn("id", F.monotonically_increasing_id()),
        "words",
    )
    others = words.select(F.col("id").alias("other_id"), F.col("word").alias("other"), (-F.col("n")).alias("less"))
    best = near_words(words).join(others, "other_id").groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct("less", "other")).alias("best")
    )
    enough = -F.col("best.less") >= F.col("n") * ratio
    found = saved(
        words.join(best, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
