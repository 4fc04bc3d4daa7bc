"""From raw documents to packed training windows, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelmark.llm.exact_dedup import exact_duplicates
from keelmark.llm.language import UNKNOWN, fit_documents, identify_languages
from keelmark.llm.packing import pack_documents
from keelmark.llm.passages import remove_repeats
from keelmark.llm.runtime import documents, saved
from keelmark.llm.simhash import first_of_similar

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; null, empty and letterless texts go.

    If no row has a language to learn from, every text with a letter stays. Repeated rows are judged one by one; columns may have any
    names and nulls; an empty table gives an empty one.
    """
    parser = fit_documents(docs)
    if not parser.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("_")).alias("others")
    found = identify_languages(docs.select("text", others), parser).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest id, null last; of rows that share it one.

    Null and empty texts are equal. An empty table gives an empty one.
    """
    return exact_duplicates(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 4 or fewer differing bits of their four-word SimHash the document with the smallest id; of rows that share it, or
    have none, one. Null, empty and wordless texts are one group."""
    return first_of_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; documents of which nothing is left go.

    A text that loses words becomes the rest, joined by single spaces, and its n_chars follows; other texts, null and empty ones too, stay as they
    are. Rows that share an id never take words from each other.
    """
    found = remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows. Null and empty texts are their end mark; repeated rows are packed
    each; a row's other columns do not matter."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
