"""A corpus cleaned in stages, each by one of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All stages but the last return the columns of
``documents``; each works on every row its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import bpe, decontaminate, langid, linetree, simhash
from tablecheck.llm.common import fold, free_name, read_table
from tablecheck.llm.queries import BPE_FILE, PIECE_FILE
from tablecheck.session import cut_lineage


#: Documents whose language is less likely than this (after the fact, among the learned ones) are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and documents of no clear language; the model learns from the labels of three quarters of them.

    Null and empty texts go. Of two equally likely languages neither reaches the score. Repeated rows are judged alike, texts of any length as a whole; columns
    of any name pass through. Without any label all documents with a letter stay.
    """
    path = public_tokenizers.path(PIECE_FILE)
    pieces = langid.load_pieces(path)
    langs, probability = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2).select("lang", "text"), pieces)
    if not langs:  # nothing is labelled, so only the letters can be judged
        return docs.filter(F.col("text").rlike("\\p{L}"))
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    judged = langid.predict(docs, langs, probability, pieces, pred=pred, score=score)
    return judged.filter((F.col(pred) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(pred, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of the texts; n_chars follows where a line went.

    No row goes: null texts stay null, a text of such lines alone becomes empty. Repeated rows get the same text; columns of any name pass through.
    """
    rows = linetree.drop_recurring(docs)
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class that SimHash links (three-word shingles, three bits).

    The smallest doc_id stays, a null one only where there is no other; texts without words are one class, repeated rows stay once.
    """
    return simhash.keep_first(docs, shingle=3, radius=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, as digests; a null text has no ids, repeated rows give repeated rows."""
    return bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("bpe", encode),
]

#: No SQL: language scores and byte pairs cannot be expressed there; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
