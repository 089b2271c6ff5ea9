"""The corpus pipeline: five stages of the llm operators over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of
documents, whatever they are, also ones named like an operator's own. SQL cannot express these
stages, so there is no ORACLE_SQL; tests/llm compares them, one after the other, with brute force.

An empty table stays empty in every stage. Rows are told apart by id and text, so a null id is an
id like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import contamination, jaccard, langid, pieces, suffixes
from marlstone.session import Folder, ensure_importable, files_for, shared_folder, table


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose input and result are packed into pieces of a few megabytes, so that small files don't multiply."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        files = files_for(docs)
        return work(spark, docs.coalesce(files), sf_dir).coalesce(files)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no learned language explains, go.

    Null and empty texts have no letters. Equal texts stay or go together. Without any labelled
    document no language is learned, and all go.
    """
    return langid.keep_known(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Exact copies are near copies; of rows that repeat id and text one stays. A null id comes last.
    Texts without words are nobody's copies and stay.
    """
    return jaccard.keep_one(docs)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere are cut out of every text.

    No row goes; a text may become empty, a null one stays null. Halves of characters at a cut
    go too, and n_chars is counted anew.
    """
    return suffixes.cut(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go: a twentieth of their words in its windows.

    Null and empty texts hold nothing and stay; so does everything without items.
    """
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids and round_trip of every document left; a null text has null ids."""
    return pieces.digest(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; the stages' tables lie in a folder of their own among the shared ones."""
    ensure_importable(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    store = Folder(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            store.delete(str(k - 1))  # nothing reads it any more
    return docs
