"""From documents to packed training sequences, a stage at a time.

Ids are whole numbers (else a TypeError) and may be null; a document is an id with its text, and rows that repeat both are one. Each stage takes any columns
beside doc_id, text and lang and, but for the last, returns those that it was given. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import linededup, packing, quality_lm, simhash, substring
from millrace.llm.common import remove, shared_dir, until_exit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones among them, doesn't reject.

    Null and empty texts go; a null language counts as "", and one without calibrating documents goes by the limit of all. A perplexity on the limit is kept. Repeated rows stay or go together.
    """
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line only where it first occurs, by id (null first), hash of the text, and position; blank lines stay, documents left blank and null texts go. Repeated rows stay as they are to each other."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first by id, then hash of the text. Of repeated rows one stays; rows with null ids, null and wordless texts are in no group and stay."""
    return simhash.dedup_near(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occur before, by id, hash of the text, and position. Rows with null ids are left as they are; documents left blank and null texts go."""
    return substring.dedup_substrings(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go in training sequences; texts without words have no piece, repeated rows have pieces of their own."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("packing", packed),
]

#: A fitted language model, covering hashes and a branch-and-bound search have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each one's result is written to the shared folder, read again by the next, and removed when that is done. The last one's goes when the process ends."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = until_exit(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
